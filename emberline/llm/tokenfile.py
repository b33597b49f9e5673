"""Operator 6: token ids in directly addressable codes (DAC).

An id is cut into chunks of ``CHUNK_BITS`` bits, low ones first. Level 0 holds every id's first chunk; a
continuation bitmap says which ids go on, and level k + 1 holds the next chunks of just those, in order. A rank
directory (set bits before each 512-bit block) turns a position on one level into a position on the next, so
any id, or any range of ids, is read without decoding what stands before it.

A file is one block of documents: ``MAGIC``, counts, then per level the chunks, the bitmap and its directory,
then the documents' starting positions, their keys and a bitmap of the keys that are null. Files are written by Spark as rows of (file number, bytes), in
ascending order of the documents' keys, to the shared folder.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.common import bucket_index, map_rows, partitions, range_buckets, shared_folder, text_of
from emberline.llm.wordbpe import chunk_encoder

MAGIC = b"DAC1"
CHUNK_BITS = 8
BLOCK = 512
#: A file is closed once it holds this many ids, at the end of a document. At about two bytes an id, a file stays below half a JVM heap region.
FILE_IDS = 1 << 17
#: Files are dense already: no compression or dictionary is tried, and a page is closed by its size, not after a hundred files at least.
PARQUET = {"compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4"}


def pack(ids: np.ndarray, starts: np.ndarray, keys: list[int | None]) -> bytes:
    """A file of the documents whose ids begin at ``starts`` of ``ids``; ``keys`` are their numbers (any, or null)."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest) and len(levels) < 32 // CHUNK_BITS:
        more = rest >= 1 << CHUNK_BITS
        bitmap = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(more) // BLOCK) * BLOCK, bool)
        padded[: len(more)] = more
        directory = np.concatenate([[0], np.cumsum(padded.reshape(-1, BLOCK).sum(1))]).astype("<u4")
        levels.append(struct.pack("<I", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bitmap.tobytes() + directory.tobytes())
        rest = rest[more] >> CHUNK_BITS
    return MAGIC + struct.pack("<III", len(levels), len(starts), len(ids)) + b"".join(levels) + starts.astype("<u4").tobytes() + np.array([0 if k is None else k for k in keys], "<i8").tobytes() + np.packbits(np.array([k is None for k in keys], bool), bitorder="little").tobytes()


class Reader:
    """Random access to one file's ids."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        depth, docs, self.count = struct.unpack_from("<III", raw, 4)
        at, self.levels = 16, []
        for _ in range(depth):
            (n,) = struct.unpack_from("<I", raw, at)
            chunks = np.frombuffer(raw, np.uint8, n, at + 4)
            bits = np.frombuffer(raw, np.uint8, -(-n // 8), at + 4 + n)
            ranks = np.frombuffer(raw, "<u4", -(-n // BLOCK) + 1, at + 4 + n + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += 4 + n + len(bits) + 4 * len(ranks)
        self.starts = np.append(np.frombuffer(raw, "<u4", docs, at), np.uint32(self.count)).astype(np.int64)
        nulls = self._bits(np.frombuffer(raw, np.uint8, -(-docs // 8), at + 12 * docs), 0, docs)
        self.keys = [None if n else k for k, n in zip(np.frombuffer(raw, "<i8", docs, at + 4 * docs).tolist(), nulls.tolist())]

    @staticmethod
    def _bits(bits: np.ndarray, start: int, end: int) -> np.ndarray:
        return np.unpackbits(bits[start // 8 : -(-end // 8)], bitorder="little")[start % 8 : start % 8 + end - start].astype(bool)

    def _rank(self, level: int, at: int) -> int:
        """Set bits of a level before position ``at``: the directory's number and those of one block."""
        _, bits, ranks = self.levels[level]
        block = at // BLOCK
        return int(ranks[block]) + int(self._bits(bits, block * BLOCK, at).sum())

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids at positions ``start`` to ``end`` (exclusive)."""
        out = np.zeros(end - start, np.uint32)
        where, a, b = np.arange(end - start), start, end
        for level, (chunks, bits, _) in enumerate(self.levels):
            if b <= a:
                break
            out[where] |= chunks[a:b].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            more = self._bits(bits, a, b)
            where, a = where[more], self._rank(level, a)
            b = a + len(where)
        return out

    def __getitem__(self, at: int) -> int:
        return int(self.slice(at, at + 1)[0])

    def document(self, k: int) -> np.ndarray:
        """All ids of the file's k-th document."""
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, key: str = "doc_id", file_ids: int = FILE_IDS) -> None:
    """Encodes every whole text, appends ``end_id`` and writes DAC files in ascending order of ``key``.

    Texts are encoded where they are read. What moves is the packed ids: to ranges of the key, whose bounds
    come from a sketch of the key column alone; a range's task writes its documents one after another.
    Null text counts as empty (the end id alone); a null key sorts first and is stored as null; rows of equal keys
    follow each other by their ids; repeated rows are all written; an empty table writes no file.
    """
    spark = docs.sparkSession
    bounds = range_buckets(docs, key, partitions(spark))
    texts = docs.select(F.col(key).cast("long").alias(key), text_of().alias("text"))

    def encode(rows: dict) -> dict:
        encoder = chunk_encoder(tokenizer)
        return {key: rows[key], "ids": [encoder.ids(t).tobytes() for t in rows["text"]], "bucket": [bucket_index(k, bounds) for k in rows[key]]}

    wide = chunk_encoder(tokenizer).kind.str
    packed = map_rows(texts, f"{key} long, ids binary, bucket int", encode)
    ordered = packed.repartition(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", F.col(key).asc_nulls_first(), "ids")
    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("n_ids", pa.int64()), ("payload", pa.binary())])

    def files(batches):
        held: list[tuple[int | None, np.ndarray]] = []
        state = {"bucket": None, "part": 0, "n": 0}

        def close():
            lengths = np.array([len(x) for _, x in held], np.int64)
            raw = pack(np.concatenate([x for _, x in held]), np.cumsum(lengths) - lengths, [k for k, _ in held])
            row = pa.RecordBatch.from_pydict({"bucket": [state["bucket"]], "part": [state["part"]], "n_ids": [int(lengths.sum())], "payload": [raw]}, schema=schema)
            held.clear()
            state.update(part=state["part"] + 1, n=0)
            return row

        for batch in batches:
            for k, raw, bucket in zip(*(batch.column(c) for c in (key, "ids", "bucket"))):
                bucket = bucket.as_py()
                if held and (bucket != state["bucket"] or state["n"] >= file_ids):
                    yield close()
                if bucket != state["bucket"]:
                    state.update(bucket=bucket, part=0)
                ids = np.append(np.frombuffer(raw.as_py(), wide).astype(np.uint32), np.uint32(end_id))
                held.append((k.as_py(), ids))
                state["n"] += len(ids)
        if held:
            yield close()

    ordered.mapInArrow(files, "bucket int, part int, n_ids long, payload binary").write.mode("overwrite").options(**PARQUET).parquet(folder)


def file_starts(spark: SparkSession, folder: str) -> DataFrame:
    """Each file's first position among all ids (bucket, part, _start, n_ids), from the files' counts alone."""
    files = spark.read.parquet(folder).select("bucket", "part", "n_ids")
    sizes = files.groupBy("bucket").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per range: at most as many as shuffle partitions
    ranges = sizes.select("bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_range"))
    inside = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("bucket", "part", "n_ids", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_file")).join(ranges, "bucket").select("bucket", "part", (F.col("_range") + F.col("_file")).alias("_start"), "n_ids")


def tokens_at(spark: SparkSession, folder: str, positions: DataFrame, position: str = "position") -> DataFrame:
    """The ids at any positions (those of ``start`` in ``read_tokens``), by rank directories, without decoding a document.

    Returns position and token, a row for each different position that exists; null ones and those out of range give
    no row. Files and positions meet in cells of ``FILE_IDS`` positions; a file's positions go to one task with it.
    """
    cell = lambda c: F.floor(c / FILE_IDS).cast("long")
    files = file_starts(spark, folder).where("n_ids > 0").withColumn("_end", F.col("_start") + F.col("n_ids"))
    files = files.withColumn("_cell", F.explode(F.sequence(cell(F.col("_start")), cell(F.col("_end") - 1))))
    asked = positions.select(F.col(position).cast("long").alias("_at")).where("_at is not null").distinct().withColumn("_cell", cell(F.col("_at")))
    met = asked.join(files, "_cell").where("_at >= _start and _at < _end").groupBy("bucket", "part").agg(F.collect_list(F.col("_at") - F.col("_start")).alias("at"), F.first("_start").alias("_start"))
    both = spark.read.parquet(folder).select("bucket", "part", "payload").join(met, ["bucket", "part"])

    def look(batches):
        for batch in batches:
            for raw, at, start in zip(*(batch.column(c) for c in ("payload", "at", "_start"))):
                reader, places = Reader(raw.as_py()), at.as_py()
                yield pa.RecordBatch.from_arrays([pa.array([start.as_py() + p for p in places], pa.int64()), pa.array([reader[p] for p in places], pa.int64())], ["position", "token"])

    return both.select("payload", "at", "_start").mapInArrow(look, "position long, token long")


def read_tokens(spark: SparkSession, folder: str, key: str = "doc_id", outputs: bool = False) -> DataFrame:
    """Every document's place and digest, read back from the files (with ``outputs`` also its ids).

    Where a file starts follows from the numbers of ids of the files before it: sums of the ranges, then of
    the files within a range; the ids themselves aren't moved for that.
    """
    files, places = spark.read.parquet(folder), file_starts(spark, folder)
    fields = [("bucket", pa.int32()), ("part", pa.int32()), (key, pa.int64()), ("_at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if outputs else [])
    schema = pa.schema(fields)

    def documents(batches):
        for batch in batches:
            for bucket, part, raw in zip(*(batch.column(c) for c in ("bucket", "part", "payload"))):
                reader = Reader(raw.as_py())
                n, ids = len(reader.keys), [reader.document(k) for k in range(len(reader.keys))]
                out = {"bucket": [bucket.as_py()] * n, "part": [part.as_py()] * n, key: reader.keys, "_at": reader.starts[:-1].tolist(), "n_tokens": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]}
                yield pa.RecordBatch.from_pydict(out | ({"ids": [x.astype(np.int32) for x in ids]} if outputs else {}), schema=schema)

    found = files.select("bucket", "part", "payload").mapInArrow(documents, f"bucket int, part int, {key} long, _at long, n_tokens long, ids_crc32 long" + (", ids array<int>" if outputs else ""))
    placed = found.join(places, ["bucket", "part"])
    return placed.select(key, (F.col("_start") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if outputs else []))


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for files in the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
