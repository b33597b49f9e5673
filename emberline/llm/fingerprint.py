"""Operator 10: improbable-feature digests.

Every window of ``WINDOW`` bytes of a text has an entropy; entropies are counted over the whole corpus, and a
window ranks by how rare its entropy is there. A window that is the rarest (leftmost at ties) of at least
``POPULAR`` of the ``SPAN`` stretches of ``SPAN`` windows around it is a feature. Features, in order and
without repeats, go into Bloom filters of ``BITS`` bits with five bits each; a filter that holds ``PER_FILTER``
features is followed by the next. Two digests are compared by the overlap of their filters' bits, less the
overlap that chance gives, over the most that it could be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import bucket_index, bucket_of, partitions, range_buckets, text_of

WINDOW, SPAN, POPULAR, BITS, PER_FILTER, BINS = 16, 32, 8, 2048, 160, 1000
#: Windows below this share of the highest entropy (runs of one or two characters) are never features.
FLAT = 0.2
#: Texts are put together to blocks of about so many bytes, which the processor's cache holds.
BLOCK = 1 << 16

_G = np.concatenate([[0], np.round(np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1)) * 4096)]).astype(np.int64)
_STEP = np.concatenate([[0], np.diff(_G)]).astype(np.int64)


def entropy_bins(data: np.ndarray) -> np.ndarray:
    """The entropy, as one of ``BINS`` + 1 steps, of every window of a block of bytes.

    The sum of n log n over a window's byte counts n changes by two terms from one window to the next: the
    count of the byte that leaves, and that of the one that enters. Both come from comparing the block with
    itself, moved by 1 to ``WINDOW`` - 1 places.
    """
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    ahead, behind = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for k in range(1, WINDOW):
        same = (data[:-k] == data[k:]).view(np.uint8)
        ahead[:-k] += same
        behind[k:] += same
    first = _G[np.bincount(data[:WINDOW])].sum()
    sums = np.empty(n - WINDOW + 1, np.int64)
    sums[0] = first
    np.cumsum(_STEP[behind[WINDOW:]] - _STEP[ahead[: n - WINDOW]], out=sums[1:])
    sums[1:] += first
    return (_G[WINDOW] - sums) * BINS // _G[WINDOW]


def blocks(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, list[int]]]:
    """Groups of texts of about ``BLOCK`` bytes: their places in the list, the bytes, where each begins (and the end)."""
    held, size = [], 0
    for i, t in enumerate(texts):
        held.append(i)
        size += len(t)
        if size >= BLOCK or i == len(texts) - 1:
            starts = np.cumsum([0, *(len(texts[j]) for j in held)]).tolist()
            yield held, np.frombuffer(b"".join(texts[j] for j in held), np.uint8), starts
            held, size = [], 0


def count_bins(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each entropy."""
    out = np.zeros(BINS + 1, np.int64)
    for _, data, starts in blocks(texts):
        bins = entropy_bins(data)
        for a, b in zip(starts, starts[1:]):
            if b - a >= WINDOW:
                out += np.bincount(bins[a : b - WINDOW + 1], minlength=BINS + 1)
    return out


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """The rank of every entropy: rarest first, the lower at ties; flat ones have none (a value above all ranks)."""
    order = np.lexsort((np.arange(BINS + 1), counts))
    ranks = np.empty(BINS + 1, np.int64)
    ranks[order] = np.arange(BINS + 1)
    ranks[: int(FLAT * BINS)] = BINS + 1
    return ranks


def _features(keys: np.ndarray) -> np.ndarray:
    """Positions that are the least of at least ``POPULAR`` stretches; ``keys`` are ranks with the position below them."""
    n, high = len(keys), np.iinfo(np.int64).max
    least = np.full(n + 2 * (SPAN - 1), high, np.int64)
    least[SPAN - 1 : SPAN - 1 + n] = keys
    width = 1
    while width < SPAN:
        step = min(width, SPAN - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    won = least & 0xFFFFFFFF
    popular = np.bincount(won[least < high], minlength=n)
    return np.flatnonzero((popular >= POPULAR) & (keys >> 32 <= BINS))


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _hash(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every row of bytes."""
    words = np.ascontiguousarray(rows).view("<u8")
    h = np.full(len(rows), 0x27D4EB2F165667C5, np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ (words[:, k] * _ODD[k % 4])) * _ODD[(k + 1) % 4]
        h ^= h >> np.uint64(29)
    return h


def _filters(hashes: np.ndarray) -> str:
    """Chained Bloom filters as hex, joined by colons."""
    _, first = np.unique(hashes, return_index=True)
    kept = hashes[np.sort(first)]
    at = np.stack([(kept >> np.uint64(11 * k)) & np.uint64(BITS - 1) for k in range(5)], 1).astype(np.int64)
    out = []
    for i in range(0, len(kept), PER_FILTER):
        bits = np.zeros(BITS, np.uint8)
        bits[at[i : i + PER_FILTER].ravel()] = 1
        out.append(np.packbits(bits).tobytes().hex())
    return ":".join(out)


def digests(texts: list[bytes], ranks: np.ndarray) -> list[str]:
    """The texts' digests. A text of fewer bytes than a window is one feature, padded with zero bytes; one without bytes has none."""
    out = [""] * len(texts)
    for held, data, starts in blocks(texts):
        bins = entropy_bins(data)
        for i, a, b in zip(held, starts, starts[1:]):
            if b - a >= WINDOW:
                keys = (ranks[bins[a : b - WINDOW + 1]] << 32) | np.arange(b - a - WINDOW + 1)
                chosen = _features(keys)
                if not len(chosen):  # a text of flat windows only: its first window
                    chosen = np.zeros(1, np.int64)
                out[i] = _filters(_hash(np.lib.stride_tricks.sliding_window_view(data[a:b], WINDOW)[chosen]))
            elif b > a:
                row = np.zeros((1, WINDOW), np.uint8)
                row[0, : b - a] = data[a:b]
                out[i] = _filters(_hash(row))
    return out


def likeness(one: str, other: str) -> float:
    """0 to 1. Each filter of the digest with fewer filters takes its best overlap in the other; the mean counts filters by their bits."""
    if one == other:
        return 1.0
    if not one or not other:
        return 0.0
    a, b = ([np.frombuffer(bytes.fromhex(f), np.uint8) for f in x.split(":")] for x in (one, other))
    if len(b) < len(a):
        a, b = b, a
    many = np.stack(b)
    sizes = np.bitwise_count(many).sum(1, dtype=np.int64)
    total = weight = 0.0
    for f in a:
        n = int(np.bitwise_count(f).sum(dtype=np.int64))
        shared = np.bitwise_count(many & f).sum(1, dtype=np.int64)
        chance, most = n * sizes / BITS, np.minimum(n, sizes)
        best = float(np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
        total, weight = total + n * best, weight + n
    return total / weight


def entropy_ranks(docs: DataFrame, column: str = "text") -> np.ndarray:
    """Ranks by how often each entropy occurs in all texts: 1,001 sums, whatever the corpus."""

    def count(batches):
        total = np.zeros(BINS + 1, np.int64)
        for batch in batches:
            total += count_bins([t.encode() for t in batch.column(0).to_pylist() if t])
        yield pa.RecordBatch.from_pydict({"bin": np.flatnonzero(total), "n": total[total > 0]})

    rows = docs.select(text_of(column).alias("t")).mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BINS + 1, np.int64)
    for r in rows:
        counts[r["bin"]] = r["n"]
    return ranks_of(counts)


def fingerprint_documents(docs: DataFrame, ranks: np.ndarray | None = None, key: str = "doc_id") -> DataFrame:
    """Digests of every whole text and of its edited text, and their likeness; also that to the next document.

    The next document is the one with the next lower key (after the last the first; a single document is its
    own next; null keys stand last; rows with equal keys go by their text). The edited text has its last
    floor(n / 2) code points replaced by the next document's first as many, or by all that it has. Rows move
    once, to ranges of the key, where one task reads each range in order; the first row of every range is
    dealt to the range above as well, so no range waits for another.

    ``ranks`` come from ``entropy_ranks`` of these documents unless given; digests compare only under equal
    ranks. Null text counts as empty (empty digest; like an empty text's by 1, any other's by 0). Repeated
    rows each get a row; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias(key), text_of().alias("text"))
    ranks = entropy_ranks(docs) if ranks is None else ranks
    bounds = range_buckets(docs, key, partitions(spark))
    numbered = docs.withColumn("bucket", bucket_of(key, bounds).cast("int"))
    tops = {r["bucket"]: r["top"] for r in docs.select(key, bucket_of(key, bounds).cast("int").alias("bucket")).groupBy("bucket").agg(F.max(key).alias("top")).collect()}  # a number for each range
    down = sorted(tops, reverse=True)
    above = {b: down[i - 1] for i, b in enumerate(down)}  # the lowest range reads the highest one's first row
    count = len(bounds) + 1
    top = F.array(*[F.lit(tops.get(b)).cast("long") for b in range(count)])[F.col("bucket")]
    upper = F.array(*[F.lit(above.get(b, 0)) for b in range(count)])[F.col("bucket")]
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ahead"))
    places = F.when(F.col(key).eqNullSafe(top), F.array(own, F.struct(upper.alias("bucket"), F.lit(True).alias("ahead")))).otherwise(F.array(own))
    dealt = numbered.withColumn("place", F.explode(places)).select(key, "text", "place.bucket", "place.ahead")
    ordered = dealt.repartition(count, "bucket").sortWithinPartitions("bucket", "ahead", F.col(key).desc_nulls_last(), "text")
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    assert bucket_index(None, bounds) == 0

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        """``rows``: key, text, the next one's text."""
        edited = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for _, t, nxt in rows]
        raw = [x.encode() for x in [*(t for _, t, _ in rows), rows[-1][2], *edited]]
        prints, n = digests(raw, ranks), len(rows)
        nexts = [prints[i + 1] if i + 1 == n or rows[i][2] is rows[i + 1][1] else digests([rows[i][2].encode()], ranks)[0] for i in range(n)]
        out = [[k for k, _, _ in rows], [len(t) for _, t, _ in rows], [hashlib.sha256(e).hexdigest() for e in raw[n + 1 :]], prints[:n], prints[n + 1 :]]
        out += [[likeness(a, b) for a, b in zip(prints, prints[n + 1 :])], [likeness(a, b) for a, b in zip(prints, nexts)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    def run(batches):
        last, done, size = None, [], 0  # last: bucket, key, text
        for batch in batches:
            for bucket, ahead, k, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "ahead", key, "text"))):
                if last is not None and last[0] == bucket:
                    done.append((last[1], last[2], text))
                    size += len(last[2])
                last = None if ahead else (bucket, k, text)
                if len(done) >= 64 or size >= 4 * BLOCK:
                    yield finish(done)
                    done, size = [], 0
        if done:
            yield finish(done)

    return ordered.mapInArrow(run, f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
