"""Operator 13: near-duplicate groups by SimHash and a hierarchical index in Gray order.

Equal fingerprints are one *class* from the start. Two fingerprints that differ in at most four of 64 bits are
equal in two of six blocks of bits at least, so for each of the 15 choices of two blocks every fingerprint gets
one row: its bits with the chosen blocks first, as a rank in Gray order. Spark sorts these rows by range, so
neighbours in a sorted run differ in few bits, fingerprints with equal chosen blocks (a *cell*) lie side by side,
and a cell of any size is spread over as many tasks as it fills.

Tasks read sorted runs. Over a cell they build the index: leaves of consecutive fingerprints, nodes of
consecutive leaves, each with the masked bit pattern that all below it share, less what the nodes above it have
already. A search goes down from the top, adds up the differences that the patterns show, and drops a whole
group once the sum is above the limit, or once the group is linked to the searched fingerprint already. Only as
many links as join a cell's groups leave a task, never all pairs.

A cell that goes on over the end of a run leaves *slices* with their shared pattern. Slices of one cell that come
from different runs are compared by their patterns first, and then by the same index.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import components, cut, map_rows, partitions, salted_left, text_of, unite

#: Links have at most so many differing bits; so many blocks of bits, of which two at least are then equal.
LIMIT, WIDTHS = 4, (11, 11, 11, 11, 10, 10)
#: Fingerprints under one node of the index, rows of a sorted run that are held at once, fingerprints of a slice.
FAN, RUN, SLICE = 16, 65_536, 4_096

_CHOICES = tuple(combinations(range(len(WIDTHS)), len(WIDTHS) - LIMIT))
_SHIFTS = tuple(64 - sum(WIDTHS[: i + 1]) for i in range(len(WIDTHS)))
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_TEXT_BLOCK = 1 << 22


# -- fingerprints ----------------------------------------------------------------------------------------------------
def _word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, block by block, so that a very long text is never a list of all its words."""
    at = 0
    while at < len(data):
        end = len(data)
        if at + _TEXT_BLOCK < end:
            found = _SPACE.search(data, at + _TEXT_BLOCK)
            end = found.start() if found else end
        yield data[at:end].lower().split()
        at = end


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64, seed 42, of every run of ``width`` words joined by spaces."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    of = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    return np.fromiter((of(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())), np.uint64, n)


def simhash(text: str, width: int = 4) -> int:
    """A bit is 1 if it is set in over half the hashes of the text's shingles, repeats included; 0 without words."""
    total, counts, carry = 0, np.zeros(64, np.int64), []
    for words in _word_blocks(text.encode()):
        words = carry + words
        if len(words) >= width:
            h = _hashes(words, width)
            for i in range(0, len(h), 4_096):
                bits = np.unpackbits(h[i : i + 4_096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                counts += bits.sum(axis=0, dtype=np.uint16)
            total += len(h)
            carry = words[len(words) - width + 1 :]
        else:
            carry = words
    if not total and carry:
        return xxhash.xxh64_intdigest(b" ".join(carry), 42)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0]) if total else 0


def fingerprints(docs: DataFrame, key: str, width: int) -> DataFrame:
    """Per document: key and fingerprint, as a signed number."""

    def rows(r: dict) -> dict:
        return {key: r[key], "fp": [(f := simhash(t, width)) - ((f >> 63) << 64) for t in r["text"]]}

    return map_rows(docs, f"{key} long, fp long", rows)


# -- the order -------------------------------------------------------------------------------------------------------
def _order(choice: int) -> tuple[int, ...]:
    first = _CHOICES[choice]
    return first + tuple(b for b in range(len(WIDTHS)) if b not in first)


def gray_rank(fp: np.ndarray, choice: int) -> np.ndarray:
    """The place in Gray order of fingerprints whose chosen blocks come first."""
    out = np.zeros(len(fp), np.uint64)
    for b in _order(choice):
        out = (out << np.uint64(WIDTHS[b])) | ((fp >> np.uint64(_SHIFTS[b])) & np.uint64((1 << WIDTHS[b]) - 1))
    for step in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(step)
    return out


def from_rank(rank: np.ndarray, choice: int) -> np.ndarray:
    """The fingerprints at places in Gray order."""
    bits, at, out = rank ^ (rank >> np.uint64(1)), 64, np.zeros(len(rank), np.uint64)
    for b in _order(choice):
        at -= WIDTHS[b]
        out |= ((bits >> np.uint64(at)) & np.uint64((1 << WIDTHS[b]) - 1)) << np.uint64(_SHIFTS[b])
    return out


def _cell(rank: np.ndarray, choice: int) -> np.ndarray:
    """What fingerprints with equal chosen blocks have in common: the head of their rank."""
    return rank >> np.uint64(64 - sum(WIDTHS[b] for b in _CHOICES[choice]))


# -- the index -------------------------------------------------------------------------------------------------------
class Index:
    """Fingerprints in Gray order under nodes of ``FAN``; every node holds the bits that all below it share and the nodes above it lack."""

    def __init__(self, values: np.ndarray):
        self.values, self.levels = values, []
        every, some, reach = values, values, 1
        while len(every) > FAN or not self.levels:
            heads = np.arange(0, len(every), FAN)
            every, some = np.bitwise_and.reduceat(every, heads), np.bitwise_or.reduceat(some, heads)
            reach *= FAN
            self.levels.append([every | ~some, every, reach])  # mask, pattern, members
        self.levels.reverse()
        above = np.zeros(1, np.uint64)
        for i, (mask, pattern, reach) in enumerate(self.levels):
            parent = above[np.arange(len(mask)) // FAN] if i else np.zeros(len(mask), np.uint64)
            self.levels[i] = (mask & ~parent, pattern, reach)
            above = mask
        self.rest = ~above[np.arange(len(values)) // FAN]  # what no node says of a member

    def search(self, queries: np.ndarray, places: np.ndarray, root: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, member) at ``LIMIT`` or less. ``root``: groups of queries (at ``mine``) and members (at ``places``); pairs of one group are left out."""
        at, node, low, high = None, None, root[places], root[places]
        bounds = []
        for _, pattern, _ in reversed(self.levels):
            heads = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads)
            bounds.append((low, high))
        own = root[mine]
        for (mask, pattern, _), (low, high) in zip(self.levels, reversed(bounds)):
            if at is None:
                at, node = (v.ravel() for v in np.meshgrid(np.arange(len(queries)), np.arange(len(mask)), indexing="ij"))
                seen = np.zeros(len(at), np.uint8)
            else:
                at, node, seen = self._below(at, node, seen, len(mask))
            seen = seen + np.bitwise_count((queries[at] ^ pattern[node]) & mask[node])
            keep = (seen <= LIMIT) & ~((low[node] == high[node]) & (low[node] == own[at]))
            at, node, seen = at[keep], node[keep], seen[keep]
        at, node, seen = self._below(at, node, seen, len(self.values))
        near = seen + np.bitwise_count((queries[at] ^ self.values[node]) & self.rest[node]) <= LIMIT
        return at[near], node[near]

    @staticmethod
    def _below(at: np.ndarray, node: np.ndarray, seen: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        child = (node[:, None] * FAN + np.arange(FAN)).ravel()
        inside = child < count
        return np.repeat(at, FAN)[inside], child[inside], np.repeat(seen, FAN)[inside]


def join(queries: np.ndarray, mine: np.ndarray, members: np.ndarray, places: np.ndarray, root: np.ndarray) -> None:
    """Unites in ``root`` what lies within ``LIMIT`` between queries (at ``mine``) and members (at ``places``)."""
    index = Index(members)
    step = max(16, (1 << 21) // max(len(members), 1))
    for i in range(0, len(queries), step):
        at, found = index.search(queries[i : i + step], places, root, mine[i : i + step])
        unite(root, mine[i : i + step][at], places[found])


def link_run(values: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The groups within each cell of a sorted run: every fingerprint's least fellow."""
    root = np.arange(len(values))
    heads = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    sizes = np.diff(np.concatenate([heads, [len(values)]]))
    small = np.repeat(sizes <= FAN, sizes)
    for step in range(1, FAN):  # cells that one leaf holds
        if step >= len(values):
            break
        near = small[step:] & (cells[step:] == cells[:-step]) & (np.bitwise_count(values[step:] ^ values[:-step]) <= LIMIT)
        found = np.flatnonzero(near)
        unite(root, found, found + step)
    for head, size in zip(heads[sizes > FAN].tolist(), sizes[sizes > FAN].tolist()):
        places = np.arange(head, head + size)
        join(values[places], places, values[places], places, root)
    return root


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("choice", pa.int32()), ("cell", pa.int64()), ("run", pa.int64()), ("slice", pa.int32()), ("mask", pa.int64()), ("pattern", pa.int64()), ("members", pa.binary()), ("roots", pa.binary())])
_FOUND_DDL = "a long, b long, choice int, cell long, run long, slice int, mask long, pattern long, members binary, roots binary"


def _found(choice: int, rank: np.ndarray, run: int) -> Iterator[pa.RecordBatch]:
    """Links within a run of one choice, and the slices of its first and last cell, which other runs may go on with."""
    cells, values = _cell(rank, choice), from_rank(rank, choice)
    root = link_run(values, cells)
    linked = np.flatnonzero(root != np.arange(len(root)))
    pairs = {"a": values[root[linked]].view(np.int64), "b": values[linked].view(np.int64)}
    yield pa.RecordBatch.from_pydict(pairs | {f.name: pa.nulls(len(linked), f.type) for f in list(_FOUND)[2:]}, schema=_FOUND)
    slices: list[dict] = []
    for cell in dict.fromkeys((int(cells[0]), int(cells[-1]))):
        held = np.flatnonzero(cells == cell)
        for i in range(0, len(held), SLICE):
            v = values[held[i : i + SLICE]]
            every, some = np.bitwise_and.reduce(v), np.bitwise_or.reduce(v)
            mask, pattern = (int(np.array([x]).view(np.int64)[0]) for x in (every | ~some, every))
            slices.append({"a": None, "b": None, "choice": choice, "cell": cell, "run": run, "slice": i // SLICE, "mask": mask, "pattern": pattern, "members": v.tobytes(), "roots": values[root[held[i : i + SLICE]]].tobytes()})
    yield pa.RecordBatch.from_pylist(slices, schema=_FOUND)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (choice, rank) in runs of at most ``RUN``."""
    choice, rank, done = np.zeros(0, np.int64), np.zeros(0, np.uint64), 0
    partition = TaskContext.get().partitionId()

    def closed(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal choice, rank, done
        while len(rank) >= RUN or (last and len(rank)):
            n = min(RUN, len(rank), int(np.searchsorted(choice, choice[0], "right")))
            yield from _found(int(choice[0]), rank[:n], partition << 32 | done)
            choice, rank, done = choice[n:], rank[n:], done + 1

    for batch in batches:
        choice = np.concatenate([choice, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)])
        rank = np.concatenate([rank, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63)])
        yield from closed(False)
    yield from closed(True)


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every fingerprint's rank under every choice; the sign bit is turned, so that signed order is the order of ranks."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for choice in range(len(_CHOICES)):
            rank = (gray_rank(fp, choice) ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), choice, np.int32)), pa.array(rank)], ["choice", "rank"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the groups of two slices."""
    for batch in batches:
        a, b = [], []
        for row in batch.to_pylist():
            x, rx, y, ry = (np.frombuffer(row[c], np.uint64) for c in ("x", "rx", "y", "ry"))
            names, place = np.unique(np.concatenate([x, y, rx, ry]), return_inverse=True)
            root = np.arange(len(names))
            px, py, prx, pry = np.split(place, np.cumsum([len(x), len(y), len(rx)]))
            unite(root, np.concatenate([px, py]), np.concatenate([prx, pry]))
            before = root.copy()
            join(x, px, y, py, root)
            moved = np.flatnonzero((before == np.arange(len(root))) & (root != before))  # one link for each group that joined another
            a += names[root[moved]].view(np.int64).tolist()
            b += names[moved].view(np.int64).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) whose connected groups are those of all pairs of different fingerprints at ``LIMIT`` or less; ``fps``: distinct ``fp``."""
    spark = fps.sparkSession
    rows = cut(fps.select("fp").mapInArrow(_ranked, "choice int, rank long"))  # sorted below, once for the bounds and once for the rows
    runs = rows.repartitionByRange(partitions(spark), "choice", "rank").sortWithinPartitions("choice", "rank")
    found = cut(runs.mapInArrow(_runs, _FOUND_DDL))
    inside = found.where("choice is null").select("a", "b")
    slices = found.where("choice is not null").withColumn("name", F.struct("choice", "run", "slice", "cell"))
    head = lambda x: slices.select("choice", "cell", F.col("run").alias(f"{x}run"), F.col("name").alias(f"{x}name"), F.col("mask").alias(f"{x}mask"), F.col("pattern").alias(f"{x}pattern"))
    apart = F.bit_count(F.col("xpattern").bitwiseXOR(F.col("ypattern")).bitwiseAND(F.col("xmask")).bitwiseAND(F.col("ymask")))
    met = cut(head("x").join(head("y"), ["choice", "cell"]).where((F.col("xrun") < F.col("yrun")) & (apart <= LIMIT)).select("xname", "yname"))
    full = lambda x: slices.select(F.col("name").alias(f"{x}name"), F.col("members").alias(x), F.col("roots").alias(f"r{x}"))
    both = met.join(full("x"), "xname").join(full("y"), "yname").select("x", "rx", "y", "ry")
    return inside.union(both.mapInArrow(_across, "a long, b long"))


# -- the operator ----------------------------------------------------------------------------------------------------
def near_duplicates(docs: DataFrame, width: int = 4, key: str = "doc_id") -> DataFrame:
    """Groups of documents whose fingerprints differ in at most ``LIMIT`` bits, directly or through others.

    Returns per row: key, fingerprint (16 hexadecimal digits), component_id (the least key that can be reached, its
    own included). A text of fewer than ``width`` words is one shingle; null and empty texts, and texts of white
    space, have fingerprint zero, which is linked like any other. Repeated rows are in one group. A null key is
    never a component's name while another member has one. Other columns are ignored; an empty table gives an
    empty result.
    """
    docs = docs.select(F.col(key).cast("long").alias(key), text_of().alias("text"))
    found = cut(fingerprints(docs, key, width))
    classes = cut(found.groupBy("fp").agg(F.min(key).alias("low")))
    roots = components(links(classes)).withColumnRenamed("node", "fp")
    linked = cut(classes.join(roots, "fp"))
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    named = salted_left(linked, lows, "root", "fp").select("fp", "component_id")
    every = cut(classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")))
    return salted_left(found, every, "fp", key).select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
