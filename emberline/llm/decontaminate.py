"""Operator 7: benchmark passages in documents, by the q-gram lemma.

An item of m characters with at most e edits in a document shares at least m - q + 1 - e * q of its q-grams
with it, all on diagonals (place in the document less place in the item) no further apart than e. So the hits
of an item's q-grams are counted in diagonal bands of 2 * (e + 1), each overlapping the next by half; only the
regions of bands that reach the bound are aligned with the item, within the band, and kept at e edits or fewer.

``Q`` characters make a gram unless that leaves an item no bound of 1: then its grams are shorter, floor(m / (e + 1))
characters, which is the whole item where no edit is allowed. So every item has its full budget, however short.
"""

from __future__ import annotations

import pickle
import uuid
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import cut, shared_folder, text_of, with_rows

#: Characters of a q-gram, and edits allowed as a share of an item's characters.
Q, EDITS = 8, 0.08
#: Items are used in blocks of about so many characters; documents are gathered up to so many for each pass over the blocks.
BLOCK_CHARS, PASS_CHARS = 4_000_000, 32_000_000
#: Documents are taken together up to about so many characters; longer ones in pieces of as many, which overlap by the longest item.
TOGETHER = 1 << 17
#: Hits of grams are counted so many at a time.
HITS = 1 << 20
_TABLE = 22
_STEP = np.uint64(0x9E3779B97F4A7C15)


def characters(text: str) -> np.ndarray:
    """Code points, letters in lower case where that is one character, white space as the space."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    out = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where((out >= 9) & (out <= 13), np.uint32(32), out)


def budget(m: int) -> tuple[int, int]:
    """The edits that an item of ``m`` characters may have, and the characters of its grams."""
    edits = int(EDITS * m)
    return edits, min(Q, m // (edits + 1))


def grams(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """The hash of every q-gram."""
    n = max(0, len(chars) - q + 1)
    out = np.zeros(n, np.uint64)
    for k in range(q):
        out = (out + chars[k : k + n]) * _STEP
        out ^= out >> np.uint64(32)
    return out


class Items:
    """A block of benchmark items, in parts by the length of their grams."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        groups: dict[int, list] = {}
        for item, text in items:
            c = characters(text.strip())
            if len(c):
                groups.setdefault(budget(len(c))[1], []).append((item, c))
        self.parts = [_Part(q, held) for q, held in sorted(groups.items())]

    def find(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text its matches: item, start, end, edits."""
        found: list[dict] = [{} for _ in texts]
        if self.parts:
            longest = max(int((p.size + p.edits).max()) for p in self.parts)
            held, size = [], 0
            for i, text in enumerate(texts):
                chars, at = characters(text), 0
                while True:  # a piece, and what an item that begins in it may reach beyond
                    held.append((i, at, chars[at : at + TOGETHER + longest]))
                    size += len(held[-1][2])
                    at += TOGETHER
                    last = at >= len(chars)
                    if size >= TOGETHER or (last and i == len(texts) - 1):
                        for part in self.parts:
                            part.find(held, found)
                        held, size = [], 0
                    if last:
                        break
        return [[(part.ids[o], *x) for (part, o), spans in sorted(f.items(), key=lambda e: (e[0][0].q, e[0][1])) for x in least(spans)] for f in found]


def least(spans: set) -> list[tuple[int, int, int]]:
    """Of overlapping places the one with fewest edits (the first at ties), in order."""
    kept: list[tuple[int, int, int]] = []
    starts: list[int] = []
    for s, t, edits in sorted(spans, key=lambda x: (x[2], x[0], x[1])):
        at = bisect_left(starts, s)
        if (at == 0 or kept[at - 1][1] <= s) and (at == len(kept) or kept[at][0] >= t):
            kept.insert(at, (s, t, edits))
            starts.insert(at, s)
    return kept


class _Part:
    """Items whose grams have ``q`` characters, with the places of every gram."""

    def __init__(self, q: int, items: list[tuple[int, np.ndarray]]) -> None:
        self.q, self.ids, self.chars = q, [i for i, _ in items], [c for _, c in items]
        made = [grams(c, q) for c in self.chars]
        self.size = np.array([len(c) for c in self.chars], np.int64)
        self.edits = np.array([budget(len(c))[0] for c in self.chars], np.int64)
        self.bound = self.size - q + 1 - self.edits * q
        all_hashes = np.concatenate(made)
        order = np.argsort(all_hashes, kind="stable")
        self.owner = np.repeat(np.arange(len(made), dtype=np.int64), [len(h) for h in made])[order]
        self.place = np.concatenate([np.arange(len(h), dtype=np.int64) for h in made])[order]
        self.hashes, self.first, self.count = np.unique(all_hashes[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _TABLE, bool)
        self.seen[(all_hashes >> np.uint64(64 - _TABLE)).astype(np.int64)] = True

    def hits(self, at: np.ndarray, k: np.ndarray, low: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells (item * width + cell) and their numbers of hits, for grams ``k`` at places ``at``; expanded ``HITS`` at a time."""
        n = self.count[k]
        upto = np.cumsum(n)
        keys, sums, i = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + HITS, "right")))
            m = n[i:j]
            posting = np.repeat(self.first[k[i:j]], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            item = self.owner[posting]
            cell = (np.repeat(at[i:j], m) - self.place[posting]) // (self.edits[item] + 1)
            key, hits = np.unique(item * width + (cell - low), return_counts=True)
            both = np.concatenate([keys, key])
            if len(keys):
                both, where = np.unique(both, return_inverse=True)
                sums = np.bincount(where, np.concatenate([sums, hits]), len(both)).astype(np.int64)
            else:
                sums = hits
            keys, i = both, j
        return keys, sums

    def find(self, held: list[tuple[int, int, np.ndarray]], out: list[dict]) -> None:
        """Adds the places in pieces (text, its first character's place, characters) to ``out``, text by text."""
        starts = np.cumsum([0, *(len(c) for _, _, c in held)])
        chars = np.concatenate([c for _, _, c in held])
        h = grams(chars, self.q)
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - _TABLE)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        real = self.hashes[k] == h[at]
        at, k = at[real], k[real]
        if not len(at):
            return
        low = -int(self.size.max()) - 1  # diagonals may begin before the first document
        width = len(chars) - low + 2
        key, hits = self.hits(at, k, low, width)
        owner, cells = key // width, key % width + low
        next_hits, last_hits = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        follows = np.flatnonzero(key[1:] == key[:-1] + 1)
        next_hits[follows], last_hits[follows + 1] = hits[follows + 1], hits[follows]
        # a band is a cell and the next one; a cell counts with its neighbour on either side
        bands = {(int(owner[x]), int(cells[x])) for x in np.flatnonzero(hits + next_hits >= self.bound[owner])}
        bands |= {(int(owner[x]), int(cells[x]) - 1) for x in np.flatnonzero(hits + last_hits >= self.bound[owner])}
        for o, c in sorted(bands):
            e, m = int(self.edits[o]), int(self.size[o])
            first, last = c * (e + 1) - e, (c + 2) * (e + 1) + m + e
            for d in range(max(0, int(np.searchsorted(starts, max(first, 0), "right")) - 1), len(held)):
                if starts[d] >= last:
                    break
                a, b = max(first, int(starts[d])), min(last, int(starts[d + 1]))
                if b - a >= m - e and (match := align(self.chars[o], chars[a:b], e)):
                    s, t, edits = match
                    text, shift = held[d][0], held[d][1] + a - int(starts[d])
                    out[text].setdefault((self, o), set()).add((s + shift, t + shift, edits))


def _band(item: np.ndarray, text: np.ndarray, low: int, high: int, free: bool) -> np.ndarray:
    """Edit distances of the whole item to stretches of text that end on diagonals ``low`` to ``high``; ``free``: they may begin anywhere."""
    big, at = 1 << 20, np.arange(high - low + 1)
    cost = np.where(at + low >= 0, 0 if free else at + low, big)
    cost = np.where(at + low > len(text), big, cost)
    padded = np.full(len(item) + len(text) + len(at) + 2 * abs(low) + 2, 0xFFFFFFFF, np.uint32)
    padded[abs(low) : abs(low) + len(text)] = text
    for i in range(len(item)):
        same = padded[abs(low) + low + i :][: len(at)] != item[i]
        new = cost + same
        new[:-1] = np.minimum(new[:-1], cost[1:] + 1)
        inside = (at + low + i + 1 >= 0) & (at + low + i + 1 <= len(text))
        new = np.where(inside, new, big)
        cost = np.minimum(np.minimum.accumulate(new - at) + at, big)
        cost = np.where(inside, cost, big)
    return cost


def align(item: np.ndarray, text: np.ndarray, edits: int) -> tuple[int, int, int] | None:
    """The stretch of ``text`` nearest to the item (start, end, edits), if that is within ``edits``."""
    m = len(item)
    high = max(0, len(text) - m) + edits
    cost = _band(item, text, -edits, high, True)
    best = int(cost.argmin())
    if cost[best] > edits:
        return None
    end = m + best - edits
    back = _band(item[::-1], text[:end][::-1], -edits, edits, False)
    return end - (m + int(back.argmin()) - edits), end, int(cost[best])


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """A row for every place where a document holds a benchmark item: key, item, start, end (code points), edits.

    Edits are at most ``EDITS`` of the item's characters, rounded down; an item too short for one edit is found
    exactly (letters in any case, any white space for a space), within words too. White space at an item's ends is
    no part of it; null items and those of white space match nothing; null and empty texts hold nothing. Of
    overlapping places of one item the one with the fewest edits is given. Repeated rows each give their rows; items
    with equal texts each give theirs. Other columns are ignored; with an empty table on either side the result is
    empty.

    The items are measured first. Up to ``BLOCK_CHARS`` characters of them are sent to the executors; more are dealt
    by their hash into blocks of about that size (a longer item lies in one of them whole), which tasks build and
    keep in the shared folder. The documents are read once either way and never move: a task gathers ``PASS_CHARS``
    characters of them and takes one block after the other over these, so it holds one block, and neither the driver
    nor any broadcast holds items beyond one block.
    """
    items = benchmark.select(F.col(item).cast("long").alias(item), text_of().alias("t")).where(F.length("t") > 0)
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    count = max(1, -(-2 * total // BLOCK_CHARS)) if total > BLOCK_CHARS else 1
    texts = docs.select(F.col(key).cast("long").alias(key), text_of().alias("text"))
    schema = pa.schema([(key, pa.int64()), (item, pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])
    placed = items.withColumn("_block", F.pmod(F.xxhash64(item, "t"), F.lit(count)).cast("int"))

    def rows(keys: list, found: list) -> pa.RecordBatch:
        made = [(k, *m) for k, ms in zip(keys, found) for m in ms]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made) if made else [[]] * 5, schema)], schema=schema)

    if count == 1:
        sent = docs.sparkSession.sparkContext.broadcast(Items([(r[0], r[1]) for r in items.collect()]))  # at most BLOCK_CHARS characters

        def run(batches):
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    yield rows(batch.column(0)[i : i + 512].to_pylist(), sent.value.find(batch.column(1)[i : i + 512].to_pylist()))

        return texts.mapInArrow(run, f"{key} long, {item} long, start long, end long, edits long")

    folder = f"{shared_folder(docs.sparkSession)}/items-{uuid.uuid4().hex}"

    def keep(table: pa.Table) -> pa.Table:
        system, place = fs.FileSystem.from_uri(folder)
        system.create_dir(place, recursive=True)
        block = table.column("_block")[0].as_py()
        staged = f"{place}/.{block}-{uuid.uuid4().hex}"
        with system.open_output_stream(staged) as f:
            f.write(pickle.dumps(Items(list(zip(table.column(item).to_pylist(), table.column("t").to_pylist())))))
        system.move(staged, f"{place}/{block}")
        return pa.table({"block": pa.array([block], pa.int32())})

    kept = sorted(r[0] for r in placed.groupBy("_block").applyInArrow(keep, "block int").collect())  # a number for each block

    def passes(batches):
        system, place = fs.FileSystem.from_uri(folder)
        keys, held, size, last, block = [], [], 0, -1, None

        def found():
            nonlocal last, block
            for k in kept if last != kept[-1] else kept[::-1]:  # the block at hand is taken first
                if k != last:
                    block = None  # one at a time
                    with system.open_input_stream(f"{place}/{k}") as f:
                        last, block = k, pickle.loads(f.read())
                for i in range(0, len(keys), 512):
                    yield rows(keys[i : i + 512], block.find(held[i : i + 512]))

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                keys += batch.column(0)[i : i + 512].to_pylist()
                new = batch.column(1)[i : i + 512].to_pylist()
                held += new
                size += sum(map(len, new))
                if size >= PASS_CHARS:
                    yield from found()
                    keys, held, size = [], [], 0
        if keys:
            yield from found()

    return texts.mapInArrow(passes, f"{key} long, {item} long, start long, end long, edits long")


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, whatever their keys; all columns stay."""
    named, row = with_rows(docs)
    bad = cut(contamination(named, benchmark, row).select(row).distinct())
    return named.join(bad, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
