"""Operator 1: near-duplicate groups by b-bit MinHash.

A document is the set of its distinct ``width``-word shingles. Equal sets are one *class* from the start; all
pair work is between classes. Every class gets ``SLOTS`` minima: 25 bands of five of them are its bucket keys,
the low two bits of each are its packed signature.

Of the classes that share a bucket, the shingles that only one of them holds are counted. They bound what two
classes can share, exactly: most copies that have drifted apart need no comparison at all.

Candidates come in two passes, neither of which lists all pairs of a bucket:

1. every member of a bucket is paired with the bucket's lead, the member with the least shingles of its own (of
   a text and its altered copies, the text). Signatures of a pair are compared by bit counts, corrected for
   chance collisions; what may reach the threshold is confirmed on the full sets, and confirmed links give groups;
2. in a bucket whose members fell into several groups, those outside its largest group are compared with the
   members of all other groups, tile by tile, again by bound and signature and then on full sets; a pair is made
   once, in the first bucket that it shares, and only if bound and signature allow it.

A pair inside one group needs no test, so after both passes every pair that shares a bucket has been tested or
is linked already. Two sets at similarity 0.85 share a bucket but for one case in two million.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import components, cut, map_rows, salted_left, text_of, with_rows

SLOTS, ROWS, BANDS, BITS = 128, 5, 25, 2
#: A pair is dropped on its signatures only when the estimate lies this many standard deviations below the threshold.
MARGIN = 5.5

_MASK = 0xFFFFFFFFFFFFFFFF


def _odd(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(i.to_bytes(4, "little"), seed) | 1 for i in range(n)], np.uint64)


_MULTIPLY, _XOR, _BAND, _WORD = _odd(SLOTS, 1), _odd(SLOTS, 2), _odd(SLOTS, 3), _odd(64, 4)


class _Words(dict):
    """Word to its hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def shingles(text: str, width: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles: words are runs of anything but the six ASCII white space characters, A-Z in lower case."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), n)], np.uint64)
    held = _words()
    h = np.fromiter(map(held.__getitem__, words), np.uint64, n)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = (out ^ h[k : n - width + 1 + k]) * _WORD[k]
        out ^= out >> np.uint64(31)
    return np.unique(out)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of every slot's hash over a set."""
    low = np.full(SLOTS, _MASK, np.uint64)
    for i in range(0, len(hashes), 512):  # keeps the products in the processor's cache
        np.minimum(low, ((hashes[i : i + 512, None] ^ _XOR) * _MULTIPLY).min(0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """One bucket key for each band of ``ROWS`` minima."""
    used = (low[: ROWS * BANDS] * _BAND[: ROWS * BANDS]).reshape(BANDS, ROWS)
    key = used[:, 0].copy()
    for k in range(1, ROWS):
        key = (key ^ (key >> np.uint64(29))) * _WORD[k] + used[:, k]
    return (key ^ (np.arange(BANDS, dtype=np.uint64) * _WORD[9])).view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """The minima's low bits, 32 slots to a 64-bit word."""
    bits = (low >> np.uint64(33)) & np.uint64((1 << BITS) - 1)
    return np.bitwise_or.reduce(bits.reshape(-1, 64 // BITS) << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64)


def estimate(a: Column, b: Column) -> Column:
    """The similarity that two packed signatures show: their share of equal slots, less what chance makes equal."""
    odd = 0x5555555555555555
    words = SLOTS * BITS // 64
    differ = [a[i].bitwiseXOR(b[i]) for i in range(words)]
    unequal = sum((F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(odd))) for d in differ[1:]), F.bit_count(differ[0].bitwiseOR(F.shiftrightunsigned(differ[0], 1)).bitwiseAND(F.lit(odd))))
    chance = 2.0**-BITS
    return ((SLOTS - unequal) / float(SLOTS) - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    """Below this an estimate rules a pair out."""
    chance = 2.0**-BITS
    equal = threshold + (1 - threshold) * chance
    return threshold - MARGIN * (equal * (1 - equal) / SLOTS) ** 0.5 / (1 - chance)


def features(docs: DataFrame, key: str, width: int) -> DataFrame:
    """Per document: set size, the set's 128-bit name, bucket keys and signature (null without words)."""

    def rows(r: dict) -> dict:
        out: dict = {key: r[key], "n_shingles": [], "set_id": [], "bands": [], "sig": []}
        for text in r["text"]:
            s = shingles(text, width)
            low = minima(s) if len(s) else None
            out["n_shingles"].append(len(s))
            out["set_id"].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            out["bands"].append(band_keys(low).tolist() if len(s) else None)
            out["sig"].append(packed(low).tolist() if len(s) else None)
        return out

    return map_rows(docs, f"{key} long, n_shingles long, set_id binary, bands array<long>, sig array<long>", rows, lambda: _words().clear())


def _sets(nodes: DataFrame, docs: DataFrame, key: str, width: int) -> DataFrame:
    """The full sets of some classes: set_id, hashes, n (their number), shared (how many another of these classes holds too).

    A shingle that one class alone holds is in no intersection, so ``shared`` bounds what the class can have in
    common with any other: see ``_possible``.
    """
    names = nodes.select(F.col(key).alias("_k")).distinct()
    texts = docs.join(names, F.col(key).eqNullSafe(F.col("_k")), "left_semi")

    def rows(r: dict) -> dict:
        sets = [shingles(t, width) for t in r["text"]]
        return {"set_id": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "hashes": [s.view(np.int64).tolist() for s in sets]}

    found = map_rows(texts, "set_id binary, hashes array<long>", rows, lambda: _words().clear()).join(nodes.select("set_id"), "set_id", "left_semi")
    found = cut(found.dropDuplicates(["set_id"]).withColumn("code", F.monotonically_increasing_id()))  # a short name, fixed once it is written
    counted = found.select("code", F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("code").alias("code"))
    own = counted.where("n = 1").groupBy("code").agg(F.count("*").alias("own"))
    n = F.size("hashes")
    return cut(found.join(own, "code", "left").select("set_id", "hashes", n.alias("n"), (n - F.coalesce("own", F.lit(0))).cast("int").alias("shared")))


def _possible(percent: int, n: Column, shared: Column, m: Column, other: Column) -> Column:
    """Whether two sets of ``n`` and ``m`` shingles, of which ``shared`` and ``other`` are not theirs alone, can be linked."""
    most = F.least(shared, other).cast("long")
    return 100 * most >= percent * (n + m - most)


#: Members that meet one hub in a run, about; a hub with more is dealt to several runs.
_DEALT = 256


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (hub, other) whose full sets share at least ``percent`` of a hundred of their union.

    A hub may be in very many pairs. Its set goes once to each run of about ``_DEALT`` of them, ahead of the others'
    sets, and is held while they pass by; it is on no pair's row.
    """
    counts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / _DEALT).alias("deals"))
    dealt = cut(salted_left(pairs.select("hub", "other"), counts, "hub", "other").select("hub", F.pmod(F.xxhash64("other"), "deals").alias("deal"), "other"))  # read twice
    heads = dealt.select("hub", "deal").distinct().select("hub", "deal", F.lit(None).cast("binary").alias("other"), F.col("hub").alias("set_id"))
    asked = heads.unionByName(dealt.withColumn("set_id", F.col("other")))
    runs = asked.join(sets.select("set_id", "hashes"), "set_id").repartition("hub", "deal").sortWithinPartitions("hub", "deal", F.asc_nulls_first("other"))

    def confirmed(batches):
        x = None
        for batch in batches:
            found = []
            for hub, other, hashes in zip(batch.column("hub"), batch.column("other"), batch.column("hashes")):
                y = hashes.values.to_numpy()
                if not other.is_valid:
                    x = y.copy()
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    found.append((hub.as_py(), other.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], ["a", "b"])

    return runs.select("hub", "other", "hashes").mapInArrow(confirmed, "a binary, b binary")


#: Members of a bucket that are compared with as many others at once.
_TILE = 1_024


def _between(placed: DataFrame, percent: int, least: float) -> DataFrame:
    """Pairs of members of one bucket that are in different groups, one of them outside the bucket's largest, and pass bound and signature: a, b, ra, rb.

    Buckets are dealt into tiles; a task compares the members of two tiles, so a large bucket is many tasks', and a
    pair that fails is never a row.
    """
    sizes = placed.groupBy("bucket").agg(F.ceil(F.count("*") / _TILE).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("set_id"), F.col("tiles")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, "tile").alias("i"), F.greatest(t, "tile").alias("j")))
    held = salted_left(placed, sizes, "bucket", "set_id").withColumn("tile", tile).withColumn("m", F.explode(meets))
    chance = 2.0**-BITS
    odd = np.uint64(0x5555555555555555)

    def compared(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        tiles = table.column("tile").to_numpy()
        left, right = (np.flatnonzero(tiles == t) for t in (i, j))
        ids, bands = table.column("set_id").to_pylist(), np.array(table.column("bands").to_pylist(), np.int64).reshape(-1, BANDS)
        roots, band = np.unique(table.column("root").to_pylist(), return_inverse=True)[1], table.column("band")[0].as_py()
        names = table.column("root").to_pylist()
        sig = np.array(table.column("sig").to_pylist(), np.int64).view(np.uint64)
        n, shared, out = (table.column(c).to_numpy() for c in ("n", "shared", "out"))
        pairs = []
        for k in range(0, len(left), 256):
            x = left[k : k + 256]
            apart = (roots[x][:, None] != roots[right]) & (out[x][:, None] | out[right])
            if i == j:
                apart &= x[:, None] < right
            most = np.minimum(shared[x][:, None], shared[right]).astype(np.int64)
            apart &= 100 * most >= percent * (n[x][:, None].astype(np.int64) + n[right] - most)
            p, q = np.nonzero(apart)
            p, q = x[p], right[q]
            differ = sig[p] ^ sig[q]
            unequal = np.bitwise_count((differ | (differ >> np.uint64(1))) & odd).sum(1)
            near = ((SLOTS - unequal.astype(float)) / SLOTS - chance) / (1 - chance) >= least
            p, q = p[near], q[near]
            first = ~(bands[p, :band] == bands[q, :band]).any(1)  # in the first bucket that both are in
            pairs += zip(p[first].tolist(), q[first].tolist())
        rows = [(min((ids[p], p), (ids[q], q)) + max((ids[p], p), (ids[q], q))) for p, q in pairs]
        columns = [[r[0] for r in rows], [r[2] for r in rows], [min(names[r[1]], names[r[3]]) for r in rows], [max(names[r[1]], names[r[3]]) for r in rows]]
        return pa.table([pa.array(c, pa.binary()) for c in columns], names=["a", "b", "ra", "rb"])

    return held.select("bucket", "m.i", "m.j", "tile", "set_id", "root", "sig", "n", "shared", "bands", "band", "out").groupBy("bucket", "i", "j").applyInArrow(compared, "a binary, b binary, ra binary, rb binary")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, key: str = "doc_id") -> DataFrame:
    """Groups of documents linked by 100 * shared shingles >= ``percent`` * shingles of either.

    Returns per row: key, n_shingles, component_id (the least key that can be reached, its own included),
    kept (key = component_id). Null and empty texts, and texts of white space, have no shingles and are linked
    with nothing; a text of fewer than ``width`` words is one shingle. Repeated rows are in one group. A null
    key is never a component's name while another member has one. Other columns are ignored; an empty table
    gives an empty result.
    """
    docs = docs.select(F.col(key).cast("long").alias(key), text_of().alias("text"))
    found = cut(features(docs, key, width))
    nodes = cut(found.where("set_id is not null").dropDuplicates(["set_id"]).select(key, "set_id", "bands", "sig", F.monotonically_increasing_id().alias("code")))
    rows = nodes.select("code", F.explode("bands").alias("bucket"))
    buckets = cut(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"))
    met = rows.join(buckets, "bucket").select("code").distinct()
    sets = _sets(nodes.join(met, "code", "left_semi"), docs, key, width)
    able = sets.where(_possible(percent, F.col("n"), F.col("shared"), F.col("shared"), F.col("shared"))).select("set_id", "n", "shared")
    wide = cut(nodes.join(able, "set_id").select("set_id", "sig", "n", "shared", "bands"))
    members = cut(wide.select("set_id", "sig", "n", "shared", F.posexplode("bands").alias("band", "bucket")).join(buckets, "bucket"))
    least = least_estimate(percent / 100)
    near = lambda a, b: _possible(percent, F.col(f"{a}n"), F.col(f"{a}shared"), F.col(f"{b}n"), F.col(f"{b}shared")) & (estimate(F.col(f"{a}sig"), F.col(f"{b}sig")) >= least)

    # pass 1: every member and its bucket's lead, the one that holds the least of its own
    best = F.max(F.struct((F.col("shared") / F.col("n")).alias("share"), "set_id", "sig", "n", "shared")).alias("l")
    leads = members.groupBy("bucket").agg(best).select("bucket", *[F.col(f"l.{c}").alias(f"l_{c}") for c in ("set_id", "sig", "n", "shared")])
    star = members.join(leads, "bucket").where((F.col("set_id") != F.col("l_set_id")) & near("", "l_"))
    ends = star.select(F.least("set_id", "l_set_id").alias("a"), F.greatest("set_id", "l_set_id").alias("b"), F.col("l_set_id").alias("hub"), F.col("set_id").alias("other"))
    tested = cut(ends.groupBy("a", "b").agg(F.max(F.struct("hub", "other")).alias("h")).select("a", "b", "h.*"))
    first = cut(_confirm(tested.select("hub", "other"), sets, percent))
    roots = components(first)

    # pass 2: members outside the largest group of their bucket
    placed = members.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    groups = placed.groupBy("bucket", "root").agg(F.count("*").alias("m"))
    mixed = groups.groupBy("bucket").agg(F.count("*").alias("groups"), F.max(F.struct("m", "root"))["root"].alias("main")).where("groups > 1").drop("groups")
    placed = cut(placed.join(mixed, "bucket").withColumn("out", F.col("root") != F.col("main")))
    # a class is in at most BANDS buckets: its numbers and bands are fetched once, not for each of them
    buckets_of = placed.groupBy("set_id").agg(F.collect_list(F.struct("bucket", "root", "out", "band")).alias("at"))
    placed = cut(wide.join(buckets_of, "set_id").withColumn("x", F.explode("at")).select("set_id", "sig", "n", "shared", "bands", "x.*"))
    pairs = cut(_between(placed, percent, least).dropDuplicates(["a", "b"]).join(tested, ["a", "b"], "left_anti"))
    second = cut(_confirm(pairs.select(F.col("a").alias("hub"), F.col("b").alias("other")), sets, percent).join(pairs, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    if not second.isEmpty():
        upper = components(second).select(F.col("node").alias("root"), F.col("root").alias("top"))
        lifted = salted_left(roots, upper, "root", "node").select("node", F.coalesce("top", "root").alias("root"))
        alone = upper.select(F.col("root").alias("node"), F.col("top").alias("root")).join(roots.select("node"), "node", "left_anti")
        roots = cut(lifted.union(alone))

    # only classes that are linked have a root; each takes its group's least key
    classes = found.where("set_id is not null").groupBy("set_id").agg(F.min(key).alias("low"))
    linked = cut(classes.join(roots.withColumnRenamed("node", "set_id"), "set_id"))
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    named = classes.join(salted_left(linked, lows, "root", "set_id").select("set_id", "component_id"), "set_id", "left").select("set_id", F.coalesce("component_id", "low").alias("component_id"))
    out = salted_left(found.select(key, "n_shingles", "set_id"), named, "set_id", key)
    return out.select(key, "n_shingles", F.coalesce("component_id", key).alias("component_id"), F.coalesce(F.coalesce("component_id", key) == F.col(key), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80, width: int = 5, key: str = "doc_id") -> DataFrame:
    """``docs`` without all but one row of each group: the one with the least key (null ones last). All columns stay.

    Rows are named one by one, so a null or repeated key decides for no other row; of rows alike in key and text the
    one stays whose other columns have the least digest, and one of those that are alike in all.
    """
    named, row = with_rows(docs)
    groups = cut(near_duplicates(named, percent, width, row).select(F.col(row).alias("_row"), "component_id"))
    keys = named.select(F.col(row).alias("_row"), F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(text_of()).alias("hash"), F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])), 256).alias("rest"))
    best = groups.join(keys, "_row").groupBy("component_id").agg(F.min(F.struct("none", "key", "hash", "rest", "_row"))["_row"].alias("_row"))
    return named.join(best.select(F.col("_row").alias(row)), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
