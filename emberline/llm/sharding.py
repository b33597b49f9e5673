"""Operator 4: rendezvous (highest random weight) sharding of stable record keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import text_of

#: 2^53: a hash is turned into a double in (0, 1) by its upper 53 bits.
UNIT = float(1 << 53)


def _score(key: Column, shard: Column, weight: Column, seed: int) -> Column:
    """Weighted rendezvous score: -weight / ln(u), with u uniform in (0, 1) and decided by (key, shard) alone."""
    hashed = F.shiftrightunsigned(F.xxhash64(key, shard.cast("int"), F.lit(seed)), 11)
    return -weight / F.log((hashed.cast("double") + 0.5) / UNIT)


def rendezvous(key: Column, weights: dict[int, float], seed: int = 7) -> Column:
    """The shard with the highest score for ``key``; equal scores go to the higher shard number.

    Adding a shard moves only keys whose best score is now the new shard's; a heavier shard gets rows in
    proportion to its weight. A null key is hashed as a key of its own kind, so all null keys share a shard.
    """
    shards = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(float(w)).alias("w")) for s, w in sorted(weights.items()) if w > 0])
    return F.array_max(F.transform(shards, lambda x: F.struct(_score(key, x["s"], x["w"], seed).alias("score"), x["s"].alias("shard"))))["shard"]


def shard_documents(docs: DataFrame, shards: int = 40, weights: dict[int, float] | None = None, key: str = "doc_id", rows_per_group: int = 50_000) -> DataFrame:
    """Places every row by its key, with a gapless slot in its shard and the shard under one more shard.

    ``slot`` is a running number: rows of a shard are dealt by hash to numbered groups of about
    ``rows_per_group`` rows, each group is numbered by one task, and a group starts where the one before
    it ends. The groups' counts (``shards`` times groups numbers) are all that is gathered.

    Null text: no bytes, so size 16 and crc 0. Repeated rows keep a slot each. Other columns are ignored.
    An empty table gives an empty result.
    """
    if dict(docs.dtypes)[key] in ("tinyint", "smallint", "int"):  # the same number has the same shard, whatever its type
        docs = docs.withColumn(key, F.col(key).cast("long"))
    weights = weights or dict.fromkeys(range(shards), 1.0)
    new = max(weights) + 1
    grown = weights | {new: sum(weights.values()) / len(weights)}
    raw = F.encode(text_of(), "UTF-8")
    placed = docs.select(F.col(key).alias(key), (F.octet_length(text_of()) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), rendezvous(F.col(key), weights).cast("int").alias("shard"))
    placed = placed.withColumn("grown_shard", F.when(rendezvous(F.col(key), {new: grown[new]} | {s: w for s, w in grown.items()}) == new, F.lit(new)).otherwise(F.col("shard")).cast("int"))
    groups = max(1, -(-docs.count() // (rows_per_group * len(weights))))
    placed = placed.withColumn("_group", F.pmod(F.xxhash64(F.col(key), F.col("text_crc32"), F.lit("slot")), F.lit(groups)).cast("int"))
    order = Window.partitionBy("shard").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "_group").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(order), F.lit(0))).drop("_n")
    within = Window.partitionBy("shard", "_group").orderBy(F.col(key).asc_nulls_first(), "size", "text_crc32")
    numbered = placed.withColumn("_at", F.row_number().over(within) - 1)
    joined = numbered.join(starts, ["shard", "_group"])
    return joined.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_at")).cast("long").alias("slot"), "grown_shard")
