"""Shapes that many operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def as_of(df: DataFrame, cutoff: str, column: str = "acq_date") -> DataFrame:
    """Rows up to a date: the one guard against looking ahead."""
    return df.where(F.col(column) <= F.lit(cutoff).cast("date"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    A local one is made only where none is set and the master is local, as in tests; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="emberline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it from there, so what follows never repeats its work, whichever executor is lost.

    A written table has a known size, so Spark broadcasts it in a join only below its own threshold.
    """
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/cut-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    _cuts.append(place)
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


#: What ``cut`` has written in this process, in order.
_cuts: list[str] = []


def cuts_made() -> int:
    """A mark for ``drop_cuts``."""
    return len(_cuts)


def drop_cuts(spark: SparkSession, since: int, keep: int = 1) -> int:
    """Deletes what was cut after a mark but for the last ``keep``, once nothing reads it any more; how many."""
    gone = _cuts[since : len(_cuts) - keep]
    for place in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _cuts[since : len(_cuts) - keep]
    return len(gone)


def clear_cuts(spark: SparkSession) -> int:
    """Deletes what ``cut`` has written in this application, once its results are written elsewhere; the number of tables."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/cut-{spark.sparkContext.applicationId}-*")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.globStatus(path) or []
    for status in found:
        system.delete(status.getPath(), True)
    return len(found)


#: Copies of a small side that is joined on a key which very many rows of the other side may share.
SALTS = 8


def salted_left(left: DataFrame, right: DataFrame, on: str, spread: str) -> DataFrame:
    """A left join on a key that may be hot on the left and is unique on the right: left rows are dealt by ``spread`` to copies of the right ones."""
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    copies = right.withColumn("_salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    return dealt.join(copies, [on, "_salt"], "left").drop("_salt")


#: What is left of a graph is finished by one task once it has at most so many edges.
FEW_EDGES = 200_000


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of ``a`` and ``b``, pair by pair; ``root`` holds every member's least member."""
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def _finished(pairs: DataFrame) -> DataFrame:
    """Every node that isn't its component's least one, with that one; all of a small graph in one task."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(frames):
        both = pd.concat(list(frames), ignore_index=True)
        codes, names = pd.factorize(pd.concat([both["a"], both["b"]], ignore_index=True), sort=True)
        root = np.arange(len(names))
        unite(root, codes[: len(both)], codes[len(both) :])
        other = np.flatnonzero(root != np.arange(len(root)))
        yield pd.DataFrame({"node": names[other], "root": names[root[other]]})

    return pairs.coalesce(1).mapInPandas(run, f"node {kind}, root {kind}")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node that can be reached) for every node of undirected edges (a, b).

    Each round every node points to its least neighbour, pointers are followed to their ends, and what they join
    becomes one node: of the nodes that are left at most half remain, and edges within one are gone. Only nodes that
    point elsewhere are looked up, in copies, so a node that very many share isn't one task's. Every round's result
    is written. Ends are put together backwards, from the last round's few nodes to all.
    """
    held = cut(edges.select("a", "b"))
    pairs, steps = held.where("a <> b"), []
    while True:
        count = pairs.count()
        if not count:
            break
        if count <= FEW_EDGES:
            steps.append(cut(_finished(pairs)))
            break
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).where("m < node").select("node", F.col("m").alias("root")))
        while True:
            up = low.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = cut(salted_left(low, up, "root", "node").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            low = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        steps.append(low)
        named = pairs.withColumn("_n", F.monotonically_increasing_id())
        for end in ("a", "b"):
            named = salted_left(named, low.withColumnRenamed("node", end), end, "_n").withColumn(end, F.coalesce("root", end)).drop("root")
        pairs = cut(named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    nodes = held.select(F.col("a").alias("node")).union(held.select("b")).distinct()
    if not steps:
        return nodes.select("node", F.col("node").alias("root"))
    found = steps.pop()
    while steps:
        step = steps.pop()
        found = cut(salted_left(step, found.withColumnRenamed("root", "next").withColumnRenamed("node", "root"), "root", "node").select("node", F.coalesce("next", "root").alias("root")).union(found))
    return cut(nodes.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root")))


def first_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; Spark keeps only so many for each key before it shuffles."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")


def days_of(detections: DataFrame) -> DataFrame:
    """Different (site_id, acq_date)."""
    return detections.select("site_id", "acq_date").distinct()


def box(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows in a box, borders included; comparisons on the plain columns reach the Parquet scan."""
    if west > east or south > north:
        raise ValueError("a box is west, south, east, north")
    return df.where(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))


def parse_box(text: str) -> tuple[float, float, float, float]:
    """``west,south,east,north``."""
    parts = text.split(",")
    if len(parts) != 4:
        raise ValueError("a box has four parts")
    west, south, east, north = map(float, parts)
    if west > east or south > north:
        raise ValueError("a box is west, south, east, north")
    return west, south, east, north


def matching(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality filters in upper case; None and ALL filter nothing."""
    for column, value in wanted.items():
        if value is not None and value.upper() != "ALL":
            df = df.where(F.col(column) == value.upper())
    return df


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Marks ``df`` for broadcast if it is counted to have at most so many rows; otherwise Spark decides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
