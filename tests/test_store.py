"""The store: one commit over many tables, layers, compaction, conflicts."""

import json

import pytest
from pyspark.sql import functions as F

from emberline.operators import store as module
from emberline.operators.store import Conflict, Spec, Store, by_site

SPECS = {"daily": by_site("site_id", "day"), "notes": Spec(("id",), "cast(id % 3 as string)", ("id",))}


def days(spark, *rows):
    return spark.createDataFrame(rows, "site_id string, day int, n long")


def notes(spark, *rows):
    return spark.createDataFrame(rows, "id long, text string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_reader_sees_all_of_a_commit_or_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SPECS)
    assert store.manifest()["version"] == 0 and rows(store.read("notes", empty="id long, text string")) == []
    batch = store.begin()
    assert batch.put("daily", days(spark, ("A", 1, 5), ("B", 1, 6)))["rows"] == 2
    batch.put("notes", notes(spark, (1, "x"), (2, None)))
    assert store.manifest()["tables"] == {} and rows(batch.read("daily")) == [("A", 1, 5), ("B", 1, 6)]
    batch.marks["live"] = 7
    batch.commit()
    assert rows(store.read("notes")) == [(1, "x"), (2, None)] and store.manifest()["marks"] == {"live": 7}
    old = store.manifest()
    batch = store.begin()
    batch.put("daily", days(spark, ("A", 1, 9), ("C", 1, 1)), gone=spark.createDataFrame([("B", 1)], "site_id string, day int"))
    batch.put("notes", notes(spark, (2, "y")))
    batch.commit()
    assert rows(store.read("daily")) == [("A", 1, 9), ("C", 1, 1)] and rows(store.read("notes")) == [(1, "x"), (2, "y")]
    assert rows(store.read("daily", manifest=old)) == [("A", 1, 5), ("B", 1, 6)]  # a reader that began before keeps what it saw
    assert store.manifest()["parent"] == old["digest"]
    found = store.verify().collect()
    assert len(found) == 4 and all(r.expected == r.found for r in found)


def test_of_two_writers_the_second_fails_and_leaves_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SPECS)
    first, second = store.begin(), store.begin()
    first.put("notes", notes(spark, (1, "first")))
    second.put("notes", notes(spark, (1, "second")))
    first.commit()
    with pytest.raises(Conflict):
        second.commit()
    assert rows(store.read("notes")) == [(1, "first")] and len(store.files.names("notes")) == 1


def test_a_small_batch_writes_little(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), SPECS)
    many = spark.range(200_000).select(F.concat(F.lit("S"), F.col("id") % 2000).alias("site_id"), (F.col("id") / 2000).cast("int").alias("day"), F.xxhash64("id").alias("n"))
    batch = store.begin()
    whole = batch.put("daily", many)["bytes"]
    batch.commit()
    assert store.manifest()["tables"]["daily"]["layers"] == []  # the first rows are the base
    batch = store.begin()
    part = batch.put("daily", many.where("pmod(xxhash64(site_id, 1), 100) = 0").withColumn("n", F.lit(-1).cast("long")))
    batch.commit()
    assert 1000 < part["rows"] < 3500 and part["bytes"] < 0.1 * whole  # a layer has small files of its own, a footer each
    held = store.manifest()["tables"]["daily"]
    assert len(held["layers"]) == 1 and store.read("daily").where("n = -1").count() == part["rows"]
    one = store.read("daily", store.buckets_of("daily", spark.createDataFrame([("S5",)], "site_id string")))
    assert one.where("site_id = 'S5'").count() == 100 and one.count() < 20_000
    monkeypatch.setattr(module, "MOST_LAYERS", 1)
    before = rows(store.read("daily").groupBy().agg(F.count("*"), F.sum(F.col("n").cast("decimal(38,0)"))))
    assert store.compact("daily")
    held = store.manifest()["tables"]["daily"]
    assert held["layers"] == [] and len(set(held["base"].values())) == 2  # only the touched buckets were written
    assert rows(store.read("daily").groupBy().agg(F.count("*"), F.sum(F.col("n").cast("decimal(38,0)")))) == before
    assert store.vacuum(keep=1) == 1 and rows(store.read("daily").groupBy().agg(F.count("*"), F.sum(F.col("n").cast("decimal(38,0)")))) == before


def test_a_later_column_and_an_empty_write(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SPECS)
    batch = store.begin()
    batch.put("notes", notes(spark))
    batch.put("daily", days(spark, ("A", 1, 1)))
    batch.commit()
    assert rows(store.read("notes")) == []
    batch = store.begin()
    batch.put("notes", spark.createDataFrame([(4, "x", 1.5)], "id long, text string, score double"))
    batch.put("daily", spark.createDataFrame([("B", 2)], "site_id string, day int"))
    batch.commit()
    assert rows(store.read("notes")) == [(4, "x", 1.5)] and rows(store.read("daily").where("site_id='B'")) == [("B", 2, None)]
    json.dumps(store.manifest())
