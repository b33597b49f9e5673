"""Keyed tables that change together: a manifest names the files of all of them, and one rename puts it in force.

A table is a *base* (a folder for each bucket of keys) and *layers* over it, the newest row of a key being the one
that counts; a layer can also say that a key is gone. A commit writes one small layer for each table it touches, so
it writes about as much as it changes; a reader joins the base with the keys of the layers, which are few. When the
layers of a table have grown to a share of its base, the buckets they touch are written anew.

A manifest holds its number, the digest of the one before it, the marks of those who write, and for every base
and layer a digest of its content. It is written under another name and renamed to its number; the rename
fails if that number is there, so of two writers that started from one manifest only the first commits.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from emberline.operators.common import first_by

#: Buckets are written anew when a table has so many layers, or layers of this share of the base's bytes.
MOST_LAYERS, LAYER_SHARE = 20, 0.25
_BUCKET, _GONE, _LAYER = "_bucket", "_gone", "_layer"


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


@dataclass(frozen=True)
class Spec:
    """What makes a row the same row, and the SQL of its bucket, which follows from the columns of ``placed`` alone."""

    keys: tuple[str, ...]
    bucket: str = "'all'"
    placed: tuple[str, ...] = ()


def by_site(*keys: str, buckets: int = 64) -> Spec:
    """A table in buckets of sites."""
    return Spec(keys or ("site_id",), f"cast(pmod(xxhash64(site_id), {buckets}) as string)", ("site_id",))


class Files:
    """The few calls to the shared file system that a store makes."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = root.rstrip("/")
        context = spark.sparkContext
        self._hadoop, self._conf, self._gateway = context._jvm.org.apache.hadoop.fs, context._jsc.hadoopConfiguration(), context._gateway
        self._fs = self.path("").getFileSystem(self._conf)

    def path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        place = self.path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def size(self, name: str) -> int:
        return int(self._fs.getContentSummary(self.path(name)).getLength())

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Writes a file whole under a new name; false if there is one already."""
        staged = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(staged)
        out.write(bytearray(text.encode()))
        out.close()
        options = self._gateway.new_array(self._hadoop.Options.Rename, 1)
        options[0] = self._hadoop.Options.Rename.NONE
        try:
            self._hadoop.FileContext.getFileContext(staged.toUri(), self._conf).rename(staged, self.path(name), options)
        except Exception as error:  # the JVM's exception says why
            self._fs.delete(staged, False)
            if "FileAlreadyExists" in str(error) or self._fs.exists(self.path(name)):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)


def metrics(observed: Observation) -> dict:
    """What an observation counted; empty if Spark knew beforehand that there were no rows and took the counting out of the plan."""
    try:
        return observed.get
    except Py4JJavaError:  # such a result has no columns to convert
        return {}


def content_digest(columns: Iterable[str]) -> Column:
    """A digest of a set of rows that doesn't depend on their order."""
    return F.concat_ws("-", *[F.hex(F.bit_xor(F.xxhash64(F.lit(seed), *sorted(columns)))) for seed in (1, 2)])


def due(held: dict) -> bool:
    """Whether a table's layers have grown so that what they touch is to be written anew."""
    return len(held["layers"]) >= MOST_LAYERS or sum(layer["bytes"] for layer in held["layers"]) >= LAYER_SHARE * max(held["base_bytes"], 1 << 20)


def _new() -> dict:
    return {"base": {}, "base_bytes": 0, "layers": [], "digests": {}}


class Store:
    """Tables under one folder (one that driver and executors share)."""

    def __init__(self, spark: SparkSession, root: str, specs: dict[str, Spec]) -> None:
        self.spark, self.root, self.specs = spark, root.rstrip("/"), specs
        self.files = Files(spark, root)

    def manifest(self, version: int | None = None) -> dict:
        """The manifest in force, or an older one; of an empty store one without tables."""
        names = [n for n in self.files.names("_manifests") if n.endswith(".json")]
        if version is not None:
            names = [n for n in names if n == f"{version:012d}.json"]
        if not names:
            return {"version": 0, "digest": "", "marks": {}, "tables": {}}
        text = self.files.read(f"_manifests/{names[-1]}")
        return json.loads(text) | {"digest": hashlib.sha256(text.encode()).hexdigest()}

    def exists(self, name: str, manifest: dict | None = None) -> bool:
        return name in (manifest or self.manifest())["tables"]

    def buckets_of(self, name: str, rows: DataFrame) -> list[str]:
        """The buckets that hold the keys of ``rows`` (at most as many as the table has buckets)."""
        return [r[0] for r in rows.select(F.expr(self.specs[name].bucket).alias(_BUCKET)).distinct().collect()]

    def read(self, name: str, buckets: list[str] | None = None, manifest: dict | None = None, empty: str | StructType | None = None) -> DataFrame:
        """A table as the manifest in force has it; ``buckets`` reads only those. ``empty``: the schema where there is no such table yet."""
        held = (manifest or self.manifest())["tables"].get(name)
        if held is None:
            if empty is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], empty)
        schema = StructType.fromJson(held["schema"])
        base = self._base(held, schema, buckets)
        if not held["layers"]:
            return base
        keys = list(self.specs[name].keys)
        layers = None
        for i, layer in enumerate(held["layers"]):
            part = self._files(layer["path"], schema, None if buckets is None else [b for b in buckets if b in layer["buckets"]], gone=True).withColumn(_LAYER, F.lit(i))
            layers = part if layers is None else layers.unionByName(part)
        last = first_by(layers, keys, [F.desc(_LAYER)])
        kept = base.join(layers.select(*keys).distinct(), keys, "left_anti").select(*schema.names)
        return kept.unionByName(last.where(~F.col(_GONE)).select(*schema.names))

    def _files(self, path: str, schema: StructType, buckets: list[str] | None, gone: bool = False) -> DataFrame:
        full = schema.jsonValue()
        extra = ([{"name": _GONE, "type": "boolean", "nullable": True, "metadata": {}}] if gone else []) + [{"name": _BUCKET, "type": "string", "nullable": True, "metadata": {}}]
        df = self.spark.read.schema(StructType.fromJson(full | {"fields": full["fields"] + extra})).parquet(f"{self.root}/{path}")
        return (df if buckets is None else df.where(F.col(_BUCKET).isin(buckets) if buckets else F.lit(False))).drop(_BUCKET)

    def _base(self, held: dict, schema: StructType, buckets: list[str] | None) -> DataFrame:
        places: dict[str, list[str]] = {}
        for bucket, path in held["base"].items():
            if buckets is None or bucket in buckets:
                places.setdefault(path, []).append(bucket)
        out = self.spark.createDataFrame([], schema)
        for path, wanted in sorted(places.items()):  # as many as there were rewritings that still count
            out = out.unionByName(self._files(path, schema, wanted))
        return out

    def begin(self) -> Batch:
        return Batch(self, self.manifest())

    def compact(self, name: str) -> bool:
        """Writes the buckets that layers touch anew, if the layers have grown; false if not, or if another writer came first."""
        manifest = self.manifest()
        held = manifest["tables"].get(name)
        if not held or not due(held):
            return False
        touched = sorted({b for layer in held["layers"] for b in layer["buckets"]})
        batch = Batch(self, manifest)
        return batch.rebase(name, self.read(name, touched, manifest), touched).commit(compacting=False)

    def vacuum(self, keep: int = 3) -> int:
        """Deletes files that none of the last ``keep`` manifests names, and older manifests; how many folders went.

        Files of a commit that is still being written aren't named yet: run it when no other writer is at work.
        """
        names = [n for n in self.files.names("_manifests") if n.endswith(".json")]
        used: set[str] = set()
        for n in names[-keep:]:
            for held in json.loads(self.files.read(f"_manifests/{n}"))["tables"].values():
                used |= {*held["base"].values(), *(layer["path"] for layer in held["layers"])}
        gone = 0
        for table in self.specs:
            for folder in self.files.names(table):
                if f"{table}/{folder}" not in used:
                    self.files.delete(f"{table}/{folder}")
                    gone += 1
        for n in names[:-keep]:
            self.files.delete(f"_manifests/{n}")
        return gone

    def truncate(self, *names: str) -> None:
        """Empties tables, all of them where none is named, in one commit; their columns stay."""
        batch = self.begin()
        for name in names or list(batch.tables):
            if name in batch.tables:
                batch.tables[name] |= _new()
        batch.commit()

    def verify(self) -> DataFrame:
        """Every base and layer in force with the digest of what its files hold now: table, path, expected, found."""
        out = None
        for name, held in sorted(self.manifest()["tables"].items()):
            schema = StructType.fromJson(held["schema"])
            for path, digest in sorted(held["digests"].items()):
                part = self._files(path, schema, None, gone=True).agg(content_digest([*schema.names, _GONE]).alias("found"))
                part = part.select(F.lit(name).alias("table"), F.lit(path).alias("path"), F.lit(digest).alias("expected"), "found")
                out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], "table string, path string, expected string, found string")


class Batch:
    """What one commit writes: nothing of it is seen before ``commit``, and all of it after."""

    def __init__(self, store: Store, manifest: dict) -> None:
        self.store, self.parent = store, manifest
        self.tables: dict[str, dict] = json.loads(json.dumps(manifest["tables"]))
        self.marks: dict[str, object] = dict(manifest["marks"])
        self.written: list[str] = []

    def read(self, name: str, buckets: list[str] | None = None, empty: str | StructType | None = None) -> DataFrame:
        """The table as this batch leaves it so far."""
        return self.store.read(name, buckets, {"tables": self.tables}, empty)

    def put(self, name: str, rows: DataFrame, gone: DataFrame | None = None) -> dict[str, int]:
        """Rows that are new or replace those of equal key, and keys (with the columns their bucket needs) that go: rows and bytes written.

        The rows are counted while they are written. Keys are not null, and each is there once.
        """
        spec = self.store.specs[name]
        held = self.tables.get(name)
        plain = rows.drop(_GONE)
        schema = StructType.fromJson(held["schema"]) if held else plain.schema
        new = [f for f in plain.schema.fields if f.name not in schema.names]
        if new:  # a column that comes later is null in what was written before
            schema = StructType(schema.fields + new)
        schema = StructType.fromJson(json.loads(schema.json().replace('"nullable":false', '"nullable":true')))
        aligned = plain.select(*[(F.col(f.name) if f.name in plain.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]).withColumn(_GONE, F.lit(False))
        if gone is not None:
            wanted = {*spec.keys, *spec.placed}
            marks = gone.select(*[(F.col(f.name) if f.name in wanted else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]).withColumn(_GONE, F.lit(True))
            aligned = aligned.unionByName(marks)
        path = f"{name}/{uuid.uuid4().hex}"
        counted = Observation()
        placed = aligned.withColumn(_BUCKET, F.expr(spec.bucket)).observe(
            counted, F.count(F.lit(1)).alias("rows"), F.count_if(_GONE).alias("gone"), content_digest([*schema.names, _GONE]).alias("digest"), F.array_sort(F.collect_set(_BUCKET)).alias("buckets")
        )
        self.written.append(path)
        placed.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.store.root}/{path}")
        found = metrics(counted)
        if not found.get("rows"):
            self.tables.setdefault(name, _new())["schema"] = schema.jsonValue()
            return {"rows": 0, "gone": 0, "bytes": 0}
        size = self.store.files.size(path)
        rows_in = found["rows"] - found["gone"]
        entry = self.tables.setdefault(name, _new())
        entry["schema"] = schema.jsonValue()
        entry["digests"][path] = found["digest"]
        if entry["base"] or entry["layers"] or found["gone"]:
            entry["layers"].append({"path": path, "buckets": list(found["buckets"]), "rows": rows_in, "gone": found["gone"], "bytes": size})
        else:  # the first rows of a table are its base
            entry["base"], entry["base_bytes"] = dict.fromkeys(found["buckets"], path), size
        return {"rows": rows_in, "gone": found["gone"], "bytes": size}

    def rebase(self, name: str, rows: DataFrame, buckets: list[str]) -> Batch:
        """Some buckets of a table as ``rows``, in place of their base and of all layers."""
        held = self.tables[name]
        path = f"{name}/{uuid.uuid4().hex}"
        self.written.append(path)
        spec = self.store.specs[name]
        counted = Observation()
        marked = rows.withColumn(_GONE, F.lit(False)).withColumn(_BUCKET, F.expr(spec.bucket))
        seen = marked.observe(counted, content_digest([*rows.columns, _GONE]).alias("digest"), F.collect_set(_BUCKET).alias("buckets"))
        seen.hint("rebalance", _BUCKET).sortWithinPartitions(_BUCKET, *spec.keys).write.partitionBy(_BUCKET).parquet(f"{self.store.root}/{path}")
        found = metrics(counted)
        held["base"] = {b: p for b, p in held["base"].items() if b not in buckets} | dict.fromkeys(found.get("buckets") or [], path)
        held["digests"] = {p: d for p, d in held["digests"].items() if p in held["base"].values()} | ({path: found["digest"]} if found.get("buckets") else {})
        held["layers"] = []
        held["base_bytes"] = sum(self.store.files.size(f"{p}/{_BUCKET}={b}") for b, p in held["base"].items())
        return self

    def commit(self, compacting: bool = True) -> bool:
        """Puts everything in force by one rename. ``Conflict`` (and nothing changed) if another writer came first; without ``compacting`` false instead."""
        version = self.parent["version"] + 1
        text = json.dumps({"version": version, "parent": self.parent["digest"], "marks": self.marks, "tables": self.tables}, sort_keys=True)
        if not self.store.files.put_new(f"_manifests/{version:012d}.json", text):
            self.discard()
            if compacting:
                raise Conflict(f"manifest {version} is there already")
            return False
        if compacting:
            for name, held in self.tables.items():
                if due(held):
                    self.store.compact(name)
        return True

    def discard(self) -> None:
        """Deletes what was written."""
        for path in self.written:
            self.store.files.delete(path)
        self.written.clear()
