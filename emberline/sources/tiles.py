"""Rasters in tiles that Spark writes, and windows of them: a file's blocks first, then where each lies.

The grid is one for the whole globe: rows from the north pole, columns from 180 degrees west, tiles of ``size`` by
``size`` pixels, blocks of ``block`` by ``block``. Pixels without a value are 0; a block without any isn't written.
"""

from __future__ import annotations

import json
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.geo import window_bounds

MAGIC = b"EMTILE1\n"


def grid(lat: Column, lon: Column, degrees: float) -> list[Column]:
    """Row and column of the pixel at a place."""
    return [F.floor((F.lit(90.0) - lat) / degrees).alias("row"), F.floor((lon + 180) / degrees).alias("col")]


def tile_name(row: Column, col: Column, size: int) -> Column:
    return F.concat(F.lit("r"), F.floor(row / size).cast("string"), F.lit("c"), F.floor(col / size).cast("string"))


def write_tiles(pixels: DataFrame, folder: str, size: int = 1_200, block: int = 100) -> DataFrame:
    """Writes pixels (row, col, value 0 to 255; a pixel that comes twice takes the larger value) as tiles: tile, blocks, bytes.

    Pixels are packed block by block, so no task holds a tile; a tile's file is written by one task as its blocks come.
    """
    in_tile = lambda c: F.pmod(F.col(c), F.lit(size))
    placed = pixels.select(tile_name(F.col("row"), F.col("col"), size).alias("tile"), F.floor(in_tile("row") / block).cast("int").alias("by"), F.floor(in_tile("col") / block).cast("int").alias("bx"), (in_tile("row") % block).cast("int").alias("y"), (in_tile("col") % block).cast("int").alias("x"), F.col("value").cast("int").alias("value"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros((block, block), np.uint8)
        np.maximum.at(cells, (frame["y"].to_numpy(), frame["x"].to_numpy()), frame["value"].to_numpy().astype(np.uint8))
        return pd.DataFrame({"tile": frame["tile"].head(1), "by": frame["by"].head(1), "bx": frame["bx"].head(1), "data": [zlib.compress(cells.tobytes())]})

    packed = placed.groupBy("tile", "by", "bx").applyInPandas(pack, "tile string, by int, bx int, data binary")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = fs.FileSystem.from_uri(folder)
        system.create_dir(place, recursive=True)
        name, out, index, at = None, None, {}, 0

        def close() -> pa.RecordBatch:
            nonlocal at
            footer = json.dumps({"size": size, "block": block, "blocks": index}).encode()
            out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
            out.close()
            system.move(f"{place}/.{name}", f"{place}/{name}.tile")
            return pa.RecordBatch.from_pydict({"tile": [name], "blocks": pa.array([len(index)], pa.int64()), "bytes": pa.array([at + len(footer) + 16], pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                if row["tile"] != name:
                    if name is not None:
                        yield close()
                    name, index, at = row["tile"], {}, 0
                    out = system.open_output_stream(f"{place}/.{name}")
                out.write(row["data"])
                index[f"{row['by']},{row['bx']}"] = [at, len(row["data"])]
                at += len(row["data"])
        if name is not None:
            yield close()

    return packed.repartition("tile").sortWithinPartitions("tile", "by", "bx").mapInArrow(write, "tile string, blocks long, bytes long")


class Tile:
    """One open tile; blocks are read and unpacked as they are asked for, a few are kept."""

    def __init__(self, system: fs.FileSystem, place: str, keep: int = 64) -> None:
        self.file = system.open_input_file(place)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{place} is no tile")
        length = int.from_bytes(tail[:8], "little")
        head = json.loads(self.file.read_at(length, size - 16 - length))
        self.block, self.index, self.keep, self.reads = head["block"], head["blocks"], keep, 0
        self.held: OrderedDict[str, np.ndarray] = OrderedDict()

    def cells(self, by: int, bx: int) -> np.ndarray | None:
        key = f"{by},{bx}"
        if key not in self.index:
            return None
        if key not in self.held:
            at, length = self.index[key]
            self.held[key] = np.frombuffer(zlib.decompress(self.file.read_at(length, at)), np.uint8).reshape(self.block, self.block)
            self.reads += 1
            if len(self.held) > self.keep:
                self.held.popitem(last=False)
        self.held.move_to_end(key)
        return self.held[key]

    def counts(self, top: int, bottom: int, left: int, right: int) -> np.ndarray:
        """How many pixels of each value a window holds (rows and columns of the tile, both ends included)."""
        out, b = np.zeros(256, np.int64), self.block
        for by in range(top // b, bottom // b + 1):
            for bx in range(left // b, right // b + 1):
                y0, y1, x0, x1 = max(top - by * b, 0), min(bottom - by * b, b - 1) + 1, max(left - bx * b, 0), min(right - bx * b, b - 1) + 1
                cells = self.cells(by, bx)
                out += np.bincount(cells[y0:y1, x0:x1].ravel(), minlength=256) if cells is not None else np.bincount([0], minlength=256) * ((y1 - y0) * (x1 - x0))
        return out


def window_counts(sites: DataFrame, folder: str, degrees: float, size: int = 1_200) -> DataFrame:
    """How many pixels of each value lie in the 2 km around each site: site_id, tile, value, n.

    Sites meet their tiles by name. A task opens each of its tiles once and reads only the blocks that windows need;
    for every tile it opens it adds a row without a site: value -1, n the blocks it read. Where there is no tile all
    pixels are 0. A window over a tile's border has rows from each.
    """
    bounds = window_bounds(F.col("latitude"), F.col("longitude"))
    edges = sites.where("latitude is not null and longitude is not null").select(
        "site_id", *[F.floor((F.lit(90.0) - bounds[b]) / degrees).alias(n) for n, b in (("top", "north"), ("bottom", "south"))], *[F.floor((bounds[b] + 180) / degrees).alias(n) for n, b in (("left", "west"), ("right", "east"))]
    )
    tiled = edges.withColumn("_r", F.explode(F.sequence(F.floor(F.col("top") / size), F.floor(F.col("bottom") / size)))).withColumn("_c", F.explode(F.sequence(F.floor(F.col("left") / size), F.floor(F.col("right") / size))))
    inside = tiled.select(
        "site_id", tile_name(F.col("_r") * size, F.col("_c") * size, size).alias("tile"),
        *[F.greatest(F.col(c) - F.col(t) * size, F.lit(0)).cast("int").alias(c) for c, t in (("top", "_r"), ("left", "_c"))], *[F.least(F.col(c) - F.col(t) * size, F.lit(size - 1)).cast("int").alias(c) for c, t in (("bottom", "_r"), ("right", "_c"))],
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = fs.FileSystem.from_uri(folder)
        name, tile = None, None
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            arrays = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, ["site_id", "tile", "value", "n"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["tile"] != name:
                    if tile is not None:
                        out.append((None, name, -1, tile.reads))
                    name, where = row["tile"], f"{place}/{row['tile']}.tile"
                    tile = Tile(system, where) if system.get_file_info(where).type == fs.FileType.File else None
                window = (row["top"], row["bottom"], row["left"], row["right"])
                counts = tile.counts(*window) if tile is not None else np.eye(1, 256, dtype=np.int64)[0] * (window[1] - window[0] + 1) * (window[3] - window[2] + 1)
                out += [(row["site_id"], name, int(v), int(counts[v])) for v in np.flatnonzero(counts)]
            if out:
                yield flush()
        if tile is not None:
            out.append((None, name, -1, tile.reads))
            yield flush()

    return inside.repartition("tile").sortWithinPartitions("tile", "top", "left").mapInArrow(read, "site_id string, tile string, value int, n long")
