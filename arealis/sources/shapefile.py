"""Shapefiles: points and polygons (several parts, holes). Other shape types are refused."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from arealis.operators.geometry import GEOM, POINT, POLYGON
from arealis.sources.dbf import read_dbf, write_dbf
from arealis.sources.placed import Span, in_sequence, opened, pieces, read_head, size_of, spans, write_placed

#: Bytes of a file's head and of an index entry; records that a partition reads, and bytes of shapes in a batch.
HEAD, ENTRY, RECORDS, AT_ONCE = 100, 8, 1 << 15, 4 << 20
NONE = np.zeros(0, "<i4"), np.zeros((0, 2))


def shape(body: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Type, the parts' starts and the points of a record's content."""
    kind = struct.unpack_from("<i", body)[0]
    if kind == 0:
        return 0, *NONE
    if kind == POINT:
        return POINT, np.zeros(1, "<i4"), np.frombuffer(body, "<f8", 2, 4).reshape(1, 2)
    if kind != POLYGON:
        raise ValueError(f"shape type {kind} is not supported")
    n_parts, n_points = struct.unpack_from("<2i", body, 36)
    return POLYGON, np.frombuffer(body, "<i4", n_parts, 44), np.frombuffer(body, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)


def shape_batch(first: int, bodies: list[bytes]) -> pa.RecordBatch:
    """(obs_id, geom) of records that follow each other."""
    found = [shape(b) for b in bodies]
    ends = lambda k: pa.array(np.cumsum([0, *(len(f[k]) for f in found)]), pa.int32())
    points = np.concatenate([f[2] for f in found])
    spots = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], names=["x", "y"])
    parts = pa.ListArray.from_arrays(ends(1), pa.array(np.concatenate([f[1] for f in found]), pa.int32()))
    geom = pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.int32()), parts, pa.ListArray.from_arrays(ends(2), spots)], names=["type", "parts", "points"])
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(found)), pa.int64()), geom], names=["obs_id", "geom"])


class ShapeReader(DataSourceReader):
    """Records of a range: a task reads its part of the index file, then the bytes that this names. Without an index one task walks through the file."""

    def __init__(self, options: dict) -> None:
        self.path, self.index, self.step = options["path"], options["index"], int(options["step"])
        self.box = [float(x) for x in options["box"].split(",")] if options.get("box") else None

    def partitions(self) -> list[Span]:
        size = size_of(self.index) if self.index else None
        return spans(0, (size - HEAD) // ENTRY, self.step) if size is not None else [Span(0, -1)]

    def _bodies(self, span: Span) -> Iterator[bytes]:
        with opened(self.path) as source:
            if span.last < 0:
                source.seek(HEAD)
                while len(head := source.read(8)) == 8:
                    yield source.read(2 * struct.unpack(">2i", head)[1])
                return
            with opened(self.index) as index:
                index.seek(HEAD + ENTRY * span.first)
                entries = np.frombuffer(index.read(ENTRY * (span.last - span.first)), ">i4").reshape(-1, 2).astype("i8") * 2
            for at, length in entries.tolist():
                source.seek(at + 8)
                yield source.read(length)

    def _wanted(self, body: bytes) -> bool:
        if self.box is None:
            return True
        kind = struct.unpack_from("<i", body)[0]
        if kind == 0:
            return False
        x0, y0, x1, y1 = struct.unpack_from("<4d", body, 4) if kind != POINT else struct.unpack_from("<2d", body, 4) * 2
        return x0 <= self.box[2] and x1 >= self.box[0] and y0 <= self.box[3] and y1 >= self.box[1]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        held, size, first = [], 0, partition.first
        for k, body in enumerate(self._bodies(partition), partition.first) if partition.first != partition.last else ():
            if held and (size >= AT_ONCE or k != first + len(held)):
                yield shape_batch(first, held)
                held, size = [], 0
            if self._wanted(body):
                first = first if held else k
                held.append(body)
                size += len(body)
        if held:
            yield shape_batch(first, held)


class Shapes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shape_records"

    def schema(self) -> str:
        return f"obs_id long, geom {GEOM}"

    def reader(self, schema: T.StructType) -> ShapeReader:
        return ShapeReader(dict(self.options))


def read_shp(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, records: int = RECORDS) -> DataFrame:
    """(obs_id, geom) in record order, `records` of them in a task if base.shx stands beside; with `box`, only shapes whose own box meets it."""
    if struct.unpack(">i", read_head(path, 4))[0] != 9994:
        raise ValueError("not a shapefile")
    spark.dataSource.register(Shapes)
    index = path.removesuffix(".shp") + ".shx"
    return spark.read.format("shape_records").options(path=path, index=index, step=records, box=",".join(map(repr, box)) if box else "").load()


def read_shapefile(spark: SparkSession, base: str, columns: list[str] | None = None) -> DataFrame:
    """Shapes and attributes of base.shp and base.dbf beside each other."""
    return read_shp(spark, base + ".shp").join(read_dbf(spark, base + ".dbf", columns), "obs_id")


def record(geom) -> bytes:
    if geom["type"] == 0:
        return struct.pack("<i", 0)
    pts = [(p["x"], p["y"]) for p in geom["points"]]
    if geom["type"] == POINT:
        return struct.pack("<i2d", POINT, *pts[0])
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    return struct.pack("<i4d2i", POLYGON, min(xs), min(ys), max(xs), max(ys), len(geom["parts"]), len(pts)) + struct.pack(f"<{len(geom['parts'])}i", *geom["parts"]) + b"".join(struct.pack("<2d", *p) for p in pts)


def _big(value: Column) -> Column:
    """Four bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 8, "0"))


def write_shapefile(df: DataFrame, base: str, order: str = "obs_id", geom: str = "geom") -> None:
    """base.shp, base.shx and base.dbf, rows in order; tasks make the records and write them at their places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"o": pdf["o"], "body": [record(g) for g in pdf["g"]]})

    flat = df.select(F.col(order).alias("o"), F.col(geom).alias("g"))
    kind = dict(flat.dtypes)["o"]
    rows = in_sequence(flat.mapInPandas(run, f"o {kind}, body binary"), ["o"], F.octet_length("body") + 8)
    corner = lambda f, a: getattr(F, f)(F.expr(f"array_{f}(transform({geom}.points, p -> p.{a}))"))
    ends = df.agg(corner("min", "x"), corner("min", "y"), corner("max", "x"), corner("max", "y"), F.max(f"{geom}.type")).first()
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()

    def head(length: int) -> bytes:
        return struct.pack(">i20xi", 9994, length // 2) + struct.pack("<2i8d", 1000, ends[4] or 0, *(e or 0.0 for e in ends[:4]), 0, 0, 0, 0)

    words = _big(F.octet_length("body") / 2)
    bodies = rows.select((F.col("pos") + HEAD).alias("pos"), F.concat(_big(F.col("row") + 1), words, "body").alias("data"))
    entries = rows.select((F.col("row") * ENTRY + HEAD).alias("pos"), F.concat(_big((F.col("pos") + HEAD) / 2), words).alias("data"))
    write_placed(bodies.unionByName(pieces(df.sparkSession, (0, head(HEAD + size)))), base + ".shp")
    write_placed(entries.unionByName(pieces(df.sparkSession, (0, head(HEAD + ENTRY * n)))), base + ".shx")
    write_dbf(df.drop(geom), base + ".dbf", order)
