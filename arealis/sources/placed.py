"""Files written and read by byte ranges, in many tasks, through Python data sources.

`write_placed` writes rows (pos, data): every task puts its bytes at their places in a file beside the target, and the driver's commit only
renames it, so retried tasks write the same bytes again and a failed job leaves no target. Where a store has no places to write to (object stores, HDFS), each run of bytes
is a part of its own, and the commit joins the parts in order. Paths are local ones (a disk that all machines mount) or of a store that Arrow's file systems know.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, InputPartition, WriterCommitMessage

from arealis.operators.cut import cut

#: Bytes that are written or copied at once.
CHUNK = 8 << 20


def local(path: str) -> str | None:
    """The path on a mounted disk, or None for another store."""
    parts = urlparse(path)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def opened(path: str):
    """A file to read, with seek, from a mounted disk or a store that Arrow knows."""
    here = local(path)
    if here is not None:
        return open(here, "rb")
    system, name = pa.fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def size_of(path: str) -> int | None:
    """Bytes of a file, None if there is none."""
    here = local(path)
    if here is not None:
        return os.path.getsize(here) if os.path.exists(here) else None
    system, name = pa.fs.FileSystem.from_uri(path)
    found = system.get_file_info(name)
    return found.size if found.type == pa.fs.FileType.File else None


@dataclass
class Span(InputPartition):
    """Records from first up to, but not, last."""

    first: int
    last: int


def spans(first: int, last: int, step: int) -> list[Span]:
    """At least one span, so that an empty range has a partition that reads nothing."""
    return [Span(a, min(a + step, last)) for a in range(first, last, max(1, step))] or [Span(first, first)]


@dataclass
class Written(WriterCommitMessage):
    """Parts by the place of their first byte; none on a mounted disk."""

    parts: list[tuple[int, str]]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of what stands side by side, CHUNK bytes or little more at once."""
    start, held = 0, bytearray()
    for batch in batches:
        for pos, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (pos != start + len(held) or len(held) >= CHUNK):
                yield start, bytes(held)
                held.clear()
            start = start if held else pos
            held += data
    if held:
        yield start, bytes(held)


class PlacedWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path, self.mark = path, uuid.uuid4().hex

    def _beside(self) -> str:
        return f"{local(self.path)}.{self.mark}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        if local(self.path) is not None:
            out = os.open(self._beside(), os.O_RDWR | os.O_CREAT, 0o644)
            try:
                for pos, data in _runs(iterator):
                    os.pwrite(out, data, pos)
                os.fsync(out)
            finally:
                os.close(out)
            return Written([])
        system, name = pa.fs.FileSystem.from_uri(self.path)
        parts: list[tuple[int, str]] = []
        stream, end = None, -1
        for pos, data in _runs(iterator):
            if pos != end:
                if stream is not None:
                    stream.close()
                parts.append((pos, f"{name}.{self.mark}/{uuid.uuid4().hex}"))
                system.create_dir(f"{name}.{self.mark}")
                stream = system.open_output_stream(parts[-1][1])
            stream.write(data)
            end = pos + len(data)
        if stream is not None:
            stream.close()
        return Written(parts)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        here = local(self.path)
        if here is not None:
            os.close(os.open(self._beside(), os.O_RDWR | os.O_CREAT, 0o644))
            os.replace(self._beside(), here)
            return
        system, name = pa.fs.FileSystem.from_uri(self.path)
        parts, end = sorted(p for m in messages if m is not None for p in m.parts), 0
        with system.open_output_stream(name) as out:
            for pos, part in parts:
                if pos != end:
                    raise ValueError("the bytes of a file must stand side by side")
                with system.open_input_stream(part) as source:
                    while data := source.read(CHUNK):
                        out.write(data)
                        end += len(data)
        if parts:
            system.delete_dir(f"{name}.{self.mark}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if local(self.path) is not None:
            if os.path.exists(self._beside()):
                os.remove(self._beside())
            return
        system, name = pa.fs.FileSystem.from_uri(self.path)
        if system.get_file_info(f"{name}.{self.mark}").type == pa.fs.FileType.Directory:
            system.delete_dir(f"{name}.{self.mark}")


class PlacedBytes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "placed_bytes"

    def schema(self) -> str:
        return "pos long, data binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> PlacedWriter:
        return PlacedWriter(self.options["path"])


def write_placed(rows: DataFrame, path: str) -> None:
    """Write rows (pos long, data binary) as one file; places that no row covers read as zeros on a mounted disk, and are an error elsewhere."""
    here = local(path)
    if here is not None:
        os.makedirs(os.path.dirname(here) or ".", exist_ok=True)
    rows.sparkSession.dataSource.register(PlacedBytes)
    rows.select("pos", "data").write.format("placed_bytes").mode("append").save(path)


def in_sequence(df: DataFrame, order: list[str], size: Column) -> DataFrame:
    """df, stored, with `size`, `row` (from 0) and `pos` (the sizes before the row) in `order`: sorted by ranges, and shifted by the ranges' sums; no task sees more than a range."""
    dealt = df.withColumn("_size", size.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = at = 0
        for batch in batches:
            sizes = batch.column("_size").to_numpy(zero_copy_only=False)
            ends = at + np.cumsum(sizes)
            places = [pa.array(np.arange(rows, rows + len(sizes)), pa.int64()), pa.array(ends - sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *places], names=[*batch.schema.names, "_row", "_pos"])
            rows, at = rows + len(sizes), int(ends[-1]) if len(sizes) else at

    longs = [T.StructField("_row", T.LongType()), T.StructField("_pos", T.LongType())]
    held = cut(dealt.mapInArrow(run, T.StructType([*dealt.schema.fields, *longs])))
    sums = held.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_s"))  # a row for each range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s"))
    own = [F.col(f"`{c}`") for c in df.columns]
    return held.join(F.broadcast(shift), "_range").select(*own, F.col("_size").alias("size"), (F.col("_row") + F.col("_n")).alias("row"), (F.col("_pos") + F.col("_s")).alias("pos"))


def pieces(spark: SparkSession, *placed: tuple[int, bytes]) -> DataFrame:
    """Rows (pos, data) of heads and tails."""
    return spark.createDataFrame([(p, bytearray(d)) for p, d in placed], "pos long, data binary")


def write_lines(spark: SparkSession, head: str | None, lines: DataFrame, order: list[str], path: str) -> None:
    """One text file: `head`, then the lines' `value` in `order`, each with a line feed."""
    first = (head + "\n").encode() if head is not None else b""
    kept = lines.select(F.encode(F.concat("value", F.lit("\n")), "UTF-8").alias("data"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    rows = in_sequence(kept, [f"o{i}" for i in range(len(order))], F.octet_length("data")).select((F.col("pos") + len(first)).alias("pos"), "data")
    write_placed(rows.unionByName(pieces(spark, (0, first))) if first else rows, path)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(n, line): the lines of a file, or of a folder's files in order of their names, with their place from 0.

    Tasks read splits; a line's place is that in its split and the lines of the splits before, which are counted in a scan of their own.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    counts = lines.groupBy("file", "block").agg(F.min("m").alias("first"), F.count(F.lit(1)).alias("c"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("file", "block", "first", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("shift"))  # a row for each split
    return lines.join(F.broadcast(shift), ["file", "block"]).select((F.col("m") - F.col("first") + F.col("shift")).alias("n"), F.rtrim(F.col("line"), F.lit("\r")).alias("line"))


def read_head(path: str, size: int) -> bytes:
    with opened(path) as source:
        return source.read(size)


def chunks(source: io.BufferedIOBase, start: int, stop: int, step: int) -> Iterator[bytes]:
    """The bytes from start to stop, `step` at once."""
    source.seek(start)
    while start < stop:
        data = source.read(min(step, stop - start))
        if not data:
            raise ValueError("the file ends too early")
        yield data
        start += len(data)
