"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018  other C libraries lack it
except (OSError, AttributeError):
    _LIBC = None
#: Text bytes that a Python worker turns into one output batch at a time.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a default of our own only where the setting is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root or "file:///tmp/checkpoints/arealis"


#: A mounted disk gets no checksum files beside the tables, which cost a process each; other stores don't read this.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
PARALLEL = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


def store(df: DataFrame, label: str, even: bool = False, **options: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back; `even` deals rows anew, so that files have a useful size."""
    path = store_path(df.sparkSession, label)
    save(df.hint("rebalance") if even else df, path, **options)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if Scratch._open:
        Scratch._open[-1].tables.append(out)
    return out


def save(df: DataFrame, path: str, **options: str) -> None:
    """Write df as Parquet files as large as the advisory partition size, not as many as there are cores."""
    spark = df.sparkSession
    before = spark.conf.get(PARALLEL)
    spark.conf.set(PARALLEL, "false")
    try:
        df.write.options(**PLAIN, **options).parquet(path)
    finally:
        spark.conf.set(PARALLEL, before)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system that a path lies in."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared store that no later step reads."""
    for path in paths:
        file_system(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def drop(*tables: DataFrame) -> None:
    """Delete the folders that `store` wrote for these tables."""
    for df in tables:
        discard(df.sparkSession, df.stored_at)


class Scratch:
    """Tables that are stored inside a `with` block go at its end, but for those that `keep` names. Results that are still to be computed may only read these."""

    _open: list[Scratch] = []

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []
        self.kept: set[str] = set()

    def __enter__(self) -> Scratch:
        Scratch._open.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df.stored_at)
        return df

    def __exit__(self, *_: object) -> None:
        Scratch._open.remove(self)
        for df in self.tables:
            if df.stored_at in self.kept:
                if Scratch._open:
                    Scratch._open[-1].tables.append(df)
            else:
                drop(df)


def store_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def shielded(df: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """df with names of our own in place of all its columns', so that none can clash, and the new names of the wanted ones."""
    names = [f"own_{i}" for i in range(len(df.columns))]
    return df.toDF(*names), [names[df.columns.index(w)] for w in wanted]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text: two hashes with different seeds."""
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about `limit` bytes of `column`, or one row if that is longer."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system; workers live on over stages."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def map_rows(df: DataFrame, column: str, schema: str, rows: Callable[[pa.RecordBatch], dict], limit: int = CHUNK_BYTES) -> DataFrame:
    """mapInArrow over bounded slices; `rows` gives the output's columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                out = rows(part)
                yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) if isinstance(out[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(out[f.name], f.type) for f in target], schema=target)
        batch = part = out = None
        release()

    return df.mapInArrow(run, schema)
