"""dBASE III tables, read by ranges of records and written by places; only the header comes to the driver."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from arealis.sources.placed import Span, chunks, in_sequence, opened, pieces, read_head, size_of, spans, write_placed


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # N, F, C or D
    length: int
    decimals: int = 0


def parse_header(head: bytes) -> tuple[int, int, int, list[Field]]:
    """Records, header length, record length and fields."""
    records, start, size = struct.unpack("<IHH", head[4:12])
    fields, at = [], 32
    while at < start - 1 and head[at] != 0x0D:
        name = head[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append(Field(name, chr(head[at + 11]), head[at + 16], head[at + 17]))
        at += 32
    return records, start, size, fields


#: Records that a partition of the reader holds, and bytes it reads at once.
RECORDS, AT_ONCE = 1 << 18, 4 << 20


class DbfReader(DataSourceReader):
    """Records of a range, each partition by its own seek; fields that aren't asked for are not decoded."""

    def __init__(self, options: dict) -> None:
        self.path, self.start, self.size = options["path"], int(options["start"]), int(options["size"])
        self.first, self.last, self.step = int(options["first"]), int(options["last"]), int(options["step"])
        self.fields = [(name, int(at), int(length)) for name, at, length in json.loads(options["fields"])]

    def partitions(self) -> list[Span]:
        return spans(self.first, self.last, self.step)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        kind = np.dtype({"names": [f"f{i}" for i in range(len(self.fields))], "formats": [f"S{n}" for _, _, n in self.fields], "offsets": [at for _, at, _ in self.fields], "itemsize": self.size})
        names, at = ["obs_id", *(n for n, _, _ in self.fields)], partition.first
        if partition.first == partition.last:
            return
        with opened(self.path) as source:
            for data in chunks(source, self.start + partition.first * self.size, self.start + partition.last * self.size, max(1, AT_ONCE // self.size) * self.size):
                n = len(data) // self.size
                texts = [np.char.decode(column, "latin-1") for column in (np.frombuffer(data, kind)[f] for f in kind.names)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n), pa.int64()), *(pa.array(t, pa.string()) for t in texts)], names=names)
                at += n


class DbfRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dbf_records"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("obs_id", T.LongType()), *(T.StructField(n, T.StringType()) for n, _, _ in json.loads(self.options["fields"]))])

    def reader(self, schema: T.StructType) -> DbfReader:
        return DbfReader(dict(self.options))


def read_dbf(spark: SparkSession, path: str, columns: list[str] | None = None, first: int = 0, last: int | None = None, records: int = RECORDS) -> DataFrame:
    """obs_id (record order) and typed columns: whole numbers BIGINT, others DOUBLE, dates DATE (00000000 is NULL), text trimmed at the right. Deletion flags are skipped.

    Tasks read `records` records each, of the named columns only, from record `first` up to, but not, `last`. (Filters aren't pushed to the
    reader: Spark keeps a pushed filter with the loaded table, so that another query on the same DataFrame would miss rows.)
    """
    n, start, size, fields = parse_header(read_head(path, 32 + 32 * 2048))
    length = size_of(path) or 0
    if length < start + n * size:
        raise ValueError("the file ends too early")
    places, at = {}, 1  # a flag comes first
    for f in fields:
        places[f.name] = (f, at)
        at += f.length
    picked = [places[c] for c in (columns if columns is not None else places)]
    spark.dataSource.register(DbfRecords)
    options = {"path": path, "start": start, "size": size, "first": first, "last": max(first, n if last is None else min(last, n)), "step": records, "fields": json.dumps([(f"f{i}", a, f.length) for i, (f, a) in enumerate(picked)])}
    rows = spark.read.format("dbf_records").options(**options).load()
    out = [F.col("obs_id")]
    for i, (f, _) in enumerate(picked):
        text = F.col(f"f{i}")
        blank = F.nullif(F.trim(text), F.lit(""))
        value = {"C": F.rtrim(text), "D": F.try_to_date(F.nullif(blank, F.lit("0" * 8)), "yyyyMMdd")}.get(f.kind)
        if value is None:
            number = blank.try_cast("double")
            value = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number) if f.decimals else blank.try_cast("bigint")
        out.append(value.alias(f.name))
    return rows.select(*out)


def fields_for(df: DataFrame) -> list[Field]:
    out = []
    for name, kind in df.dtypes:
        if kind in ("int", "bigint", "smallint", "tinyint"):
            out.append(Field(name, "N", 20))
        elif kind in ("double", "float") or kind.startswith("decimal"):
            out.append(Field(name, "N", 20, 9))
        elif kind == "date":
            out.append(Field(name, "D", 8))
        else:
            out.append(Field(name, "C", 254))
    return out


def write_dbf(df: DataFrame, path: str, order: str, fields: list[Field] | None = None) -> None:
    """One file of rows in order of `order` (left out if it is obs_id); tasks format records and write them at their places."""
    kept = df.drop("obs_id") if order == "obs_id" else df
    fields = fields or fields_for(kept)
    cells = []
    for f in fields:
        x = F.col(f"`{f.name}`")
        if f.kind == "D":
            cell = F.coalesce(F.date_format(x, "yyyyMMdd"), F.lit("0" * 8))
        elif f.kind == "C":
            cell = F.rpad(F.coalesce(x.cast("string"), F.lit("")), f.length, " ")
        else:
            cell = F.lpad(F.coalesce(F.format_string(f"%.{f.decimals}f", x.cast("double")) if f.decimals else x.cast("string"), F.lit("")), f.length, " ")
        cells.append(F.substring(cell, 1, f.length))
    size, start = 1 + sum(f.length for f in fields), 32 + 32 * len(fields) + 1
    lines = df.select(F.col(f"`{order}`").alias("order"), F.encode(F.concat(F.lit(" "), *cells), "ISO-8859-1").alias("data"))
    rows = in_sequence(lines, ["order"], F.lit(size))
    n = rows.count()
    head = struct.pack("<4BIHH20x", 3, 112, 1, 1, n, start, size)
    for f in fields:
        head += f.name.encode("latin-1")[:10].ljust(11, b"\0") + f.kind.encode() + b"\0" * 4 + bytes([f.length, f.decimals]) + b"\0" * 14
    ends = pieces(df.sparkSession, (0, head + b"\r"), (start + n * size, b"\x1a"))
    write_placed(rows.select((F.col("pos") + start).alias("pos"), "data").unionByName(ends), path)


def discover_space_time(space: DataFrame, time: DataFrame) -> tuple[str, str]:
    """The first whole-number column of the same name in both is the space id; the first other whole-number or date column of the time table is the time id."""
    a, b = dict(space.dtypes), dict(time.dtypes)
    whole = lambda k: k in ("int", "bigint")
    names = {n.lower(): n for n in b}
    key = next((names[n.lower()] for n in a if n != "obs_id" and whole(a[n]) and n.lower() in names and whole(b[names[n.lower()]])), None)
    period = next((n for n in b if n not in (key, "obs_id") and (whole(b[n]) or b[n] == "date")), None)
    if key is None or period is None:
        raise ValueError("no pair of space and time columns found")
    return key, period


def read_space_time(spark: SparkSession, space_path: str, time_path: str) -> DataFrame:
    from arealis.operators.tables import space_time_join

    space, time = read_dbf(spark, space_path), read_dbf(spark, time_path).drop("obs_id")
    return space_time_join(space, time, discover_space_time(space, time)[0])


def write_space_time(space: DataFrame, time: DataFrame, key: str, period: str, space_path: str, time_path: str) -> None:
    """A space table, and a long time table in order of key and period."""
    write_dbf(space, space_path, key)
    ordered = time.withColumn("obs_id", F.struct(key, period))
    write_dbf(ordered, time_path, "obs_id")
