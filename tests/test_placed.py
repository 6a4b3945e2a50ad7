"""Files by byte ranges: splits against one split, many tasks against one, filters, columns, failed jobs and empty tables."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from arealis.operators import geometry
from arealis.sources import dbf, placed, shapefile, text


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/out"


def test_placed_rows(spark, path, tmp_path):
    """Rows from many tasks in any order make one file, an empty table makes an empty one, and nothing else is left."""
    rows = [(10 * i, bytes([65 + i % 26]) * 10) for i in range(500)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(p, bytearray(d)) for p, d in rows], "pos long, data binary").repartition(7)
    placed.write_placed(df, path)
    assert (tmp_path / "out").read_bytes() == b"".join(d for _, d in sorted(rows))
    placed.write_placed(df.where("false"), path)
    assert (tmp_path / "out").read_bytes() == b"" and os.listdir(tmp_path) == ["out"]


def test_failed_job_leaves_nothing(spark, path, tmp_path):
    df = spark.range(0, 100, 1, 4).select((F.col("id") * 3).alias("pos"), F.when(F.col("id") < 90, F.lit(b"abc")).otherwise(F.raise_error(F.lit("lost")).cast("binary")).alias("data"))
    with pytest.raises(Exception, match="lost"):
        placed.write_placed(df, path)
    assert os.listdir(tmp_path) == []


def test_sequence(spark):
    """Ties, nulls in the order, rows of no size and more ranges than rows."""
    sizes = [5, 0, 7, 1, 1, 0, 3]
    df = spark.createDataFrame([(None if i == 0 else i // 2, i, s) for i, s in enumerate(sizes)], "o long, i long, s int").withColumn("_r", F.lit(1))
    got = sorted(placed.in_sequence(df, ["o", "i"], F.col("s")).collect(), key=lambda r: r.row)
    assert [r.row for r in got] == list(range(7)) and [r.i for r in got] == list(range(7))
    assert [r.pos for r in got] == [sum(sizes[:k]) for k in range(7)]
    assert placed.in_sequence(df.where("false"), ["o"], F.col("s")).count() == 0


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_lines_of_splits(spark, tmp_path, small_splits, end):
    """Blank lines, lines longer than a split, and line ends of two bytes that a split may cut."""
    rng = random.Random(2)
    lines = ["".join(rng.choice("abc ") for _ in range(rng.choice([0, 0, 3, 40, 500]))) for _ in range(300)]
    (tmp_path / "t").write_bytes(end.join(lines).encode() + end.encode())
    read = placed.numbered(spark, f"file://{tmp_path}/t")
    assert spark.read.text(f"file://{tmp_path}/t").rdd.getNumPartitions() > 20
    assert [r.line for r in sorted(read.collect(), key=lambda r: r.n)] == lines


def test_weights_of_splits(spark, path, small_splits):
    """Pairs of lines that splits part: a file of many splits gives what a file of one gives."""
    n = 200
    w = spark.createDataFrame([(i, j, float(i + j)) for i in range(n) if i % 7 for j in (i - 1, i + 1, i + 5) if 0 <= j < n], "src long, dst long, w double")
    obs = spark.range(n).select(F.col("id").alias("obs_id"))
    text.write_lines(spark, f"0 {n} demo ID", text.gal_lines(obs, w), ["n"], path)
    text.write_lines(spark, f"0 {n} demo ID", text.gwt_lines(w), ["src", "dst"], path + "w")
    want = sorted(map(tuple, w.collect()))
    assert spark.read.text(path).rdd.getNumPartitions() > 10
    assert sorted(map(tuple, text.read_gal(spark, path).collect())) == [(a, b) for a, b, _ in want]
    assert sorted(map(tuple, text.read_gwt(spark, path + "w").collect())) == want


def test_dbf_by_ranges(spark, path):
    df = spark.range(1000).select(F.col("id").alias("K"), (F.col("id") / 7).alias("V"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("S"))
    dbf.write_dbf(df.repartition(5), path, "K")
    many = dbf.read_dbf(spark, path, records=64)
    assert many.rdd.getNumPartitions() == 16
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, dbf.read_dbf(spark, path).collect()))
    assert [tuple(r) for r in many.where("obs_id >= 998").orderBy("obs_id").collect()] == [(998, 998, round(998 / 7, 9), "é998"), (999, 999, round(999 / 7, 9), "é999")]
    some = dbf.read_dbf(spark, path, columns=["S"], records=300)
    assert some.columns == ["obs_id", "S"] and some.where("obs_id = 17").collect()[0].S == "é17"
    dbf.write_dbf(df.where("false"), path + "0", "K")
    assert dbf.read_dbf(spark, path + "0").count() == 0


def test_dbf_beyond_two_gigabytes(spark, tmp_path):
    """A file of 2.4 GB (mostly a hole) reads in many tasks; its tail reads alone; a cut file is refused."""
    n, size, start = 12_000_000, 201, 65
    record = lambda k: b" " + str(k).rjust(200).encode()
    head = struct.pack("<4BIHH20x", 3, 112, 1, 1, n, start, size) + b"K".ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([200, 0]) + b"\0" * 14 + b"\r"
    with open(tmp_path / "big", "wb") as out:
        out.write(head)
        out.truncate(start + n * size)
        for k in range(n - 5, n):
            out.seek(start + k * size)
            out.write(record(k))
    df = dbf.read_dbf(spark, f"file://{tmp_path}/big")
    tail = dbf.read_dbf(spark, f"file://{tmp_path}/big", first=n - 5)
    assert [tuple(r) for r in tail.orderBy("obs_id").collect()] == [(k, k) for k in range(n - 5, n)]
    assert tail.rdd.getNumPartitions() == 1 and df.rdd.getNumPartitions() == -(-n // dbf.RECORDS)
    os.truncate(tmp_path / "big", 1 << 20)
    with pytest.raises(ValueError):
        dbf.read_dbf(spark, f"file://{tmp_path}/big")


def test_shapes_by_ranges(spark, path, tmp_path):
    df = geometry.grid(spark, 20, 30, 0, 0, 30, 20).withColumn("obs_id", F.col("obs_id") - 1).select("obs_id", "geom")
    shapefile.write_shapefile(df.repartition(6), path)
    want = sorted(map(str, df.collect()))
    many = shapefile.read_shp(spark, path + ".shp", records=50)
    assert many.rdd.getNumPartitions() == 12 and sorted(map(str, many.collect())) == want
    near = shapefile.read_shp(spark, path + ".shp", box=(0.5, 0.5, 1.5, 0.6), records=50)
    assert sorted(r.obs_id for r in near.collect()) == [570, 571]
    os.remove(tmp_path / "out.shx")
    assert sorted(map(str, shapefile.read_shp(spark, path + ".shp").collect())) == want
    (tmp_path / "bad.shp").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        shapefile.read_shp(spark, path.removesuffix("out") + "bad.shp")
