"""Round trips of files, and the stream extension."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from arealis.operators import geometry, tables
from arealis.sources import dbf, shapefile, text
from arealis.streaming import events


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def test_dbf_round_trip(spark, path):
    rows = [(0, 7, -1.25, "ab", datetime.date(2001, 2, 3)), (1, None, None, "", None)]
    df = spark.createDataFrame(rows, "obs_id long, K long, V double, S string, D date")
    dbf.write_dbf(df, path, "obs_id")
    assert [tuple(r) for r in dbf.read_dbf(spark, path).orderBy("obs_id").collect()] == rows


def test_space_time_tables(spark, path):
    space = spark.createDataFrame([(0, 10, 1.0), (1, 20, 2.0)], "obs_id long, SID long, A double")
    time = spark.createDataFrame([(20, 1, 5.0), (10, 1, 6.0), (10, 2, 7.0), (20, 2, 8.0)], "SID long, T long, V double")
    dbf.write_space_time(space, time, "SID", "T", path + "s", path + "t")
    got = dbf.read_space_time(spark, path + "s", path + "t")
    assert sorted((r.SID, r.T, r.A, r.V) for r in got.collect()) == [(10, 1, 1.0, 6.0), (10, 2, 1.0, 7.0), (20, 1, 2.0, 5.0), (20, 2, 2.0, 8.0)]
    with pytest.raises(ValueError):
        dbf.discover_space_time(space, time.select("V"))


def test_shapefile_round_trip(spark, path):
    df = geometry.grid(spark, 2, 3, 0, 0, 3, 2).withColumn("obs_id", F.col("obs_id") - 1).select("obs_id", "area", "geom")
    shapefile.write_shapefile(df, path)
    back = shapefile.read_shapefile(spark, path)
    assert sorted(map(str, back.select("obs_id", "geom").collect())) == sorted(map(str, df.select("obs_id", "geom").collect()))
    pts = spark.createDataFrame([(0, 1.5, 2.5)], "obs_id long, x double, y double").select("obs_id", geometry.point("x", "y").alias("geom"), "x")
    shapefile.write_shapefile(pts, path + "p")
    assert shapefile.read_shp(spark, path + "p.shp").select("geom.points").first()[0][0]["y"] == 2.5


def test_csv(spark, path, tmp_path):
    assert spark.createDataFrame([('6"',), ("1,2,3",), ("plain",)], "v string").select(text.quote(F.col("v"))).toPandas().iloc[:, 0].tolist() == ['"6"""', '"1,2,3"', "plain"]
    df = spark.createDataFrame([(1, 1.5, 'a"b'), (2, None, "x,y")], "a long, b double, c string")
    text.write_csv(df.repartition(1), path, "a")
    assert [tuple(r) for r in text.read_csv(spark, path).orderBy("a").collect()] == [(1, 1.5, 'a"b'), (2, None, "x,y")]


def test_weights_files(spark, path):
    obs = spark.createDataFrame([(i, 100 + i) for i in range(4)], "obs_id long, ID long")
    w = spark.createDataFrame([(0, 1, 10.0), (1, 0, 10.0), (1, 2, 12.5), (2, 1, 12.5)], "src long, dst long, w double")
    text.write_lines(spark, "0 4 demo ID", text.gal_lines(obs, w), ["n"], path + "gal")
    assert sorted(map(tuple, text.read_gal(spark, path + "gal").collect())) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    text.write_lines(spark, "0 4 demo ID", text.gwt_lines(w), ["src", "dst"], path + "gwt")
    assert sorted(map(tuple, text.read_gwt(spark, path + "gwt").collect())) == sorted(map(tuple, w.collect()))
    keyed = spark.createDataFrame([(f"0 2 demo ID\n101 1\n100\n100 1\n101",)], "value string")
    keyed.write.text(path + "k")
    assert sorted(map(tuple, text.read_gal(spark, path + "k", obs, "ID").collect())) == [(0, 1), (1, 0)]


def test_boundaries(spark, path):
    df = geometry.grid(spark, 1, 2, 0, 0, 2, 1)
    text.write_lines(spark, "2,ID", text.boundary_lines(df, "obs_id"), ["n"], path)
    back = text.read_boundaries(spark, path).withColumns(geometry.area_perimeter())
    assert [(r["id"], r["area"], r["perimeter"]) for r in back.orderBy("obs_id").collect()] == [(1, 1.0, 4.0), (2, 1.0, 4.0)]


def test_table_helpers(spark):
    df = spark.createDataFrame([(0, 5), (1, 6)], "obs_id long, v long")
    assert tables.edit_cell(df, "obs_id", 1, "v", 9).orderBy("obs_id").toPandas()["v"].tolist() == [5, 9]
    assert tables.name_is_valid("AB_1") and not tables.name_is_valid("1A") and not tables.name_is_valid("A" * 11)
    with pytest.raises(ValueError):
        tables.add_variable(df, "V", "double")


def test_stream_equals_batch(spark, path):
    rows = [(i, datetime.datetime(2024, 1, 1 + i % 5, i % 24), i % 3, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double")
    df.write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    q = events.daily(stream).writeStream.format("memory").queryName("daily_events").outputMode("complete").option("checkpointLocation", path + "_c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("daily_events").collect())) == sorted(map(tuple, events.daily(df).collect()))
