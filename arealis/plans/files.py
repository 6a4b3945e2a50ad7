"""Source and sink queries: whole tables are written to the shared folder in each format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.operators import geometry, weights
from arealis.operators.cut import shared_folder
from arealis.plans.base import NAT, SUP, WQ, query
from arealis.sources import dbf, shapefile, text

BAND = "bd AS (SELECT a.obs_id AS src, b.obs_id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS w FROM sup a JOIN sup b ON a.obs_id <> b.obs_id WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1.5)"


def _path(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/files/{name}-{uuid.uuid4().hex}"


def _extent(df: DataFrame) -> DataFrame:
    """Number of vertices and the corners of the bounding box."""
    return df.withColumns({"n": F.size("geom.points"), **{f"{f}_{a}": F.expr(f"array_{f}(transform(geom.points, p -> p.{a}))") for f in ("min", "max") for a in "xy"}})


@query("io01_dbf_round_trip", "obs_id:i okey:i price:f odate:s status:s", "", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS obs_id, o_orderkey AS okey, o_totalprice AS price, CAST(o_orderdate AS DATE) AS odate, o_orderstatus AS status FROM orders")
def _io01(t):
    path = _path(t, "orders") + ".dbf"
    dbf.write_dbf(t.orders.select(F.col("o_orderkey").alias("okey"), F.col("o_totalprice").alias("price"), F.to_date("o_orderdate").alias("odate"), F.col("o_orderstatus").alias("status")), path, "okey")
    return dbf.read_dbf(t.spark, path)


@query("io06_polygon_round_trip", "obs_id:i name:s n:i min_x:f min_y:f max_x:f max_y:f", NAT, "SELECT obs_id, n_name AS name, 5 AS n, x AS min_x, y AS min_y, x + 1 AS max_x, y + 1 AS max_y FROM nat JOIN nation ON n_nationkey = obs_id")
def _io06(t):
    path = _path(t, "nations")
    layer = t.lattice().join(t.nation.select(F.col("n_nationkey").cast("long").alias("obs_id"), F.col("n_name").alias("name")), "obs_id")
    shapefile.write_shapefile(layer.select("obs_id", "name", "geom"), path)
    return _extent(shapefile.read_shapefile(t.spark, path))


@query("io07_point_round_trip", "skey:i x:f y:f v:f", SUP, "SELECT obs_id AS skey, x, y, v FROM sup")
def _io07(t):
    path = _path(t, "suppliers")
    layer = t.suppliers().select(F.col("obs_id").alias("skey"), geometry.point("x", "y").alias("geom"), "v")
    shapefile.write_shapefile(layer, path, "skey")
    return shapefile.read_shapefile(t.spark, path).select("skey", F.col("geom.points")[0]["x"].alias("x"), F.col("geom.points")[0]["y"].alias("y"), "v")


@query("io08_csv_round_trip", "ckey:i name:s bal:f", "", "SELECT c_custkey AS ckey, c_name AS name, c_acctbal AS bal FROM customer")
def _io08(t):
    path = _path(t, "customers")
    text.write_csv(t.customer.select(F.col("c_custkey").alias("ckey"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal")), path, "ckey")
    return text.read_csv(t.spark, path)


@query("io12_gal_round_trip", "src:i dst:i", WQ, "SELECT * FROM wq")
def _io12(t):
    path = _path(t, "gal")
    text.write_lines(t.spark, "0 25 nations ID", text.gal_lines(t.lattice(), t.queen()), ["n"], path)
    return text.read_gal(t.spark, path)


@query("io13_gwt_round_trip", "src:i dst:i w:f", f"{SUP}, {BAND}", "SELECT * FROM bd")
def _io13(t):
    path = _path(t, "gwt")
    text.write_lines(t.spark, "0 suppliers ID", text.gwt_lines(weights.distance_band(t.suppliers(), 1.5)), ["src", "dst"], path)
    return text.read_gwt(t.spark, path)


@query("io16_boundary_round_trip", "id:i n:i min_x:f min_y:f max_x:f max_y:f", NAT, "SELECT obs_id AS id, 5 AS n, x AS min_x, y AS min_y, x + 1 AS max_x, y + 1 AS max_y FROM nat")
def _io16(t):
    path = _path(t, "boundaries")
    text.write_lines(t.spark, "25,ID", text.boundary_lines(t.lattice(), "obs_id"), ["n"], path)
    return _extent(text.read_boundaries(t.spark, path))


@query("io18_ascii_points", "id:i x:f y:f", SUP, "SELECT obs_id AS id, x, y FROM sup")
def _io18(t):
    path = _path(t, "points")
    t.suppliers().select("obs_id", "x", "y").write.csv(path)
    return text.read_ascii_points(t.spark, path)
