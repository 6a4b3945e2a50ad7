"""Delimited text, weights files and boundary text, read and written through Spark so that any store works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arealis.sources.placed import numbered, write_lines


def quote(x: Column) -> Column:
    """Quotes only where a quote or a comma stands: quotes inside are doubled."""
    return F.when(x.contains('"') | x.contains(","), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Ragged rows are errors, blank lines are skipped, every column's type is inferred, blanks are NULL."""
    raw = spark.read.csv(path, header=header, mode="FAILFAST", quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False)
    return typed(raw)


def ladder(raw: DataFrame) -> DataFrame:
    """One row (column, kind): bigint if all cells that are not blank are whole numbers, else double, else string."""
    cells = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in raw.columns]
    flags = [F.struct(F.lit(c).alias("column"), F.coalesce(F.bool_and(x.isNull() | x.try_cast("bigint").isNotNull()), F.lit(True)).alias("whole"), F.coalesce(F.bool_and(x.isNull() | x.try_cast("double").isNotNull()), F.lit(True)).alias("real")) for c, x in zip(raw.columns, cells, strict=True)]
    kind = F.when(F.col("s.whole"), "bigint").when(F.col("s.real"), "double").otherwise("string")
    return raw.agg(F.array(*flags).alias("a")).select(F.explode("a").alias("s")).select("s.column", kind.alias("kind"))


def typed(raw: DataFrame) -> DataFrame:
    kinds = {r["column"]: r["kind"] for r in ladder(raw).collect()}  # a row for each column
    return raw.select(*[F.when(F.trim(F.col(f"`{c}`")) != "", F.trim(F.col(f"`{c}`")) if k != "string" else F.col(f"`{c}`")).cast(k).alias(c) for c, k in kinds.items()])


def write_csv(df: DataFrame, path: str, order: str) -> None:
    """One file: a header, then rows in order."""
    head = ",".join('"' + c.replace('"', '""') + '"' if '"' in c or "," in c else c for c in df.columns)
    cells = [F.coalesce(quote(F.col(f"`{c}`").cast("string")), F.lit("")) for c in df.columns]
    write_lines(df.sparkSession, head, df.select(F.concat_ws(",", *cells).alias("value"), F.col(f"`{order}`").alias("order")), ["order"], path)


def _to_rows(w: DataFrame, keys: DataFrame | None, key: str | None) -> DataFrame:
    """File ids become obs_id through the key column, or by record order."""
    if keys is None:
        return w
    ids = keys.select(F.col(key).alias("_k"), "obs_id")
    out = w.join(ids, F.col("src") == F.col("_k")).drop("_k", "src").withColumnRenamed("obs_id", "src")
    return out.join(ids, F.col("dst") == F.col("_k")).drop("_k", "dst").withColumnRenamed("obs_id", "dst")


def read_gal(spark: SparkSession, path: str, keys: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """(src, dst) from pairs of lines: `id count`, then neighbours (maybe blank). Record-order ids count from the least one."""
    lines = numbered(spark, path).where("n > 0")
    body = lines.withColumn("pair", F.floor((F.col("n") - 1) / 2)).groupBy("pair").agg(F.max(F.when(F.col("n") % 2 == 1, F.col("line"))).alias("head"), F.max(F.when(F.col("n") % 2 == 0, F.col("line"))).alias("near"))
    body = body.where(F.trim("head") != "").select(F.split(F.trim("head"), r"\s+")[0].cast("long").alias("src"), F.coalesce("near", F.lit("")).alias("near"))
    w = body.select("src", F.explode(F.array_remove(F.split(F.trim("near"), r"\s+"), "")).alias("dst")).select("src", F.col("dst").cast("long").alias("dst"))
    if keys is None:
        least = body.agg(F.min("src").alias("_a"))
        return w.crossJoin(F.broadcast(least)).select((F.col("src") - F.col("_a")).alias("src"), (F.col("dst") - F.col("_a")).alias("dst"))
    return _to_rows(w, keys, key).select("src", "dst")


def read_gwt(spark: SparkSession, path: str, keys: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """(src, dst, w): a line for each pair."""
    parts = F.split(F.trim("line"), r"\s+")
    w = numbered(spark, path).where("n > 0").where(F.trim("line") != "").select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"), parts[2].cast("double").alias("w"))
    return w if keys is None else _to_rows(w, keys, key).select("src", "dst", "w")


def as_contiguity(w: DataFrame) -> DataFrame:
    """A distance file read as contiguity: the weight is dropped."""
    return w.select("src", "dst")


def gal_lines(obs: DataFrame, w: DataFrame, key: str = "obs_id") -> DataFrame:
    """Two lines for each observation in order of the key; neighbours in descending order."""
    near = w.groupBy(F.col("src").alias(key)).agg(F.reverse(F.sort_array(F.collect_list("dst"))).alias("d"))
    full = obs.select(key).join(near, key, "left").withColumn("d", F.coalesce("d", F.expr("cast(array() as array<bigint>)")))
    return full.select(F.col(key).alias("n"), F.concat(F.col(key).cast("string"), F.lit(" "), F.size("d"), F.lit("\n"), F.array_join("d", " ")).alias("value"))


def gwt_lines(w: DataFrame) -> DataFrame:
    """Pairs with weights of nine significant digits in a field of 18."""
    return w.select("src", "dst", F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), F.format_string("%18.9g", "w")).alias("value"))


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Header `n,idname`; for each polygon `id,npoints` and its vertices. Gives obs_id, id, geom (closed rings); areas come from geometry.area_perimeter."""
    parts = F.split(F.trim("line"), r"\s*[,\s]\s*")
    lines = numbered(spark, path).where("n > 0").where(F.trim("line") != "").select("n", parts[0].alias("a"), parts[1].alias("b"))

    def rings(pdf):
        import pandas as pd

        out, i, rows = [], 0, pdf.sort_values("n")[["a", "b"]].values.tolist()
        while i < len(rows):
            key, count = int(float(rows[i][0])), int(float(rows[i][1]))
            ring = [{"x": float(x), "y": float(y)} for x, y in rows[i + 1 : i + 1 + count]]
            ring += [] if not ring or ring[0] == ring[-1] else [ring[0]]
            out.append({"obs_id": len(out), "id": key, "geom": {"type": 5, "parts": [0], "points": ring}})
            i += 1 + count
        return pd.DataFrame(out)

    from arealis.operators.geometry import GEOM

    return lines.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(rings, f"obs_id long, id long, geom {GEOM}")  # a file is one chain of counts


def boundary_lines(df: DataFrame, key: str, header: bool = True, closed: bool = True, box: bool = False) -> DataFrame:
    """(n, value): each polygon's head and vertices with ten decimals; the four forms differ by header and closing vertex; `box` adds the bounding box to heads."""
    pts = F.col("geom.points") if closed else F.expr("slice(geom.points, 1, size(geom.points) - 1)")
    line = F.array_join(F.transform(pts, lambda p: F.format_string("%.10f,%.10f", p["x"], p["y"])), "\n")
    corner = [F.expr(f"array_{f}(transform(geom.points, p -> p.{a}))") for f, a in (("min", "x"), ("min", "y"), ("max", "x"), ("max", "y"))]
    head = F.concat_ws(",", F.col(key).cast("string"), F.size(pts).cast("string"), *[F.format_string("%.10f", c) for c in corner if box])
    return df.select(F.col(key).alias("n"), F.concat(head, F.lit("\n"), line).alias("value") if header else line.alias("value"))


def read_ascii_points(spark: SparkSession, path: str) -> DataFrame:
    """Lines `id,x,y` become a point layer."""
    from arealis.operators.geometry import point

    raw = spark.read.csv(path, schema="id long, x double, y double", mode="FAILFAST")
    return raw.withColumn("geom", point("x", "y"))
