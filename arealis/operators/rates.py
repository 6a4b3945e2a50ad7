"""Rates of events e over bases p. A missing value or a base of 0 or less makes the whole result NULL, as the calculator aborts then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _checked(df: DataFrame, e: str, p: str, by: list[str]) -> DataFrame:
    bad = F.max(F.when(F.col(e).isNull() | F.col(p).isNull() | (F.col(p) <= 0), 1).otherwise(0)).alias("_bad")
    sums = [bad, F.sum(e).alias("_E"), F.sum(p).alias("_P"), F.count(F.lit(1)).alias("_n")]
    stats = df.groupBy(*by).agg(*sums) if by else df.agg(*sums)
    return df.join(stats, by) if by else df.crossJoin(F.broadcast(stats))


def _done(df: DataFrame, value: Column, out: str) -> DataFrame:
    return df.withColumn(out, F.when(F.col("_bad") == 0, value)).drop(*[c for c in df.columns if c.startswith("_")])


def raw_rate(df: DataFrame, e: str, p: str, out: str, by: list[str] | None = None) -> DataFrame:
    return _done(_checked(df, e, p, by or []), F.when(F.col(p) > 0, F.try_divide(F.col(e), F.col(p))).otherwise(F.lit(0.0)), out)


def excess_risk(df: DataFrame, e: str, p: str, out: str, by: list[str] | None = None) -> DataFrame:
    found = _checked(df, e, p, by or [])
    expected = F.col(p) * F.when(F.col("_P") > 0, F.try_divide(F.col("_E"), F.col("_P"))).otherwise(F.lit(1.0))
    return _done(found, F.when(expected > 0, F.try_divide(F.col(e), expected)), out)


def _second(found: DataFrame, e: str, p: str, by: list[str]) -> DataFrame:
    """The prior mean _b and variance _a; the variance needs the mean, so it is a second pass."""
    found = found.withColumn("_b", F.try_divide(F.col("_E"), F.col("_P"))).withColumn("_r", F.try_divide(F.col(e), F.col(p)))
    part = F.sum(F.col(p) * (F.col("_r") - F.col("_b")) ** 2).alias("_v")
    stats = found.groupBy(*by).agg(part) if by else found.agg(part)
    found = found.join(stats, by) if by else found.crossJoin(F.broadcast(stats))
    return found.withColumn("_a", F.greatest(F.lit(0.0), F.try_divide(F.col("_v"), F.col("_P")) - F.try_divide(F.col("_b"), F.col("_P") / F.col("_n"))))


def _shrunk(e: str, p: str) -> Column:
    weight = F.coalesce(F.try_divide(F.col("_a"), F.col("_a") + F.try_divide(F.col("_b"), F.col(p))), F.lit(0.0))
    return weight * F.col("_r") + (1 - weight) * F.col("_b")


def empirical_bayes(df: DataFrame, e: str, p: str, out: str, by: list[str] | None = None) -> DataFrame:
    return _done(_second(_checked(df, e, p, by or []), e, p, by or []), _shrunk(e, p), out)


def eb_standardize(df: DataFrame, e: str, p: str, out: str, by: list[str] | None = None) -> DataFrame:
    found = _second(_checked(df, e, p, by or []), e, p, by or [])
    se = F.sqrt(F.col("_a") + F.try_divide(F.col("_b"), F.col(p)))
    return _done(found, F.when(se > 0, F.try_divide(F.col("_r") - F.col("_b"), se)).otherwise(F.lit(0.0)), out)


def _around(df: DataFrame, w: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Rows (src, dst's values) of each observation's neighbours and itself, with k (its neighbours)."""
    own = w.select("src", "dst").unionAll(w.select("src", F.col("src").alias("dst")).distinct())
    return own.join(df.withColumnRenamed(key, "dst"), "dst")


def spatial_rate(df: DataFrame, w: DataFrame, key: str, e: str, p: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Sums over an observation and its neighbours; NULL without neighbours, -9999 where the base is not positive."""
    by = by or []
    near = _around(df.select(key, *by, e, p), w, key, by).groupBy("src", *by).agg(F.sum(e).alias("_ne"), F.sum(p).alias("_np"))
    found = _checked(df, e, p, by).join(near.withColumnRenamed("src", key), [key, *by], "left")
    return _done(found, F.when(F.col("_np").isNull(), None).when(F.col("_np") <= 0, F.lit(-9999.0)).otherwise(F.try_divide(F.col("_ne"), F.col("_np"))), out)


def spatial_empirical_bayes(df: DataFrame, w: DataFrame, key: str, e: str, p: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Shrinkage towards the mean of an observation and its neighbours; NULL without neighbours."""
    by = by or []
    near = _around(df.select(key, *by, e, p), w, key, by)
    first = near.groupBy("src", *by).agg(F.sum(e).alias("_E"), F.sum(p).alias("_P"), F.count(F.lit(1)).alias("_n")).withColumn("_b", F.try_divide(F.col("_E"), F.col("_P")))
    second = near.join(first, ["src", *by]).groupBy("src", *by).agg(F.sum(F.col(p) * (F.try_divide(F.col(e), F.col(p)) - F.col("_b")) ** 2).alias("_v"))
    local = first.join(second, ["src", *by]).withColumn("_a", F.greatest(F.lit(0.0), F.try_divide(F.col("_v"), F.col("_P")) - F.try_divide(F.col("_b"), F.col("_P") / F.col("_n")))).withColumnRenamed("src", key)
    found = _checked(df, e, p, by).drop("_E", "_P", "_n").join(local, [key, *by], "left").withColumn("_r", F.try_divide(F.col(e), F.col(p)))
    return _done(found, F.when(F.col("_b").isNotNull(), _shrunk(e, p)), out)
