"""Classification themes: classes are numbered from 1; break tables are one row and are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealis.functions.calc import spread
from arealis.operators.breaks import find_breaks
from arealis.operators.rank import attach, hazen, hinges, in_order

MOST_CLASSES = 10


def _keep(found: DataFrame, df: DataFrame, out: str) -> DataFrame:
    return found.select(*[c for c in df.columns if c != out], out)


def themeless(df: DataFrame, out: str = "cat") -> DataFrame:
    return df.withColumn(out, F.lit(1))


def quantile(df: DataFrame, x: str, key: str, classes: int, out: str = "cat", by: list[str] | None = None) -> DataFrame:
    """Hazen breaks; the lower half of them is open above, the upper half closed."""
    if not 1 <= classes <= MOST_CLASSES:
        raise ValueError(f"1 to {MOST_CLASSES} classes")
    found = attach(df, hazen(df, x, key, [100.0 * j / classes for j in range(1, classes)], by), by)
    tests = [((F.col(x) < F.col(f"p{j}")) if j < classes // 2 else (F.col(x) <= F.col(f"p{j}")), j + 1) for j in range(classes - 1)]
    return _keep(found.withColumn(out, in_order(*tests, default=classes) if tests else F.lit(1)), df, out)


def percentile(df: DataFrame, x: str, key: str, out: str = "cat", by: list[str] | None = None) -> DataFrame:
    found = attach(df, hazen(df, x, key, [1.0, 10.0, 50.0, 90.0, 99.0], by), by)
    v = F.col(x)
    return _keep(found.withColumn(out, in_order((v < F.col("p0"), 1), (v < F.col("p1"), 2), (v <= F.col("p2"), 3), (v <= F.col("p3"), 4), (v <= F.col("p4"), 5), default=6)), df, out)


def box(df: DataFrame, x: str, key: str, hinge: float = 1.5, out: str = "cat", by: list[str] | None = None) -> DataFrame:
    """1 below the lower fence, 2 below q1, 3 up to the median, 4 up to q3, 5 up to the upper fence, 6 above."""
    h = hinges(df, x, key, by).select(*(by or []), "q1", "q2", "q3").withColumn("_w", hinge * (F.col("q3") - F.col("q1")))
    found, v = attach(df, h, by), F.col(x)
    return _keep(found.withColumn(out, in_order((v < F.col("q1") - F.col("_w"), 1), (v < F.col("q1"), 2), (v <= F.col("q2"), 3), (v <= F.col("q3"), 4), (v <= F.col("q3") + F.col("_w"), 5), default=6)), df, out)


def standard_deviation(df: DataFrame, x: str, out: str = "cat", by: list[str] | None = None) -> DataFrame:
    aggs = [F.avg(x).alias("_m"), F.sqrt(spread(x)).alias("_s")]
    found, v = attach(df, df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs), by), F.col(x)
    m, s = F.col("_m"), F.col("_s")
    return _keep(found.withColumn(out, in_order((v < m - 2 * s, 1), (v < m - s, 2), (v <= m, 3), (v <= m + s, 4), (v <= m + 2 * s, 5), default=6)), df, out)


def unique_values(df: DataFrame, x: str, out: str = "cat") -> DataFrame:
    """A class for each value; with more than ten values, natural breaks of ten classes instead."""
    values = df.where(F.col(x).isNotNull()).select(x).distinct()
    if values.limit(MOST_CLASSES + 1).count() > MOST_CLASSES:
        return natural_breaks(df, x, MOST_CLASSES, out)
    numbered = values.withColumn(out, F.row_number().over(Window.orderBy(x)))  # ten rows at most
    return df.join(F.broadcast(numbered), x, "left")


def natural_breaks(df: DataFrame, x: str, classes: int, out: str = "cat") -> DataFrame:
    """Exact natural breaks at every size, see `breaks`; NULL falls into the last class."""
    values = df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return by_breaks(df, x, find_breaks(values, classes), out)


def by_breaks(df: DataFrame, x: str, breaks: list[float], out: str = "cat") -> DataFrame:
    """Class j + 1 from the j-th break upwards."""
    return df.withColumn(out, in_order(*[(F.col(x) < b, j + 1) for j, b in enumerate(breaks)], default=len(breaks) + 1) if breaks else F.lit(1))


def goodness_of_fit(df: DataFrame, x: str, cat: str = "cat") -> DataFrame:
    """gvf: the share of squared deviations that classes explain."""
    within = df.groupBy(cat).agg((F.var_pop(x) * F.count(x)).alias("_w")).agg(F.sum("_w").alias("_w"))
    total = df.agg((F.var_pop(x) * F.count(x)).alias("_t"))
    return total.crossJoin(F.broadcast(within)).select(F.when(F.col("_t") > 0, 1 - F.try_divide("_w", "_t")).otherwise(1.0).alias("gvf"))


def equal_intervals(df: DataFrame, x: str, classes: int, out: str = "cat", by: list[str] | None = None) -> DataFrame:
    aggs = [F.min(x).alias("_a"), F.max(x).alias("_b")]
    found = attach(df, df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs), by)
    width = (F.col("_b") - F.col("_a")) / classes
    tests = [(F.col("_a") == F.col("_b"), 1), *((F.col(x) < F.col("_a") + j * width, j) for j in range(1, classes))]
    return _keep(found.withColumn(out, in_order(*tests, default=classes)), df, out)


def excess_risk_classes(df: DataFrame, x: str, out: str = "cat") -> DataFrame:
    v = F.col(x)
    return df.withColumn(out, in_order((v < 0.25, 1), (v < 0.5, 2), (v <= 1.0, 3), (v <= 2.0, 4), (v <= 4.0, 5), default=6))


def legend(df: DataFrame, x: str, cat: str = "cat", by: list[str] | None = None) -> DataFrame:
    """Per class: n, min_v, max_v."""
    return df.groupBy(*(by or []), cat).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("min_v"), F.max(x).alias("max_v"))
