"""Distributions and simple statistics. Tails that a Column needs are polynomials; the others run on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abramowitz and Stegun 26.2.17.
NORMAL_T = 0.2316419
NORMAL_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0 within 7.5e-8."""
    t = 1 / (1 + NORMAL_T * z)
    sum_ = F.lit(0.0)
    for b in reversed(NORMAL_B):
        sum_ = (sum_ + b) * t
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * sum_


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_tail(x: float, df: float) -> float:
    """Upper tail, by the series below df + 2 and a continued fraction above."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def summary(df: DataFrame, x: str, by: list[str] | None = None) -> DataFrame:
    """n, min, max, mean, var_n, var_n1 (both 0 for one value), sd."""
    both = F.coalesce(F.var_samp(x), F.var_pop(x))
    aggs = [F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.var_pop(x).alias("var_n"), both.alias("var_n1"), F.sqrt(both).alias("sd")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def simple_regression(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """slope, intercept, r2, se_slope, se_intercept, t_slope, sse and n of y on x from one pass."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"), F.covar_pop(x, y).alias("_c")]
    s = ok.groupBy(*(by or [])).agg(*aggs) if by else ok.agg(*aggs)
    s = s.withColumn("slope", F.try_divide("_c", "_vx")).withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx"))
    s = s.withColumn("sse", F.greatest(F.lit(0.0), F.col("n") * (F.col("_vy") - F.col("slope") * F.col("_c"))))
    s = s.withColumn("r2", F.when(F.col("sse") < 16 * 2.2250738585072014e-308, 1.0).otherwise(1 - F.try_divide(F.col("sse"), F.col("n") * F.col("_vy"))))
    sigma2 = F.try_divide(F.col("sse"), F.col("n") - 2)
    s = s.withColumn("se_slope", F.sqrt(F.try_divide(sigma2, F.col("n") * F.col("_vx")))).withColumn("se_intercept", F.sqrt(sigma2 * (F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(F.col("_mx") * F.col("_mx"), F.col("n") * F.col("_vx")))))
    s = s.withColumn("t_slope", F.when(F.col("se_slope") > 16 * 2.2250738585072014e-308, F.try_divide("slope", "se_slope")).otherwise(100.0))
    return s.drop("_mx", "_my", "_vx", "_vy", "_c")


def tail_column(fn, *columns: Column) -> Column:
    """One of the tails above as a column, NULL where an argument is."""
    import pandas as pd

    def run(*parts: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else fn(*map(float, row)) for row in zip(*parts, strict=True)], dtype="f8")

    several = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c)}[len(columns)]
    return F.pandas_udf(several, "double")(*[c.cast("double") for c in columns])
