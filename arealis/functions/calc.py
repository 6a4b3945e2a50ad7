"""The column calculator: NULL in gives NULL out, and so does every domain error; nothing raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _d(x: Column | str | float) -> Column:
    return (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)).cast("double")


def finite(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def assign(x) -> Column:
    return _d(x)


def negative(x) -> Column:
    return -_d(x)


def invert(x) -> Column:
    return F.when(_d(x) != 0, F.try_divide(F.lit(1.0), _d(x)))


def square_root(x) -> Column:
    return F.when(_d(x) >= 0, F.sqrt(_d(x)))


def log_ten(x) -> Column:
    return F.when(_d(x) > 0, F.log10(_d(x)))


def log_natural(x) -> Column:
    return F.when(_d(x) > 0, F.ln(_d(x)))


def add(x, y) -> Column:
    return finite(_d(x) + _d(y))


def subtract(x, y) -> Column:
    return finite(_d(x) - _d(y))


def multiply(x, y) -> Column:
    return finite(_d(x) * _d(y))


def divide(x, y) -> Column:
    return F.when(_d(y) != 0, finite(F.try_divide(_d(x), _d(y))))


def power(x, y) -> Column:
    x, y = _d(x), _d(y)
    bad = ((x == 0) & (y < 0)) | ((x < 0) & (y != F.floor(y)))
    return F.when(~bad, finite(F.pow(x, y)))


def one_row(df: DataFrame, *aggregates: Column) -> DataFrame:
    """Global aggregates as one row, ready to be broadcast: one row is a proven bound."""
    return F.broadcast(df.agg(*aggregates))


def spread(x: str) -> Column:
    """Sample variance; that of a single value is 0."""
    return F.coalesce(F.var_samp(x), F.var_pop(x))


def _whole(df: DataFrame, x: str, by: list[str], *aggregates: Column) -> DataFrame:
    stats = df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)
    return df.join(stats, by) if by else df.crossJoin(F.broadcast(stats))


def _complete(x: str) -> Column:
    """A whole-column operation gives nothing when any value is missing."""
    return F.count(F.lit(1)) == F.count(x)


def deviation_from_mean(df: DataFrame, x: str, out: str, by: list[str] | None = None) -> DataFrame:
    """x less its mean, within each group of `by`; NULL throughout a group with a missing value."""
    found = _whole(df, x, by or [], F.avg(x).alias("_m"), _complete(x).alias("_ok"))
    return found.withColumn(out, F.when(F.col("_ok"), F.col(x) - F.col("_m"))).drop("_m", "_ok")


def standardize(df: DataFrame, x: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Deviations over the sample deviation; a constant column gives zeros."""
    found = _whole(df, x, by or [], F.avg(x).alias("_m"), F.sqrt(spread(x)).alias("_s"), _complete(x).alias("_ok"))
    z = F.when(F.col("_s") > 0, F.try_divide(F.col(x) - F.col("_m"), F.col("_s"))).otherwise(F.lit(0.0))
    return found.withColumn(out, F.when(F.col("_ok"), z)).drop("_m", "_s", "_ok")


def seed_rank(seed: int, *parts: Column) -> Column:
    """A random key that any engine with md5 gives alike."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def shuffle(df: DataFrame, x: str, key: str, out: str, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """A uniform permutation of the values, NULLs included, within each group of `by`."""
    from arealis.operators.rank import ranked

    by = by or []
    places = ranked(df, key, "_k", by=by, ties=[key])
    drawn = ranked(df.select(*by, F.col(x).alias(out), seed_rank(seed, F.col(key)).alias("_h")), "_h", "_k", by=by, ties=["_h"]).drop("_h")
    return places.join(drawn, [*by, "_k"]).drop("_k")


def normal_random(seed: int, mean: float = 0.0, sd: float = 1.0) -> Column:
    return F.randn(seed) * sd + mean


def uniform_random(seed: int) -> Column:
    return F.rand(seed)


def enumerate_rows(df: DataFrame, key: str, out: str, by: list[str] | None = None) -> DataFrame:
    """1..n in order of the key."""
    from arealis.operators.rank import ranked

    return ranked(df, key, out, by=by or [], ties=[key])
