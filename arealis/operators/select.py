"""Selections: every operator sets or changes the boolean column `selected`; with `extend` it adds to what is selected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealis.functions.calc import seed_rank


def _mark(df: DataFrame, test: Column, extend: bool = False) -> DataFrame:
    test = F.coalesce(test, F.lit(False))
    return df.withColumn("selected", test | F.col("selected") if extend and "selected" in df.columns else test)


def in_range(df: DataFrame, x: str, low: float, high: float, extend: bool = False) -> DataFrame:
    """Closed range; whole-number columns compare with ceil(low) and floor(high)."""
    whole = dict(df.dtypes)[x] in ("int", "bigint", "smallint", "tinyint")
    a, b = (F.ceil(F.lit(low)), F.floor(F.lit(high))) if whole else (F.lit(low), F.lit(high))
    return _mark(df, F.col(x).between(a, b), extend)


def undefined(df: DataFrame, x: str, extend: bool = False) -> DataFrame:
    return _mark(df, F.col(x).isNull(), extend)


def invert(df: DataFrame) -> DataFrame:
    return df.withColumn("selected", ~F.col("selected"))


def at_random(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Each row with probability one half, by the first bit of a hash of seed and key."""
    return _mark(df, F.substring(seed_rank(seed, F.col(key)), 1, 1).isin(*"01234567"))


def everything(df: DataFrame, value: bool = True) -> DataFrame:
    return df.withColumn("selected", F.lit(value))


def add_neighbours(df: DataFrame, w: DataFrame, key: str = "obs_id") -> DataFrame:
    chosen = df.where("selected").select(F.col(key).alias("src"))
    near = w.join(chosen, "src", "left_semi").select(F.col("dst").alias(key)).distinct().withColumn("_near", F.lit(True))
    return df.join(near, key, "left").withColumn("selected", F.col("selected") | F.coalesce("_near", F.lit(False))).drop("_near")


def save(df: DataFrame, out: str, inside=None, outside=None) -> DataFrame:
    """Write constants for selected and unselected rows; a missing one leaves the column as it is (NULL if new)."""
    old = F.col(out) if out in df.columns else F.lit(None)
    a = old if inside is None else F.lit(inside)
    return df.withColumn(out, F.when(F.col("selected"), a).otherwise(old if outside is None else F.lit(outside)))


def category(df: DataFrame, cat: str, value: int, extend: bool = False) -> DataFrame:
    return _mark(df, F.col(cat) == value, extend)


def toggle(df: DataFrame, test: Column) -> DataFrame:
    return df.withColumn("selected", F.when(F.coalesce(test, F.lit(False)), ~F.col("selected")).otherwise(F.col("selected")))


def rectangle(df: DataFrame, x0: float, y0: float, x1: float, y1: float, extend: bool = False) -> DataFrame:
    return _mark(df, F.col("x").between(min(x0, x1), max(x0, x1)) & F.col("y").between(min(y0, y1), max(y0, y1)), extend)


def circle(df: DataFrame, cx: float, cy: float, r: float, extend: bool = False) -> DataFrame:
    return _mark(df, (F.col("x") - cx) ** 2 + (F.col("y") - cy) ** 2 <= r * r, extend)


def line(df: DataFrame, x0: float, y0: float, x1: float, y1: float, width: float = 3.0, extend: bool = False) -> DataFrame:
    """Inside the rectangle of the ends and within `width` of the line: |cross product| <= width * length."""
    cross = (x1 - x0) * (F.col("y") - y0) - (y1 - y0) * (F.col("x") - x0)
    length = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
    inside = F.col("x").between(min(x0, x1), max(x0, x1)) & F.col("y").between(min(y0, y1), max(y0, y1))
    return _mark(df, inside & (F.abs(cross) <= width * length), extend)


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Do segments ab and cd meet? By the turns of three points at a time, touching included."""
    turn = lambda px, py, qx, qy, rx, ry: F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))
    on = lambda px, py, qx, qy, rx, ry: rx.between(F.least(px, qx), F.greatest(px, qx)) & ry.between(F.least(py, qy), F.greatest(py, qy))
    c = [v if isinstance(v, Column) else F.lit(float(v)) for v in (ax, ay, bx, by, cx, cy, dx, dy)]
    a, b, p, q = c[0:2], c[2:4], c[4:6], c[6:8]
    t1, t2, t3, t4 = turn(*a, *b, *p), turn(*a, *b, *q), turn(*p, *q, *a), turn(*p, *q, *b)
    proper = (t1 != t2) & (t3 != t4)
    touch = ((t1 == 0) & on(*a, *b, *p)) | ((t2 == 0) & on(*a, *b, *q)) | ((t3 == 0) & on(*p, *q, *a)) | ((t4 == 0) & on(*p, *q, *b))
    return proper | touch


def crossing(df: DataFrame, x0: float, y0: float, x1: float, y1: float, extend: bool = False) -> DataFrame:
    """Line shapes (x, y) to (x2, y2) that the segment meets."""
    return _mark(df, segments_cross(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"), x0, y0, x1, y1), extend)


def cores(found: DataFrame, w: DataFrame, key: str, what: str = "cores", cluster: str = "cluster", p: str = "p", codes: tuple[int, ...] = (1, 2, 3, 4), level: float = 0.05) -> DataFrame:
    """Select significant cores, their neighbours that are no cores ('neighbours'), or both."""
    core = F.col(cluster).isin(*codes) & (F.col(p) <= level)
    marked = _mark(found, core)
    if what == "cores":
        return marked
    both = add_neighbours(marked, w, key)
    return both if what == "both" else both.withColumn("selected", F.col("selected") & ~F.coalesce(core, F.lit(False)))
