"""Themes, exploratory views, geometry and regression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from arealis.functions.calc import standardize
from arealis.functions.stats import simple_regression, summary
from arealis.operators import classify, explore, geometry, rates, regression, rings, voronoi, weights
from arealis.operators.cut import cut, dealt
from arealis.plans.base import CUS, LAG, NAT, NY, PAR, SUP, VAL, WQ, query
from arealis.plans.calculator import HINGES, RANKS, REG, _haz
from arealis.streaming import events as streams

# Themes


def _theme(name, fn, ctes, expr, source="par", spec="obs_id:i cat:i"):
    query(name, spec, ctes, f"SELECT obs_id, {expr} AS cat FROM {source}")(fn)


HZ = f"{RANKS}, hz AS (SELECT {', '.join(f'{_haz(p)} AS h{str(p).replace(chr(46), chr(95))}' for p in (1.0, 10.0, 20.0, 25.0, 40.0, 50.0, 60.0, 75.0, 80.0, 90.0, 99.0))} FROM rk), ph AS (SELECT par.*, hz.* FROM par, hz)"
HG = f"{RANKS}, hg AS ({HINGES}), pb AS (SELECT par.*, q1, q2, q3, q3 - q1 AS iqr FROM par, hg)"
BOX = "CASE WHEN price < q1 - {0} * iqr THEN 1 WHEN price < q1 THEN 2 WHEN price <= q2 THEN 3 WHEN price <= q3 THEN 4 WHEN price <= q3 + {0} * iqr THEN 5 ELSE 6 END"
Q5 = "CASE WHEN price < h20_0 THEN 1 WHEN price < h40_0 THEN 2 WHEN price <= h60_0 THEN 3 WHEN price <= h80_0 THEN 4 ELSE 5 END"
EQ = "CASE WHEN price < lo + (hi - lo) / 6 THEN 1 WHEN price < lo + 2 * (hi - lo) / 6 THEN 2 WHEN price < lo + 3 * (hi - lo) / 6 THEN 3 WHEN price < lo + 4 * (hi - lo) / 6 THEN 4 WHEN price < lo + 5 * (hi - lo) / 6 THEN 5 ELSE 6 END"

_theme("m01_themeless", lambda t: classify.themeless(t.parts()), PAR, "1")
_theme("m02_quantile_5", lambda t: classify.quantile(t.parts(), "price", "obs_id", 5), HZ, Q5, "ph")
_theme("m02_quantile_4", lambda t: classify.quantile(t.parts(), "price", "obs_id", 4), HZ, "CASE WHEN price < h25_0 THEN 1 WHEN price < h50_0 THEN 2 WHEN price <= h75_0 THEN 3 ELSE 4 END", "ph")
_theme("m03_percentile", lambda t: classify.percentile(t.parts(), "price", "obs_id"), HZ, "CASE WHEN price < h1_0 THEN 1 WHEN price < h10_0 THEN 2 WHEN price <= h50_0 THEN 3 WHEN price <= h90_0 THEN 4 WHEN price <= h99_0 THEN 5 ELSE 6 END", "ph")
_theme("m04_box_15", lambda t: classify.box(t.parts(), "price", "obs_id"), HG, BOX.format("1.5"), "pb")
_theme("m04_box_30", lambda t: classify.box(t.parts(), "price", "obs_id", 3.0), HG, BOX.format("3.0"), "pb")
_theme("m05_standard_deviation", lambda t: classify.standard_deviation(t.parts(), "price"), f"{PAR}, sd AS (SELECT par.*, avg(price) OVER () AS m, stddev_samp(price) OVER () AS s FROM par)", "CASE WHEN price < m - 2 * s THEN 1 WHEN price < m - s THEN 2 WHEN price <= m THEN 3 WHEN price <= m + s THEN 4 WHEN price <= m + 2 * s THEN 5 ELSE 6 END", "sd")
_theme("m06_unique_values", lambda t: classify.unique_values(t.lattice(), "x"), NAT, "dense_rank() OVER (ORDER BY x)", "nat")
_theme("m08_equal_intervals", lambda t: classify.equal_intervals(t.parts(), "price", 6), f"{PAR}, eq AS (SELECT par.*, min(price) OVER () AS lo, max(price) OVER () AS hi FROM par)", EQ, "eq")
_theme("m09_excess_risk", lambda t: classify.excess_risk_classes(t.parts().withColumn("r", F.col("p_size") / 10), "r"), PAR, "CASE WHEN p_size / 10 < 0.25 THEN 1 WHEN p_size / 10 < 0.5 THEN 2 WHEN p_size / 10 <= 1 THEN 3 WHEN p_size / 10 <= 2 THEN 4 WHEN p_size / 10 <= 4 THEN 5 ELSE 6 END")


#: Every choice of three breaks among the distinct sizes, by sums up to each.
NATURAL = """pre AS (SELECT p_size AS v, row_number() OVER (ORDER BY p_size) AS r, sum(count(*)) OVER (ORDER BY p_size) AS n, sum(count(*) * p_size) OVER (ORDER BY p_size) AS s, sum(count(*) * p_size * p_size) OVER (ORDER BY p_size) AS q FROM part GROUP BY p_size),
spans AS (SELECT a.r AS lo, b.r AS hi, b.q - coalesce(p.q, 0) - (b.s - coalesce(p.s, 0)) * (b.s - coalesce(p.s, 0)) / CAST(b.n - coalesce(p.n, 0) AS DOUBLE) AS w FROM pre a JOIN pre b ON b.r >= a.r LEFT JOIN pre p ON p.r = a.r - 1),
best AS (SELECT x.lo AS b2, y.lo AS b3, z.lo AS b4 FROM spans o JOIN spans x ON o.lo = 1 AND x.lo = o.hi + 1 JOIN spans y ON y.lo = x.hi + 1 JOIN spans z ON z.lo = y.hi + 1 AND z.hi = (SELECT max(r) FROM pre) ORDER BY o.w + x.w + y.w + z.w, b4, b3, b2 LIMIT 1)"""


@query("m07_natural_breaks", "cat:i n:i min_v:f max_v:f", NATURAL, "SELECT cat, count(*) AS n, min(p_size) AS min_v, max(p_size) AS max_v FROM (SELECT p_size, 1 + (r >= b2)::INT + (r >= b3)::INT + (r >= b4)::INT AS cat FROM part JOIN pre ON v = p_size, best) GROUP BY cat")
def _m07(t):
    return classify.legend(classify.natural_breaks(t.parts(), "p_size", 4), "p_size")


@query("m07_natural_breaks_price", "cat:i n:i min_v:f max_v:f")
def _m07p(t):
    return classify.legend(classify.natural_breaks(t.orders, "o_totalprice", 5), "o_totalprice")


@query("m07_goodness_of_fit", "gvf:f", PAR, "SELECT 1 - sum(w) / any_value(tt) AS gvf FROM (SELECT var_pop(p_size) * count(*) AS w FROM par GROUP BY CASE WHEN p_size < 12 THEN 1 WHEN p_size < 25 THEN 2 WHEN p_size < 38 THEN 3 ELSE 4 END), (SELECT var_pop(p_size) * count(*) AS tt FROM par)")
def _m07g(t):
    return classify.goodness_of_fit(classify.by_breaks(t.parts(), "p_size", [12.0, 25.0, 38.0]), "p_size")


@query("m12_legend", "cat:i n:i min_v:f max_v:f", HZ, f"SELECT {Q5} AS cat, count(*) AS n, min(price) AS min_v, max(price) AS max_v FROM ph GROUP BY 1")
def _m12(t):
    return classify.legend(classify.quantile(t.parts(), "price", "obs_id", 5), "price")


@query("m13_rate_map", "obs_id:i r:f cat:i", f"{VAL}, er AS (SELECT obs_id, e / (p * (sum(e) OVER () / sum(p) OVER ())) AS r FROM val)", "SELECT obs_id, r, CASE WHEN r < 0.25 THEN 1 WHEN r < 0.5 THEN 2 WHEN r <= 1 THEN 3 WHEN r <= 2 THEN 4 WHEN r <= 4 THEN 5 ELSE 6 END AS cat FROM er")
def _m13(t):
    return classify.excess_risk_classes(rates.excess_risk(t.values(), "e", "p", "r"), "r")


@query("m14_save_categories", "obs_id:i price:f cat:i", HZ, f"SELECT obs_id, price, {Q5} AS cat FROM ph")
def _m14(t):
    return classify.quantile(t.parts(), "price", "obs_id", 5)


# Views

BIN = "(least(floor((price - lo) / ((hi - lo) / 7)), 6) + 1)"
HB = f"{PAR}, hb AS (SELECT par.*, min(price) OVER () AS lo, max(price) OVER () AS hi FROM par)"


@query("v01_histogram", "bin:i low:f high:f n:i", HB, f"SELECT {BIN} AS bin, any_value(lo + ({BIN} - 1) * (hi - lo) / 7) AS low, any_value(lo + {BIN} * (hi - lo) / 7) AS high, count(*) AS n FROM hb GROUP BY 1")
def _v01(t):
    return explore.histogram(t.parts(), "price")


@query("v02_histogram_selected", "bin:i n:i n_selected:i", HB, f"SELECT {BIN} AS bin, count(*) AS n, sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS n_selected FROM hb GROUP BY 1")
def _v02(t):
    return explore.histogram(t.parts().withColumn("s", F.col("p_size") > 25), "price", selected="s")


@query("v03_integer_histogram", "bin:i low:i high:i n:i", PAR, "SELECT (p_size - lo) // w + 1 AS bin, any_value(lo + ((p_size - lo) // w) * w) AS low, any_value(lo + ((p_size - lo) // w + 1) * w - 1) AS high, count(*) AS n FROM (SELECT p_size, min(p_size) OVER () AS lo, CAST(ceil((max(p_size) OVER () - min(p_size) OVER () + 1) / 7) AS INT) AS w FROM par) GROUP BY 1")
def _v03(t):
    return explore.integer_histogram(t.parts(), "p_size", 7)


@query("v04_box_plot", "n:i q1:f q2:f q3:f mean:f low_fence:f high_fence:f n_low:i n_high:i", HG, "SELECT count(*) AS n, any_value(q1) AS q1, any_value(q2) AS q2, any_value(q3) AS q3, avg(price) AS mean, any_value(q1 - 1.5 * iqr) AS low_fence, any_value(q3 + 1.5 * iqr) AS high_fence, sum(CASE WHEN price < q1 - 1.5 * iqr THEN 1 ELSE 0 END) AS n_low, sum(CASE WHEN price > q3 + 1.5 * iqr THEN 1 ELSE 0 END) AS n_high FROM pb", digits=4)
def _v04(t):
    return explore.box_plot(t.parts(), "price", "obs_id")


@query("v04_box_plot_by_period", "time_id:i n:i min:f max:f", NY, "SELECT time_id, count(*) AS n, min(v) AS min, max(v) AS max FROM ny GROUP BY 1")
def _v04t(t):
    return explore.box_plot(t.nation_year(), "v", "obs_id", by=["time_id"])


@query("v05_scatter_regression", "slope:f intercept:f r2:f n:i se_slope:f", PAR, REG + " FROM par", digits=4)
def _v05(t):
    return simple_regression(t.parts(), "p_size", "price")


@query("v06_regression_by_selection", "selected:b slope:f intercept:f n:i", PAR, "SELECT p_size > 25 AS selected, regr_slope(price, p_size) AS slope, regr_intercept(price, p_size) AS intercept, count(*) AS n FROM par GROUP BY 1", digits=4)
def _v06(t):
    return simple_regression(t.parts().withColumn("selected", F.col("p_size") > 25), "p_size", "price", ["selected"])


SSE = "(regr_syy(price, p_size) - regr_sxy(price, p_size) * regr_sxy(price, p_size) / regr_sxx(price, p_size))"


@query("v07_chow_test", "f:f df1:i df2:i", PAR, f"SELECT (c - u) * (n - 4) / (2 * u) AS f, 2 AS df1, n - 4 AS df2 FROM (SELECT {SSE} AS c, count(*) AS n FROM par), (SELECT sum(s) AS u FROM (SELECT {SSE} AS s FROM par GROUP BY p_size > 25))", digits=4)
def _v07(t):
    return explore.chow_test(t.parts().withColumn("selected", F.col("p_size") > 25), "p_size", "price")


@query("v08_scatter_standardised", "obs_id:i zx:f zy:f", PAR, "SELECT obs_id, (p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER () AS zx, (price - avg(price) OVER ()) / stddev_samp(price) OVER () AS zy FROM par")
def _v08(t):
    return standardize(standardize(t.parts(), "p_size", "zx"), "price", "zy")


@query("v09_bubble_chart", "obs_id:i radius:f", f"{PAR}, zb AS (SELECT obs_id, (price - avg(price) OVER ()) / stddev_samp(price) OVER () AS z FROM par)", "SELECT obs_id, 20 * sqrt((z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()) * 0.99 + 0.01) AS radius FROM zb")
def _v09(t):
    return explore.bubbles(t.parts(), "price")


@query("v10_parallel_coordinates", "obs_id:i variable:s value:f", PAR, "SELECT obs_id, 'price' AS variable, 100 * (price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()) AS value FROM par UNION ALL SELECT obs_id, 'p_size', 100.0::DOUBLE * (p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()) FROM par")
def _v10(t):
    return explore.parallel_coordinates(t.parts(), "obs_id", ["price", "p_size"])


@query("v11_scatter_3d", "obs_id:i x:f y:f v:f", CUS, "SELECT obs_id, 2 * (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) - 1 AS x, 2 * (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) - 1 AS y, 2 * (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) - 1 AS v FROM cus")
def _v11(t):
    return explore.scatter_3d(t.customers(), "obs_id", ["x", "y", "v"])


THIRD = "CASE WHEN {0} < lo_{0} + (hi_{0} - lo_{0}) / 3 THEN 0 WHEN {0} < lo_{0} + 2 * (hi_{0} - lo_{0}) / 3 THEN 1 ELSE 2 END"
CELL = f"{CUS}, cd AS (SELECT cus.*, min(x) OVER () AS lo_x, max(x) OVER () AS hi_x, min(y) OVER () AS lo_y, max(y) OVER () AS hi_y FROM cus), cl AS (SELECT *, {THIRD.format('x')} + 3 * (2 - {THIRD.format('y')}) + 1 AS cell FROM cd)"


@query("v12_conditional_cells", "cell:i n:i mean:f", CELL, "SELECT cell, count(*) AS n, avg(v) AS mean FROM cl GROUP BY 1", digits=4)
def _v12(t):
    return summary(explore.conditional_cells(t.customers(), "x", "y"), "v", ["cell"])


@query("v12_conditional_scatter", "cell:i slope:f intercept:f", CELL, "SELECT cell, regr_slope(v, x) AS slope, regr_intercept(v, x) AS intercept FROM cl GROUP BY 1", digits=4)
def _v12s(t):
    return simple_regression(explore.conditional_cells(t.customers(), "x", "y"), "x", "v", ["cell"])


@query("v13_cartogram_radius", "obs_id:i radius:f", VAL, "SELECT obs_id, sqrt((10 + 100 * (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ())) / pi()) AS radius FROM val")
def _v13(t):
    return explore.cartogram_radius(t.values(), "v")


@query("v14_map_movie", "obs_id:i frame:i", PAR, "SELECT obs_id, row_number() OVER (ORDER BY price, obs_id) AS frame FROM par")
def _v14(t):
    return explore.movie(t.parts(), "price", "obs_id")


@query("v14_map_movie_cumulative", "obs_id:i frame:i", PAR, "SELECT obs_id, frame FROM (SELECT obs_id, row_number() OVER (ORDER BY price, obs_id) AS frame FROM par) WHERE frame <= 100")
def _v14c(t):
    return explore.movie(t.parts(), "price", "obs_id", 100)


@query("v16_display_statistics", "selected:b n:i min:f max:f mean:f sd:f", PAR, "SELECT p_size > 25 AS selected, count(*) AS n, min(price) AS min, max(price) AS max, avg(price) AS mean, stddev_samp(price) AS sd FROM par GROUP BY 1", digits=4)
def _v16(t):
    return summary(t.parts().withColumn("selected", F.col("p_size") > 25), "price", ["selected"])


# Geometry


@query("g01_mean_center", "obs_id:i xmctr:f ymctr:f", NAT, "SELECT obs_id, (5 * x + 2) / 5.0::DOUBLE AS xmctr, (5 * y + 2) / 5.0::DOUBLE AS ymctr FROM nat")
def _g01(t):
    return t.lattice().withColumns(geometry.mean_center())


@query("g02_centroid", "obs_id:i xcntrd:f ycntrd:f", NAT, "SELECT obs_id, x + 0.5 AS xcntrd, y + 0.5 AS ycntrd FROM nat")
def _g02(t):
    return t.lattice().withColumns(geometry.centroid())


@query("g03_centroid_full", "obs_id:i xcntrd:f ycntrd:f", NAT, "SELECT obs_id, x + 0.5 AS xcntrd, y + 0.5 AS ycntrd FROM nat")
def _g03(t):
    return t.lattice().withColumns(geometry.centroid(full=True))


@query("g04_area_perimeter", "obs_id:i area:f perimeter:f", NAT, "SELECT obs_id, 1.0 AS area, 4.0 AS perimeter FROM nat")
def _g04(t):
    return t.lattice().withColumns(geometry.area_perimeter())


@query("g05_polygon_grid", "obs_id:i area:f perimeter:f xcntrd:f ycntrd:f", "", "SELECT i + 1 AS obs_id, 0.5 * 0.25 AS area, 1.5 AS perimeter, (i % 8) * 0.5 + 0.25 AS xcntrd, 3 - (i // 8) * 0.25 - 0.125 AS ycntrd FROM range(96) r(i)")
def _g05(t):
    return geometry.grid(t.spark, 12, 8, 0.0, 0.0, 4.0, 3.0).withColumns(geometry.centroid())


@query("g06_thiessen", "n:i total:f", "", "SELECT count(*) AS n, 12.0 * 12.0 AS total FROM supplier")
def _g06(t):
    cells = voronoi.thiessen(t.suppliers(), (-1.0, -1.0, 11.0, 11.0))
    return cells.withColumns(geometry.area_perimeter()).agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("total"))


@query("g06_thiessen_customers", "n:i empty:i total:f", CUS, "SELECT count(*) AS n, 0 AS empty, (max(x) - min(x) + 2) * (max(y) - min(y) + 2) AS total FROM cus")
def _g06_customers(t):
    cells = voronoi.thiessen(t.customers(), geometry.extent(t.customers(), 1.0))
    return cells.withColumns(geometry.area_perimeter()).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("area") <= 0).alias("empty"), F.sum("area").alias("total"))


@query("g06_thiessen_extent", "n:i empty:i total:f", SUP, "SELECT count(*) AS n, 0 AS empty, (max(x) - min(x) + 2) * (max(y) - min(y) + 2) AS total FROM sup")
def _g06_extent(t):
    cells = voronoi.thiessen(t.suppliers(), geometry.extent(t.suppliers(), 1.0))
    return cells.withColumns(geometry.area_perimeter()).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("area") <= 0).alias("empty"), F.sum("area").alias("total"))


#: Sample points all over the customers' extent, and the customer that is nearest to each.
SPOTS = "spots AS (SELECT p_partkey AS k, lo + (hi - lo) * (((p_partkey * 7919) % 10007) / 10007.0::DOUBLE) AS px, bo + (up - bo) * (((p_partkey * 104729) % 10009) / 10009.0::DOUBLE) AS py FROM part, (SELECT min(x) AS lo, max(x) AS hi, min(y) AS bo, max(y) AS up FROM cus))"


@query("g06_thiessen_nearest", "k:i site:i v:f", f"{CUS}, {SPOTS}", "SELECT k, obs_id AS site, v FROM (SELECT k, obs_id, v, row_number() OVER (PARTITION BY k ORDER BY round((x - px) * (x - px) + (y - py) * (y - py), 9), obs_id) AS r FROM spots, cus) WHERE r = 1")
def _g06_nearest(t):
    c = t.customers()
    ends = c.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("y").alias("bo"), F.max("y").alias("up"))
    spots = t.part.crossJoin(F.broadcast(ends)).select(F.col("p_partkey").alias("key"), (F.col("lo") + (F.col("hi") - F.col("lo")) * ((F.col("p_partkey") * 7919) % 10007 / 10007.0)).alias("x"), (F.col("bo") + (F.col("up") - F.col("bo")) * ((F.col("p_partkey") * 104729) % 10009 / 10009.0)).alias("y"))
    cells = cut(voronoi.thiessen(c, geometry.extent(c, 1.0)))
    held = voronoi.holders(spots, cells).groupBy("key").agg(F.min("obs_id").alias("obs_id"))
    return held.join(dealt(cells.select("obs_id", "v")), "obs_id").select(F.col("key").alias("k"), F.col("obs_id").alias("site"), "v")


#: On the bisector of two sites, the part that no other site or side of the box (a margin of 1 around) cuts off: m + t d, from the first site.
EDGES = """ends AS (SELECT min(x) - 1 AS x0, max(x) + 1 AS x1, min(y) - 1 AS y0, max(y) + 1 AS y1 FROM sup),
pr AS (SELECT a.obs_id AS src, b.obs_id AS dst, a.x AS ax, a.y AS ay, b.x - a.x AS bx, b.y - a.y AS ry FROM sup a JOIN sup b ON a.obs_id <> b.obs_id),
bounds AS (SELECT src, dst, bx, ry, 2 * (c.x - ax) * -ry + 2 * (c.y - ay) * bx AS k, (c.x - ax) * (c.x - ax) + (c.y - ay) * (c.y - ay) - (c.x - ax) * bx - (c.y - ay) * ry AS r FROM pr JOIN sup c ON c.obs_id <> src AND c.obs_id <> dst
    UNION ALL SELECT src, dst, bx, ry, s * CASE WHEN up THEN bx ELSE -ry END, s * CASE WHEN up THEN CASE WHEN s > 0 THEN y1 ELSE y0 END - ay - ry / 2 ELSE CASE WHEN s > 0 THEN x1 ELSE x0 END - ax - bx / 2 END FROM pr, ends, (VALUES (1, true), (-1, true), (1, false), (-1, false)) v(s, up)),
spans AS (SELECT src, dst, bx, ry, min(CASE WHEN k > 1e-12 THEN r / k END) AS hi, max(CASE WHEN k < -1e-12 THEN r / k END) AS lo, min(CASE WHEN abs(k) <= 1e-12 THEN r ELSE 1 END) AS room FROM bounds GROUP BY ALL)"""


@query("v13_point_neighbours", "src:i dst:i w:f", f"{SUP}, {EDGES}", "SELECT src, dst, (hi - lo) * sqrt(bx * bx + ry * ry) AS w FROM spans WHERE room > -1e-9 AND (hi - lo) * sqrt(bx * bx + ry * ry) > 1e-9 * (SELECT sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) FROM ends)")
def _v13_neighbours(t):
    return voronoi.neighbours(t.suppliers(), geometry.extent(t.suppliers(), 1.0))


@query("g07_add_centroids", "obs_id:i XCNTRD:f YCNTRD:f XMCTR:f YMCTR:f", NAT, "SELECT obs_id, x + 0.5 AS XCNTRD, y + 0.5 AS YCNTRD, x + 0.4 AS XMCTR, y + 0.4 AS YMCTR FROM nat")
def _g07(t):
    return t.lattice().withColumns({k.upper(): v for k, v in (geometry.centroid() | geometry.mean_center()).items()})


@query("g08_export_centroids", "obs_id:i x:f y:f", NAT, "SELECT obs_id, x + 0.5 AS x, y + 0.5 AS y FROM nat")
def _g08(t):
    return geometry.export_points(t.lattice(), "obs_id")


@query("g09_bounding_box", "obs_id:i minx:f miny:f maxx:f maxy:f", NAT, "SELECT obs_id, x AS minx, y AS miny, x + 1 AS maxx, y + 1 AS maxy FROM nat")
def _g09(t):
    return t.lattice().withColumns(geometry.bounding_box())


def _square(half, turned):
    """Corners of a closed square around x, y; clockwise unless `turned`."""
    at = lambda a, b: F.struct((F.col("x") + a * half).alias("x"), (F.col("y") + b * half).alias("y"))
    ring = F.array(at(-1, -1), at(-1, 1), at(1, 1), at(1, -1), at(-1, -1))
    return F.when(turned, F.reverse(ring)).otherwise(ring)


#: Donuts with islands around suppliers: rings in three orders, half of the outer and a third of the inner ones turned the wrong way, and two donuts side by side.
@query("g09_ring_nesting", "obs_id:i depths:s area:f perimeter:f turns:s", SUP, "SELECT obs_id, CASE obs_id % 3 WHEN 0 THEN '0,1,2,0,1' WHEN 1 THEN '2,1,0,0,1' ELSE '1,2,0,1,0' END AS depths, 100 * (64 - 36 + 4 + 16 - 1) AS area, 10 * (32 + 24 + 8 + 16 + 4) AS perimeter, CASE obs_id % 3 WHEN 0 THEN 'r,l,r,r,l' WHEN 1 THEN 'r,l,r,r,l' ELSE 'l,r,r,l,r' END AS turns FROM sup")
def _g09n(t):
    s = t.suppliers()
    odd = F.col("obs_id") % 2 == 1
    third = F.col("obs_id") % 3 == 1
    outer, hole, island = _square(40, odd), _square(30, third), _square(10, odd)
    beside = lambda ring: F.transform(ring, lambda p: F.struct((p["x"] + 70).alias("x"), p["y"].alias("y")))
    other, gap = beside(_square(20, ~odd)), beside(_square(5, odd))
    order = lambda *r: F.concat(*r)
    points = F.when(F.col("obs_id") % 3 == 0, order(outer, hole, island, other, gap)).when(third, order(island, hole, outer, other, gap)).otherwise(order(hole, island, outer, gap, other))
    shape = F.struct(F.lit(geometry.POLYGON).alias("type"), F.array(*map(F.lit, range(0, 25, 5))).alias("parts"), points.alias("points"))
    turn = F.expr("array_join(transform(sequence(0, 4), i -> if(aggregate(sequence(5 * i, 5 * i + 3), cast(0 as double), (a, j) -> a + (geom.points[j].x - x) * (geom.points[j + 1].y - y) - (geom.points[j + 1].x - x) * (geom.points[j].y - y)) < 0, 'r', 'l')), ',')")
    return rings.repair(s.withColumn("geom", shape)).withColumns(geometry.area_perimeter()).withColumns({"turns": turn, "depths": F.array_join("depths", ",")})


@query("g10_point_line_distance", "obs_id:i d:f meets:b", CUS, "SELECT obs_id, sqrt((x - 30 * u) * (x - 30 * u) + (y - 20 * u) * (y - 20 * u)) AS d, x <= 12 AND x + 1 >= 5 AND y <= 9 AND y + 1 >= 3 AS meets FROM (SELECT *, least(1, greatest(0, (x * 30 + y * 20) / 1300)) AS u FROM cus)")
def _g10(t):
    c = t.customers()
    return c.withColumns({"d": geometry.point_line_distance(F.col("x"), F.col("y"), 0, 0, 30, 20), "meets": geometry.rectangles_meet((F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1), (5, 3, 12, 9))})


@query("io19_points_from_table", "obs_id:i x:f y:f", CUS, "SELECT obs_id, x, y FROM cus")
def _io19(t):
    return t.customers().withColumn("geom", geometry.point("x", "y")).select("obs_id", F.col("geom.points")[0]["x"].alias("x"), F.col("geom.points")[0]["y"].alias("y"))


# Regression


@query("o01_ols", "intercept:f slope:f", PAR, "SELECT regr_intercept(price, p_size) AS intercept, regr_slope(price, p_size) AS slope FROM par", digits=4)
def _o01(t):
    fit = regression.ols(t.parts(), "price", ["p_size"])
    return t.spark.createDataFrame([(float(fit.coef[0]), float(fit.coef[1]))], "intercept double, slope double")


@query("o02_coefficient_table", "term:s coef:f se:f stat:f p:f")
def _o02(t):
    return regression.ols(t.customers(), "v", ["x", "y"]).table(t.spark)


FITS = f"SELECT n, r2, 1 - (1 - r2) * (n - 1) / (n - 2) AS adj_r2, sse / (n - 2) AS sigma2, -n / 2 * (ln(2 * pi()) + ln(sse / n) + 1) AS log_likelihood FROM (SELECT CAST(count(*) AS DOUBLE) AS n, regr_r2(price, p_size) AS r2, {SSE} AS sse FROM par)"


@query("o03_fit", "n:i r2:f adj_r2:f sigma2:f log_likelihood:f", PAR, FITS, digits=4)
def _o03(t):
    fit = regression.ols(t.parts(), "price", ["p_size"]).fit
    return t.spark.createDataFrame([tuple(float(fit[k]) for k in ("n", "r2", "adj_r2", "sigma2", "log_likelihood"))], "n double, r2 double, adj_r2 double, sigma2 double, log_likelihood double")


@query("o05_jarque_bera", "jb:f", f"{PAR}, rs AS (SELECT price - (SELECT regr_intercept(price, p_size) FROM par) - (SELECT regr_slope(price, p_size) FROM par) * p_size AS e FROM par)", "SELECT n * (s * s / 6 + (k - 3) * (k - 3) / 24) AS jb FROM (SELECT CAST(count(*) AS DOUBLE) AS n, avg(e * e * e) / pow(avg(e * e), 1.5) AS s, avg(e * e * e * e) / (avg(e * e) * avg(e * e)) AS k FROM rs)", digits=3)
def _o05(t):
    return t.spark.createDataFrame([(float(regression.ols(t.parts(), "price", ["p_size"]).tests["jarque_bera"][0]),)], "jb double")


@query("o06_to_o09_diagnostics", "test:s df:f value:f p:f")
def _o06(t):
    c = t.customers()
    return regression.ols(c, "v", ["x", "y"], weights.symmetrise(weights.knn(c, 4).select("src", "dst"))).report(t.spark)


RESID = f"{WQ}, {VAL}, rs AS (SELECT obs_id, v - (SELECT regr_intercept(v, p) FROM val) - (SELECT regr_slope(v, p) FROM val) * p AS e FROM val), rl AS (SELECT e, (SELECT avg(b.e) FROM wq JOIN rs b ON b.obs_id = dst WHERE src = rs.obs_id) AS l FROM rs)"


@query("o08_moran_residuals", "moran:f", RESID, "SELECT sum(e * l) / sum(e * e) AS moran FROM rl")
def _o08(t):
    return t.spark.createDataFrame([(float(regression.ols(t.values(), "v", ["p"], t.queen()).fit["moran_residuals"]),)], "moran double")


TR = "tr AS (SELECT sum(a.w * a.w + a.w * coalesce(b.w, 0)) AS t FROM (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM wq) a LEFT JOIN (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM wq) b ON a.src = b.dst AND a.dst = b.src)"


@query("o09_lm_error", "lm:f", f"{RESID}, {TR}", "SELECT pow(sum(e * l) / (sum(e * e) / count(*)), 2) / any_value(t) AS lm FROM rl, tr")
def _o09(t):
    return t.spark.createDataFrame([(float(regression.ols(t.values(), "v", ["p"], t.queen()).tests["lm_error"][0]),)], "lm double")


@query("o10_spatial_lag_ml", "term:s coef:f se:f stat:f p:f", digits=4)
def _o10(t):
    return regression.spatial_lag(t.values(), "v", ["p"], t.queen()).table(t.spark)


@query("o11_spatial_error_ml", "term:s coef:f se:f stat:f p:f", digits=4)
def _o11(t):
    return regression.spatial_error(t.values(), "v", ["p"], t.queen()).table(t.spark)


@query("o12_ols_predicted", "obs_id:i predicted:f residual:f", PAR, "SELECT obs_id, (SELECT regr_intercept(price, p_size) FROM par) + (SELECT regr_slope(price, p_size) FROM par) * p_size AS predicted, price - (SELECT regr_intercept(price, p_size) FROM par) - (SELECT regr_slope(price, p_size) FROM par) * p_size AS residual FROM par", digits=4)
def _o12(t):
    return regression.residuals(t.parts(), "price", ["p_size"], regression.ols(t.parts(), "price", ["p_size"]))


@query("o12_lag_predicted", "obs_id:i LAG_PREDIC:f LAG_RESIDU:f LAG_PRDERR:f", digits=3)
def _o12l(t):
    v, w = t.values(), t.queen()
    return regression.save_lag(v, "v", ["p"], w, regression.spatial_lag(v, "v", ["p"], w))


@query("o12_error_predicted", "obs_id:i ERR_PREDIC:f ERR_RESIDU:f ERR_PRDERR:f", digits=3)
def _o12e(t):
    v, w = t.values(), t.queen()
    return regression.save_error(v, "v", ["p"], w, regression.spatial_error(v, "v", ["p"], w))


@query("o15_dependent_moments", "mean:f sd:f", PAR, "SELECT avg(price) AS mean, stddev_samp(price) AS sd FROM par", digits=4)
def _o15(t):
    return summary(t.parts(), "price")


# An extension: the event stream's batch form


@query("x01_daily_events", "user_id:i day:s total:f n:i", "", "SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS total, count(*) AS n FROM events GROUP BY 1, 2", digits=4)
def _x01(t):
    return streams.daily(t.events)


@query("x02_event_moments", "event_type:s n:i mean:f sd:f", "", "SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM events GROUP BY 1", digits=4)
def _x02(t):
    return streams.moments(t.events)
