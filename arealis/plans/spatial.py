"""Selection, weights and autocorrelation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from arealis.functions.calc import standardize
from arealis.operators import autocorr, rates, select, weights
from arealis.plans.base import CUS, EMB, GLO, LAG, NAT, NY, SUP, VAL, VTX, WQ, WR, ZED, query
from arealis.sources.text import as_contiguity

CUSTOMERS = "SELECT c_custkey AS obs_id, c_acctbal AS x, c_nationkey AS k FROM customer"


def _cust(t):
    return t.customer.select(F.col("c_custkey").alias("obs_id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").alias("k"))


def _sel(name, fn, test, ctes=f"cust AS ({CUSTOMERS})", source="cust"):
    query(name, "obs_id:i selected:b", ctes, f"SELECT obs_id, coalesce({test}, false) AS selected FROM {source}")(fn)


_sel("s01_range", lambda t: select.in_range(_cust(t), "x", 1000.0, 5000.0), "x BETWEEN 1000 AND 5000")
_sel("s01_range_whole", lambda t: select.in_range(_cust(t), "k", 2.5, 10.5), "k BETWEEN 3 AND 10")
_sel("s02_undefined", lambda t: select.undefined(_cust(t).withColumn("x", F.when(F.col("x") > 0, F.col("x"))), "x"), "NOT x > 0")
_sel("s03_invert", lambda t: select.invert(select.in_range(_cust(t), "x", 1000.0, 5000.0)), "NOT x BETWEEN 1000 AND 5000")
_sel("s04_random", lambda t: select.at_random(_cust(t), "obs_id"), "substring(md5(concat_ws('|', '42', obs_id::VARCHAR)), 1, 1) < '8'")
_sel("s05_all", lambda t: select.everything(_cust(t)), "true")
_sel("s05_clear", lambda t: select.everything(_cust(t), False), "false")
_sel("s06_add_neighbours", lambda t: select.add_neighbours(t.lattice().select("obs_id", (F.col("obs_id") < 2).alias("selected")), t.queen()), "obs_id < 2 OR obs_id IN (SELECT dst FROM wq WHERE src < 2)", WQ, "nat")
_sel("s08_category", lambda t: select.category(_cust(t), "k", 7), "k = 7")
_sel("s09_toggle", lambda t: select.toggle(select.in_range(_cust(t), "x", 1000.0, 5000.0), F.col("k") == 3), "(x BETWEEN 1000 AND 5000) <> (k = 3)")
_sel("s10_rectangle", lambda t: select.rectangle(t.customers(), 3.0, 2.0, 11.0, 30.0), "x BETWEEN 3 AND 11 AND y BETWEEN 2 AND 30", CUS, "cus")
_sel("s11_circle", lambda t: select.circle(t.customers(), 20.0, 15.0, 7.3), "(x - 20) * (x - 20) + (y - 15) * (y - 15) <= 7.3 * 7.3", CUS, "cus")
_sel("s12_line", lambda t: select.line(t.customers(), 0.0, 0.0, 30.0, 25.0), "x BETWEEN 0 AND 30 AND y BETWEEN 0 AND 25 AND abs(30 * y - 25 * x) <= 3 * sqrt(30.0::DOUBLE * 30 + 25 * 25)", CUS, "cus")
_sel("s14_extend", lambda t: select.circle(select.rectangle(t.customers(), 3.0, 2.0, 11.0, 30.0), 20.0, 15.0, 7.3, extend=True), "(x BETWEEN 3 AND 11 AND y BETWEEN 2 AND 30) OR (x - 20) * (x - 20) + (y - 15) * (y - 15) <= 7.3 * 7.3", CUS, "cus")


@query("s07_save_selection", "obs_id:i flag:i", f"cust AS ({CUSTOMERS})", "SELECT obs_id, CASE WHEN x BETWEEN 1000 AND 5000 THEN 1 ELSE k END AS flag FROM cust")
def _s07(t):
    return select.save(select.in_range(_cust(t), "x", 1000.0, 5000.0).withColumn("flag", F.col("k")), "flag", inside=1)


_sel("s13_crossing", lambda t: select.crossing(t.customers().withColumns({"x2": F.col("x") + 1.5, "y2": F.col("y") + 0.5}), 0.13, 30.7, 38.9, 0.37), "((38.77 * (y - 30.7) - (-30.33) * (x - 0.13)) > 0) <> ((38.77 * (y + 0.5 - 30.7) - (-30.33) * (x + 1.5 - 0.13)) > 0) AND ((1.5 * (30.7 - y) - 0.5 * (0.13 - x)) > 0) <> ((1.5 * (0.37 - y) - 0.5 * (38.9 - x)) > 0)", CUS, "cus")

# Weights


def _w(name, fn, ctes, body, spec="src:i dst:i"):
    query(name, spec, ctes, body)(fn)


LEVELS = f"{WQ}, l2 AS (SELECT DISTINCT a.src, b.dst FROM wq a JOIN wq b ON a.dst = b.src WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM wq w WHERE w.src = a.src AND w.dst = b.dst)), l3 AS (SELECT DISTINCT a.src, b.dst FROM l2 a JOIN wq b ON a.dst = b.src WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM wq w WHERE w.src = a.src AND w.dst = b.dst) AND NOT EXISTS (SELECT 1 FROM l2 w WHERE w.src = a.src AND w.dst = b.dst))"
BAND = "SELECT a.obs_id AS src, b.obs_id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS w FROM {0} a JOIN {0} b ON a.obs_id <> b.obs_id WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {1}"
KNN = "SELECT src, dst, w FROM (SELECT a.obs_id AS src, b.obs_id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS w, row_number() OVER (PARTITION BY a.obs_id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.obs_id) AS r FROM {0} a JOIN {0} b ON a.obs_id <> b.obs_id) WHERE r <= {1}"

_w("w01_queen", lambda t: t.queen(), WQ, "SELECT * FROM wq")
_w("w02_rook", lambda t: t.rook(), f"{NAT}, {WR}", "SELECT * FROM wr")
_w("w03_symmetrise", lambda t: weights.symmetrise(weights.knn(t.suppliers(), 3).select("src", "dst")), f"{SUP}, kn AS ({KNN.format('sup', 3)})", "SELECT src, dst FROM kn UNION SELECT dst, src FROM kn")
_w("w04_order_3", lambda t: weights.higher_order(t.queen(), 3), LEVELS, "SELECT * FROM l3")
_w("w05_order_3_cumulative", lambda t: weights.higher_order(t.queen(), 3, True), LEVELS, "SELECT * FROM wq UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3")
_w("w06_distance_band", lambda t: weights.distance_band(t.customers(), 1.2), CUS, BAND.format("cus", 1.2), "src:i dst:i w:f")
_w("w06_distance_band_irregular", lambda t: weights.distance_band(t.embedded(), 0.25), EMB, BAND.format("emb", 0.25), "src:i dst:i w:f")
_w("w07_inverse_distance", lambda t: weights.inverse_distance(weights.distance_band(t.suppliers(), 1.5), 2.0, True), f"{SUP}, bd AS ({BAND.format('sup', 1.5)}), iv AS (SELECT src, dst, pow(w / (SELECT min(w) FROM bd), -2) AS w FROM bd)", "SELECT src, dst, w / sqrt(sum(w * w) OVER (PARTITION BY src)) AS w FROM iv", "src:i dst:i w:f")
_w("w08_knn", lambda t: weights.knn(t.customers(), 6), CUS, KNN.format("cus", 6), "src:i dst:i w:f")
_w("w08_knn_irregular", lambda t: weights.knn(t.embedded(), 4), EMB, KNN.format("emb", 4), "src:i dst:i w:f")
ARC = "3959.0 * acos(least(1.0, greatest(-1.0, sin(radians(a.y)) * sin(radians(b.y)) + cos(radians(a.y)) * cos(radians(b.y)) * cos(radians(a.x) - radians(b.x)))))"
UNIT = "u AS (SELECT obs_id, CASE WHEN abs(y) = 90 THEN 0 ELSE cos(radians(y)) * cos(radians(x)) END AS a, CASE WHEN abs(y) = 90 THEN 0 ELSE cos(radians(y)) * sin(radians(x)) END AS b, sin(radians(y)) AS c FROM {0})"
ARC_KNN = "SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w, dst) AS r FROM (SELECT p.obs_id AS src, q.obs_id AS dst, round(2 * 3959.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) + (p.c - q.c) * (p.c - q.c)) / 2)), 6) AS w FROM u p JOIN u q ON p.obs_id <> q.obs_id)) WHERE r <= {0}"


def _arcs_beside(t):
    """Arc distances of the pairs of a band in degrees."""
    s = t.suppliers().select("obs_id", "x", "y")
    ends = weights.distance_band(s, 1.5).select("src", "dst").join(s.toDF("src", "ax", "ay"), "src").join(s.toDF("dst", "bx", "by"), "dst")
    return ends.select("src", "dst", weights.arc_miles(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("w"))


_w("w09_arc_distance", _arcs_beside, f"{SUP}, bd AS ({BAND.format('sup', 1.5)})", f"SELECT src, dst, {ARC} AS w FROM bd JOIN sup a ON a.obs_id = src JOIN sup b ON b.obs_id = dst", "src:i dst:i w:f")
_w("w09_arc_knn", lambda t: weights.arc_knn(t.suppliers(), 4), f"{SUP}, {UNIT.format('sup')}", ARC_KNN.format(4), "src:i dst:i w:f")
_w("w09_arc_knn_globe", lambda t: weights.arc_knn(t.globe(), 5), f"{GLO}, {UNIT.format('glo')}", ARC_KNN.format(5), "src:i dst:i w:f")
_w("w09_arc_band", lambda t: weights.arc_band(t.suppliers(), 150.0), f"{SUP}, arc AS (SELECT a.obs_id AS src, b.obs_id AS dst, 3959.0 * acos(least(1.0, greatest(-1.0, sin(radians(a.y)) * sin(radians(b.y)) + cos(radians(a.y)) * cos(radians(b.y)) * cos(radians(a.x) - radians(b.x))))) AS w FROM sup a JOIN sup b ON a.obs_id <> b.obs_id)", "SELECT * FROM arc WHERE w <= 150.0", "src:i dst:i w:f")
_w("w10_min_threshold", lambda t: weights.min_threshold(t.embedded()), f"{EMB}, kn AS ({KNN.format('emb', 1)})", "SELECT max(w) AS min_threshold FROM kn", "min_threshold:f")
_w("w11_max_distance", lambda t: weights.max_distance(t.embedded()), EMB, "SELECT sqrt((max(x) - min(x)) * (max(x) - min(x)) + (max(y) - min(y)) * (max(y) - min(y))) AS max_distance FROM emb", "max_distance:f")
_w("w12_centroid_band", lambda t: weights.distance_band(t.lattice().select("obs_id", (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y")), 1.5), f"{NAT}, ctr AS (SELECT obs_id, x + 0.5 AS x, y + 0.5 AS y FROM nat)", BAND.format("ctr", 1.5), "src:i dst:i w:f")
_w("w13_asymmetric_pairs", lambda t: weights.asymmetric_pairs(weights.knn(t.suppliers(), 3)), f"{SUP}, kn AS ({KNN.format('sup', 3)})", "SELECT src, dst FROM kn a WHERE NOT EXISTS (SELECT 1 FROM kn b WHERE b.src = a.dst AND b.dst = a.src)")
_w("w14_isolates", lambda t: weights.isolates(t.embedded(), weights.distance_band(t.embedded(), 0.1)).select("obs_id"), f"{EMB}, bd AS ({BAND.format('emb', 0.1)})", "SELECT obs_id FROM emb WHERE obs_id NOT IN (SELECT src FROM bd)", "obs_id:i")
_w("w15_neighbour_histogram", lambda t: weights.neighbour_counts(t.lattice(), t.queen()).groupBy("k").agg(F.count(F.lit(1)).alias("n")), WQ, "SELECT k, count(*) AS n FROM (SELECT obs_id, (SELECT count(*) FROM wq WHERE src = obs_id) AS k FROM nat) GROUP BY k", "k:i n:i")
_w("w16_row_standardise", lambda t: weights.row_standardise(t.queen()), WQ, "SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM wq", "src:i dst:i w:f")
_w("io14_gwt_as_contiguity", lambda t: as_contiguity(weights.distance_band(t.suppliers(), 1.5)), f"{SUP}, bd AS ({BAND.format('sup', 1.5)})", "SELECT src, dst FROM bd")

# Lags and autocorrelation


@query("l01_spatial_lag", "obs_id:i lag:f", f"{WQ}, {VAL}, vn AS (SELECT obs_id, CASE WHEN obs_id <> 7 THEN v END AS v FROM val)", "SELECT n.obs_id, (SELECT CASE WHEN count(v) = count(*) THEN avg(v) END FROM wq LEFT JOIN vn ON vn.obs_id = wq.dst WHERE wq.src = n.obs_id) AS lag FROM nat n")
def _l01(t):
    return autocorr.lag(t.values().withColumn("v", F.when(F.col("obs_id") != 7, F.col("v"))), t.queen(), "obs_id", "v", "lag")


@query("l02_lag_kernel", "obs_id:i lag:f", f"{EMB}, bd AS ({BAND.format('emb', 0.1)})", "SELECT e.obs_id, coalesce((SELECT avg(n.y) FROM bd JOIN emb n ON n.obs_id = bd.dst WHERE bd.src = e.obs_id), 0) AS lag FROM emb e")
def _l02(t):
    return autocorr.lag_band(t.embedded(), 0.1, "obs_id", "y", "lag")


PERM = "pv AS (SELECT a.obs_id, b.v FROM (SELECT obs_id, row_number() OVER (ORDER BY obs_id) k FROM val) a JOIN (SELECT v, row_number() OVER (ORDER BY md5(concat_ws('|', '42', obs_id::VARCHAR))) k FROM val) b USING (k))"


@query("l03_permuted_lag", "obs_id:i lag:f", f"{WQ}, {VAL}, {PERM}", "SELECT n.obs_id, coalesce((SELECT avg(v) FROM wq JOIN pv ON pv.obs_id = wq.dst WHERE wq.src = n.obs_id), 0) AS lag FROM nat n")
def _l03(t):
    return autocorr.permuted_lag(t.values(), t.queen(), "obs_id", "v", "lag")


@query("a01_global_moran", "moran:f", LAG, "SELECT sum(z * lag) / (count(*) - 1) AS moran FROM lg")
def _a01(t):
    return autocorr.moran(t.values(), t.queen(), "obs_id", "v")


BIV = f"{WQ}, {VAL}, z1 AS (SELECT obs_id, (e / p - avg(e / p) OVER ()) / stddev_samp(e / p) OVER () AS z FROM val), z2 AS (SELECT obs_id, (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS z FROM val)"


@query("a02_bivariate_moran", "moran:f", BIV, "SELECT sum(z1.z * (SELECT avg(z2.z) FROM wq JOIN z2 ON z2.obs_id = wq.dst WHERE wq.src = z1.obs_id)) / (count(*) - 1) AS moran FROM z1")
def _a02(t):
    return autocorr.moran(t.values().withColumn("r", F.col("e") / F.col("p")), t.queen(), "obs_id", "r", "v")


EBZ = f"{WQ}, {VAL}, t1 AS (SELECT sum(e) / sum(p) AS b, sum(p) / count(*) AS m, sum(p) AS tp FROM val), t2 AS (SELECT greatest(0, sum(p * (e / p - b) * (e / p - b)) / any_value(tp) - any_value(b) / any_value(m)) AS a, any_value(b) AS b FROM val, t1), eb AS (SELECT obs_id, (e / p - b) / sqrt(a + b / p) AS r FROM val, t2), zz AS (SELECT obs_id, (r - avg(r) OVER ()) / stddev_samp(r) OVER () AS z FROM eb)"


@query("a03_eb_moran", "moran:f", EBZ, "SELECT sum(a.z * (SELECT avg(b.z) FROM wq JOIN zz b ON b.obs_id = wq.dst WHERE wq.src = a.obs_id)) / (count(*) - 1) AS moran FROM zz a")
def _a03(t):
    return autocorr.moran(rates.eb_standardize(t.values(), "e", "p", "r"), t.queen(), "obs_id", "r")


@query("a04_moran_scatter", "obs_id:i z:f lag:f", LAG, "SELECT obs_id, z, lag FROM lg")
def _a04(t):
    return autocorr.scatter(t.values(), t.queen(), "obs_id", "v")


PERMS = f"{LAG}, pm AS (SELECT r.p, a.obs_id, a.k, b.z FROM range(1, 100) r(p) JOIN (SELECT obs_id, row_number() OVER (ORDER BY obs_id) k FROM zed) a ON true JOIN (SELECT q.p, obs_id, z, row_number() OVER (PARTITION BY q.p ORDER BY md5(concat_ws('|', '42', q.p::VARCHAR, obs_id::VARCHAR))) k FROM zed, range(1, 100) q(p)) b ON b.p = r.p AND b.k = a.k), pl AS (SELECT pm.p, wq.src, avg(pm.z) AS lag FROM wq JOIN pm ON pm.obs_id = wq.dst GROUP BY 1, 2), pi AS (SELECT pm.p, sum(pm.z * coalesce(pl.lag, 0)) / (count(*) - 1) AS moran FROM pm LEFT JOIN pl ON pl.p = pm.p AND pl.src = pm.obs_id GROUP BY 1), ob AS (SELECT sum(z * lag) / (count(*) - 1) AS i, count(*) AS n FROM lg)"


@query("a05_moran_permutations", "observed:f expected:f mean:f sd:f z:f pseudo_p:f permutations:i", PERMS, "SELECT any_value(i) AS observed, -1.0::DOUBLE / (any_value(n) - 1) AS expected, avg(moran) AS mean, stddev_pop(moran) AS sd, (any_value(i) - avg(moran)) / stddev_pop(moran) AS z, (least(sum(CASE WHEN moran <= i THEN 1 ELSE 0 END), sum(CASE WHEN moran > i THEN 1 ELSE 0 END)) + 1) / (count(*) + 1.0::DOUBLE) AS pseudo_p, count(*) AS permutations FROM pi, ob")
def _a05(t):
    v, w = t.values(), t.queen()
    return autocorr.moran_inference(autocorr.moran(v, w, "obs_id", "v"), autocorr.permuted_moran(v, w, "obs_id", "v", 99), 25)


@query("a06_permutation_histogram", "bin:i n:i", PERMS, "SELECT least(greatest(floor((moran + 1) * 10 / 2), 0), 9) AS bin, count(*) AS n FROM pi GROUP BY 1")
def _a06(t):
    return autocorr.permutation_histogram(autocorr.permuted_moran(t.values(), t.queen(), "obs_id", "v", 99), autocorr.permutation_bins(99))


CL = "CASE WHEN k = 0 THEN 5 WHEN z >= 0 AND lag >= 0 THEN 1 WHEN z < 0 AND lag < 0 THEN 2 WHEN z < 0 THEN 3 ELSE 4 END"


@query("a07_local_moran", "obs_id:i z:f lag:f lisa:f", LAG, "SELECT obs_id, z, lag, z * lag AS lisa FROM lg")
def _a07(t):
    return autocorr.lisa(t.values(), t.queen(), "obs_id", "v")


@query("a07_local_moran_bivariate", "obs_id:i lisa:f", BIV, "SELECT obs_id, z * (SELECT avg(z2.z) FROM wq JOIN z2 ON z2.obs_id = wq.dst WHERE wq.src = z1.obs_id) AS lisa FROM z1")
def _a07b(t):
    return autocorr.lisa(t.values().withColumn("r", F.col("e") / F.col("p")), t.queen(), "obs_id", "r", "v")


@query("a07_local_moran_eb", "obs_id:i lisa:f", EBZ, "SELECT obs_id, z * (SELECT avg(b.z) FROM wq JOIN zz b ON b.obs_id = wq.dst WHERE wq.src = a.obs_id) AS lisa FROM zz a")
def _a07e(t):
    return autocorr.lisa(rates.eb_standardize(t.values(), "e", "p", "r"), t.queen(), "obs_id", "r")


@query("a08_lisa_clusters", "obs_id:i cluster:i", LAG, f"SELECT obs_id, {CL} AS cluster FROM lg")
def _a08(t):
    return autocorr.lisa(t.values(), t.queen(), "obs_id", "v")


DRAWS = f"{LAG}, dr AS (SELECT a.obs_id, r.p, b.{{0}} AS o, row_number() OVER (PARTITION BY a.obs_id, r.p ORDER BY md5(concat_ws('|', '42', r.p::VARCHAR, a.obs_id::VARCHAR, b.obs_id::VARCHAR))) AS rk, a.k, a.z, a.lag FROM lg a JOIN lg b ON a.obs_id <> b.obs_id JOIN range(1, 100) r(p) ON true), ct AS (SELECT obs_id, p, any_value(z) AS z, any_value(lag) AS lag, avg(o) AS m FROM dr WHERE rk <= k GROUP BY 1, 2)"
PSEUDO = DRAWS.format("z") + ", pp AS (SELECT obs_id, (least(c, 99 - c) + 1) / 100.0::DOUBLE AS p FROM (SELECT obs_id, sum(CASE WHEN z * m >= z * lag THEN 1 ELSE 0 END) AS c FROM ct GROUP BY 1)), li AS (SELECT lg.*, z * lag AS lisa, " + CL + " AS cluster, pp.p, CASE WHEN k = 0 THEN 5 WHEN p <= .0001 THEN 4 WHEN p <= .001 THEN 3 WHEN p <= .01 THEN 2 WHEN p <= .05 THEN 1 ELSE 0 END AS sig FROM lg LEFT JOIN pp USING (obs_id))"


def _lisa(t):
    return autocorr.lisa_pseudo_p(autocorr.lisa(t.values().select("obs_id", "v"), t.queen(), "obs_id", "v"), "obs_id", 99)


@query("a09_lisa_pseudo_p", "obs_id:i p:f", PSEUDO, "SELECT obs_id, p FROM li")
def _a09(t):
    return _lisa(t)


@query("a09_lisa_pseudo_p_sampled", "obs_id:i p:f sig:i")
def _a09s(t):
    c = t.customers()
    return autocorr.lisa_pseudo_p_sampled(autocorr.lisa(c, weights.knn(c, 6), "obs_id", "v"), "obs_id", 499)


@query("a10_significance", "obs_id:i sig:i", PSEUDO, "SELECT obs_id, sig FROM li")
def _a10(t):
    return _lisa(t)


@query("a11_save_lisa", "obs_id:i LISA_I:f LISA_CL:i LISA_P:f", PSEUDO, "SELECT obs_id, lisa AS LISA_I, CASE WHEN cluster = 5 THEN 5 WHEN p <= 0.05 THEN cluster ELSE 0 END AS LISA_CL, p AS LISA_P FROM li")
def _a11(t):
    return autocorr.save_lisa(_lisa(t), "obs_id")


REGISTERED = query("flagship_lisa_revenue", "obs_id:i n_name:s z:f lag:f lisa:f cluster:i p:f sig:i", PSEUDO, "SELECT obs_id, n_name, z, lag, lisa, cluster, p, sig FROM li JOIN nation ON n_nationkey = obs_id")(lambda t: _lisa(t).join(t.nation.select(F.col("n_nationkey").alias("obs_id"), "n_name"), "obs_id"))

_sel("s15_cores", lambda t: select.cores(_lisa(t), t.queen(), "obs_id"), "cluster BETWEEN 1 AND 4 AND p <= 0.05", PSEUDO, "li")
_sel("s15_core_neighbours", lambda t: select.cores(_lisa(t), t.queen(), "obs_id", "neighbours"), "NOT (cluster BETWEEN 1 AND 4 AND p <= 0.05) AND obs_id IN (SELECT dst FROM wq JOIN li c ON c.obs_id = src WHERE c.cluster BETWEEN 1 AND 4 AND c.p <= 0.05)", PSEUDO, "li")
_sel("s15_cores_and_neighbours", lambda t: select.cores(_lisa(t), t.queen(), "obs_id", "both"), "(cluster BETWEEN 1 AND 4 AND p <= 0.05) OR obs_id IN (SELECT dst FROM wq JOIN li c ON c.obs_id = src WHERE c.cluster BETWEEN 1 AND 4 AND c.p <= 0.05)", PSEUDO, "li")


def _tail(z: str) -> str:
    return f"exp(-{z} * {z} / 2) / sqrt(2 * pi()) * (1 / (1 + 0.2316419 * abs({z}))) * (0.319381530 + (1 / (1 + 0.2316419 * abs({z}))) * (-0.356563782 + (1 / (1 + 0.2316419 * abs({z}))) * (1.781477937 + (1 / (1 + 0.2316419 * abs({z}))) * (-1.821255978 + (1 / (1 + 0.2316419 * abs({z}))) * 1.330274429))))"


GETIS = f"{WQ}, {VAL}, gs AS (SELECT obs_id, v, (SELECT sum(b.v) FROM wq JOIN val b ON b.obs_id = dst WHERE src = a.obs_id) AS s, CAST((SELECT count(*) FROM wq WHERE src = a.obs_id) AS DOUBLE) AS k, CAST(count(*) OVER () AS DOUBLE) AS n, sum(v) OVER () AS tx, sum(v * v) OVER () AS txx FROM val a), gg AS (SELECT *, s / k / (tx - v) AS g, (s + v) / (k + 1) / tx AS g_star, 1 / (n - 1) AS eg, (n - 2) * ((txx - v * v) / (n - 1) - ((tx - v) / (n - 1)) * ((tx - v) / (n - 1))) / ((n - 1) * (n - 1) * (n - 2) * ((tx - v) / (n - 1)) * ((tx - v) / (n - 1))) AS vg, (n - 1) * (txx / n - (tx / n) * (tx / n)) / (n * n * (n - 1) * (tx / n) * (tx / n)) AS vs FROM gs), gz AS (SELECT *, (g - eg) / sqrt(vg) AS z_g, (g_star - 1 / n) / sqrt(vs) AS z_star FROM gg), gp AS (SELECT *, {_tail('z_g')} AS p_g, {_tail('z_star')} AS p_star FROM gz), gc AS (SELECT *, CASE WHEN p_g > 0.05 THEN 0 WHEN z_g > 0 THEN 1 ELSE 2 END AS cluster_g, CASE WHEN p_star > 0.05 THEN 0 WHEN z_star > 0 THEN 1 ELSE 2 END AS cluster_star FROM gp)"


def _getis(t):
    return autocorr.getis_ord(t.values(), t.queen(), "obs_id", "v")


for _name, _spec in (("a12_getis_ord_g", "obs_id:i g:f z_g:f p_g:f"), ("a13_getis_ord_g_star", "obs_id:i g_star:f z_star:f p_star:f"), ("a16_g_clusters", "obs_id:i cluster_g:i cluster_star:i"), ("a17_save_g", "obs_id:i g:f cluster_g:i z_g:f p_g:f g_star:f cluster_star:i z_star:f p_star:f")):
    query(_name, _spec, GETIS, "SELECT * FROM gc")(_getis)


@query("a14_g_moments", "n:i sx:f sxx:f eg:f es:f", f"{VAL}", "SELECT count(*) AS n, sum(v) AS sx, sum(v * v) AS sxx, 1 / (count(*) - 1.0::DOUBLE) AS eg, 1 / CAST(count(*) AS DOUBLE) AS es FROM val", digits=2)
def _a14(t):
    live = t.values().join(t.queen().select(F.col("src").alias("obs_id")).distinct(), "obs_id", "left_semi")
    return live.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("sx"), F.sum(F.col("v") * F.col("v")).alias("sxx")).withColumns({"eg": 1 / (F.col("n") - 1), "es": 1 / F.col("n")})


#: Counts of G and G* that reach the observed ones, as lines in the mean of the neighbours.
GPERM = DRAWS.format("v") + f", {VAL.replace('val AS', 'val2 AS')}, gt AS (SELECT sum(v) AS tx FROM val2), go AS (SELECT a.obs_id, a.v, tx, (SELECT avg(b.v) FROM wq JOIN val2 b ON b.obs_id = dst WHERE src = a.obs_id) AS m0, CAST((SELECT count(*) FROM wq WHERE src = a.obs_id) AS DOUBLE) AS k FROM val2 a, gt), gn AS (SELECT ct.obs_id, sum(CASE WHEN m / (tx - v) >= m0 / (tx - v) THEN 1 ELSE 0 END) AS c, sum(CASE WHEN (k * m + v) / ((k + 1) * tx) >= (k * m0 + v) / ((k + 1) * tx) THEN 1 ELSE 0 END) AS cs FROM ct JOIN go USING (obs_id) GROUP BY 1)"


@query("a15_g_pseudo_p", "obs_id:i pp_g:f pp_star:f", GPERM, "SELECT obs_id, (least(c, 99 - c) + 1) / 100.0::DOUBLE AS pp_g, (least(cs, 99 - cs) + 1) / 100.0::DOUBLE AS pp_star FROM gn")
def _a15(t):
    return autocorr.g_pseudo_p(_getis(t), "obs_id", "v", 99)


@query("a09_lisa_pseudo_p_independent", "obs_id:i p:f sig:i")
def _a09i(t):
    c = t.customers()
    return autocorr.lisa_pseudo_p_sampled(autocorr.lisa(c, weights.knn(c, 6), "obs_id", "v"), "obs_id", 499, independent=True)


@query("a15_g_pseudo_p_independent", "obs_id:i pp_g:f pp_star:f")
def _a15i(t):
    c = t.customers()
    return autocorr.g_pseudo_p_sampled(autocorr.getis_ord(c, weights.knn(c, 6), "obs_id", "v"), "obs_id", "v", 499, independent=True)


@query("a15_g_pseudo_p_sampled", "obs_id:i pp_g:f pp_star:f")
def _a15s(t):
    c = t.customers().withColumn("v", F.col("v") + 1000)
    return autocorr.g_pseudo_p_sampled(autocorr.getis_ord(c, weights.knn(c, 6), "obs_id", "v"), "obs_id", "v", 499)


TIMES = f"{WQ}, {NY}, zt AS (SELECT obs_id, time_id, (v - avg(v) OVER (PARTITION BY time_id)) / stddev_samp(v) OVER (PARTITION BY time_id) AS z FROM ny), lt AS (SELECT a.obs_id, a.time_id, a.z, coalesce((SELECT avg(b.z) FROM wq JOIN zt b ON b.obs_id = dst WHERE src = a.obs_id AND b.time_id = a.time_id), 0) AS lag FROM zt a)"


@query("a18_moran_by_period", "time_id:i moran:f", TIMES, "SELECT time_id, sum(z * lag) / (count(*) - 1) AS moran FROM lt GROUP BY 1")
def _a18(t):
    return autocorr.moran(t.nation_year(), t.queen(), "obs_id", "v", by=["time_id"])


@query("a18_lisa_by_period", "obs_id:i time_id:i lisa:f cluster:i", TIMES, "SELECT obs_id, time_id, z * lag AS lisa, CASE WHEN z >= 0 AND lag >= 0 THEN 1 WHEN z < 0 AND lag < 0 THEN 2 WHEN z < 0 THEN 3 ELSE 4 END AS cluster FROM lt")
def _a18l(t):
    return autocorr.lisa(t.nation_year(), t.queen(), "obs_id", "v", by=["time_id"])


@query("a18_lisa_pseudo_p_by_period", "obs_id:i time_id:i p:f sig:i")
def _a18p(t):
    return autocorr.lisa_pseudo_p_sampled(autocorr.lisa(t.nation_year(), t.queen(), "obs_id", "v", by=["time_id"]), "obs_id", 499, by=["time_id"])


GTIMES = f"{WQ}, {NY}, gs AS (SELECT obs_id, time_id, v, (SELECT sum(b.v) FROM wq JOIN ny b ON b.obs_id = dst WHERE src = a.obs_id AND b.time_id = a.time_id) AS s, CAST((SELECT count(*) FROM wq JOIN ny b ON b.obs_id = dst WHERE src = a.obs_id AND b.time_id = a.time_id) AS DOUBLE) AS k, sum(v) OVER (PARTITION BY time_id) AS tx FROM ny a)"


@query("a18_g_by_period", "obs_id:i time_id:i g:f g_star:f", GTIMES, "SELECT obs_id, time_id, s / k / (tx - v) AS g, (s + v) / (k + 1) / tx AS g_star FROM gs")
def _a18g(t):
    return autocorr.getis_ord(t.nation_year(), t.queen(), "obs_id", "v", by=["time_id"])


@query("a18_g_pseudo_p_by_period", "obs_id:i time_id:i pp_g:f pp_star:f")
def _a18gp(t):
    return autocorr.g_pseudo_p_sampled(autocorr.getis_ord(t.nation_year(), t.queen(), "obs_id", "v", by=["time_id"]), "obs_id", "v", 499, by=["time_id"])


@query("m10_lisa_map", "cluster:i n:i", PSEUDO, "SELECT CASE WHEN p <= 0.05 THEN cluster ELSE 0 END AS cluster, count(*) AS n FROM li GROUP BY 1")
def _m10(t):
    return autocorr.save_lisa(_lisa(t), "obs_id").groupBy(F.col("LISA_CL").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query("m11_g_map", "cluster_g:i n:i", GETIS, "SELECT cluster_g, count(*) AS n FROM gc GROUP BY 1")
def _m11(t):
    return _getis(t).groupBy("cluster_g").agg(F.count(F.lit(1)).alias("n"))
