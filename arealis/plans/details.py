"""Queries of tests, tails, names, edits and reports, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from arealis.functions import calc, stats
from arealis.operators import autocorr, explore, regression, tables
from arealis.plans.base import NY, PAR, VAL, WQ, query
from arealis.sources import dbf

#: A regression of price on size: sums, residuals e and their squares' deviation g from the mean.
LINE = f"{PAR}, ln AS (SELECT CAST(count(*) AS DOUBLE) AS n, regr_intercept(price, p_size) AS a, regr_slope(price, p_size) AS b, regr_sxx(price, p_size) AS sxx, avg(p_size) AS mx, sum(p_size) AS sx, sum(p_size * p_size) AS sq FROM par), rs AS (SELECT p_size AS x, price - a - b * p_size AS e FROM par, ln), es AS (SELECT sum(e * e) AS sse, sum(e * e * e * e) AS e4 FROM rs)"
#: Simpson's rule: places and weights of 2000 steps up to `z`, for each row of a table.
STEPS = "SELECT t.*, i * z / 2000 AS s, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * z / 6000 AS weight FROM {0} t, range(2001) r(i)"


def _fit(t):
    return regression.ols(t.parts(), "price", ["p_size"])


@query("o02_simple_coefficients", "term:s coef:f se:f stat:f p:f", f"{LINE}, tb AS (SELECT 'CONSTANT' AS term, a AS coef, sqrt(sse / (n - 2) * (1 / n + mx * mx / sxx)) AS se, n - 2 AS df FROM ln, es UNION ALL SELECT 'p_size', b, sqrt(sse / (n - 2) / sxx), n - 2 FROM ln, es), tz AS (SELECT *, least(abs(coef / se), 40) AS z FROM tb)", f"SELECT term, coef, se, coef / se AS stat, 1 - 2 * sum(weight * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + s * s / df, -(df + 1) / 2)) AS p FROM ({STEPS.format('tz')}) GROUP BY term, coef, se")
def _o02s(t):
    return _fit(t).table(t.spark)


@query("o04_condition_number", "value:f", LINE, "SELECT sqrt((1 + sx / sqrt(n * sq)) / (1 - sx / sqrt(n * sq))) AS value FROM ln")
def _o04(t):
    return _fit(t).report(t.spark).where("test = 'condition_number'")


@query("o06_breusch_pagan", "test:s df:f value:f p:f", f"{LINE}, ess AS (SELECT regr_r2(e * e, x * x) * regr_syy(e * e, x * x) AS ess FROM rs), ts AS (SELECT 'breusch_pagan' AS test, ess / (2 * (sse / n) * (sse / n)) AS value FROM ess, es, ln UNION ALL SELECT 'koenker_bassett', ess / (e4 / n - (sse / n) * (sse / n)) FROM ess, es, ln), tz AS (SELECT *, least(sqrt(value), 40) AS z FROM ts)", f"SELECT test, 1 AS df, value, 1 - 2 * sum(weight * exp(-s * s / 2)) / sqrt(2 * pi()) AS p FROM ({STEPS.format('tz')}) GROUP BY test, value", digits=5)
def _o06b(t):
    return _fit(t).report(t.spark).where("test in ('breusch_pagan', 'koenker_bassett')")


@query("o07_white", "df:f value:f p:f", f"{LINE}, cs AS (SELECT corr(e * e, x) AS r1, corr(e * e, x * x) AS r2, corr(x, x * x) AS r FROM rs)", "SELECT 2 AS df, value, exp(-value / 2) AS p FROM (SELECT n * (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r) / (1 - r * r) AS value FROM cs, ln)", digits=5)
def _o07(t):
    return _fit(t).report(t.spark).where("test = 'white'")


@query("o14_covariance", "a:s b:s cov:f", LINE, "SELECT 'CONSTANT' AS a, 'CONSTANT' AS b, sse / (n - 2) * (1 / n + mx * mx / sxx) AS cov FROM ln, es UNION ALL SELECT 'p_size', 'p_size', sse / (n - 2) / sxx FROM ln, es UNION ALL SELECT u, v, -mx * sse / (n - 2) / sxx FROM ln, es, (VALUES ('CONSTANT', 'p_size'), ('p_size', 'CONSTANT')) d(u, v)")
def _o14(t):
    fit = _fit(t)
    return t.spark.createDataFrame([(a, b, float(fit.cov[i, j])) for i, a in enumerate(fit.terms) for j, b in enumerate(fit.terms)], "a string, b string, cov double")


@query("io21_regression_report", "test:s value:f", f"{LINE}, f AS (SELECT n, sse, regr_r2(price, p_size) AS r2, -n / 2 * (ln(2 * pi()) + ln(sse / n) + 1) AS l, avg(price) AS m, stddev_samp(price) AS sd FROM par, ln, es GROUP BY n, sse)", "SELECT test, value FROM f, LATERAL (VALUES ('n', n), ('k', 2.0), ('r2', r2), ('rss', sse), ('log_likelihood', l), ('aic', 4 - 2 * l), ('sc', 2 * ln(n) - 2 * l), ('f', r2 / (1 - r2) * (n - 2)), ('mean_y', m), ('sd_y', sd)) v(test, value)", digits=4)
def _io21(t):
    return _fit(t).report(t.spark).where("test in ('n', 'k', 'r2', 'rss', 'log_likelihood', 'aic', 'sc', 'f', 'mean_y', 'sd_y')")


CUST = "SELECT c_custkey AS obs_id, c_acctbal AS x FROM customer"


def _cust(t):
    return t.customer.select(F.col("c_custkey").alias("obs_id"), F.col("c_acctbal").alias("x"))


@query("d03_student_tail", "obs_id:i p:f", "", f"SELECT obs_id, 1 - 2 * (3.0 / 8 * u * (1 - s * s / (12 * (1 + s * s / 4)))) AS p FROM (SELECT obs_id, abs(x) / 2000 AS s, abs(x) / 2000 / sqrt(1 + (x / 2000) * (x / 2000) / 4) AS u FROM ({CUST}))")
def _d03(t):
    return _cust(t).select("obs_id", stats.tail_column(stats.t_two_sided, F.col("x") / 2000, F.lit(4)).alias("p"))


@query("d04_chi_square_and_f_tails", "obs_id:i chi:f f:f", "", f"SELECT obs_id, exp(-s / 2) * (1 + s / 2) AS chi, pow(4 / (4 + 2 * s), 2) AS f FROM (SELECT obs_id, abs(x) / 1000 AS s FROM ({CUST}))")
def _d04(t):
    s = F.abs("x") / 1000
    return _cust(t).select("obs_id", stats.tail_column(stats.chi2_tail, s, F.lit(4)).alias("chi"), stats.tail_column(stats.f_tail, s, F.lit(2), F.lit(4)).alias("f"))


@query("d08_seeded_random", "obs_id:i h:s", "", f"SELECT obs_id, md5(concat_ws('|', '42', obs_id::VARCHAR)) AS h FROM ({CUST})")
def _d08(t):
    return _cust(t).select("obs_id", calc.seed_rank(42, F.col("obs_id")).alias("h"))


@query("d10_distinct_draws", "obs_id:i perm:i k:i m:f", f"{WQ}, {VAL}, nk AS (SELECT src, count(*) AS k FROM wq GROUP BY 1), dr AS (SELECT a.src, a.k, u, b.v, row_number() OVER (PARTITION BY a.src, u ORDER BY md5(concat_ws('|', '7', u::VARCHAR, a.src::VARCHAR, b.obs_id::VARCHAR))) AS r FROM nk a JOIN val b ON b.obs_id <> a.src, range(1, 6) q(u))", "SELECT src AS obs_id, u AS perm, k, avg(v) AS m FROM dr WHERE r <= k GROUP BY 1, 2, 3")
def _d10(t):
    found = t.values().join(t.queen().groupBy(F.col("src").alias("obs_id")).agg(F.count(F.lit(1)).alias("k")), "obs_id")
    return autocorr._first_draws(found, "obs_id", "v", [], 5, 7).withColumnRenamed("_m", "m")


@query("io05_space_time_discovery", "key:s period:s obs_id:i n:i total:f", NY, "SELECT 'n_nationkey' AS key, 'time_id' AS period, obs_id, count(*) AS n, sum(v) AS total FROM ny GROUP BY obs_id")
def _io05(t):
    space, time = t.nation.select("n_name", "n_nationkey"), t.nation_year().select(F.col("obs_id").alias("N_NATIONKEY"), "time_id", "v")
    key, period = dbf.discover_space_time(space, time)
    joined = space.select(F.col(key).alias("_space")).join(time, F.col("_space") == F.col(key)).groupBy(F.col(key).alias("obs_id")).agg(F.count(period).alias("n"), F.sum("v").alias("total"))
    return joined.select(F.lit(key.lower()).alias("key"), F.lit(period).alias("period"), "obs_id", "n", "total")


@query("t05_name_check", "name:s taken:b valid:b n:i", "", "SELECT event_type AS name, event_type IN ('view') AS taken, regexp_full_match(event_type, '[A-Za-z][A-Za-z0-9_]{0,9}') AS valid, count(*) AS n FROM events GROUP BY 1")
def _t05(t):
    taken = t.events.limit(0).withColumn("VIEW", F.lit(1))
    names = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each type
    return t.spark.createDataFrame([(r[0], tables.has_column(taken, r[0]), tables.name_is_valid(r[0]), r[1]) for r in names], "name string, taken boolean, valid boolean, n long")


@query("t13_merge_names", "key:i a:s b:s", "", "SELECT n_nationkey AS key, n_name AS a, r_name AS b FROM nation JOIN region ON r_regionkey = n_regionkey")
def _t13(t):
    left, right = t.nation.toDF("key", "name", "region"), t.region.toDF("region", "NAME")
    new = tables.distinct_names(left.columns, ["NAME"])["NAME"]
    return left.join(right.withColumnRenamed("NAME", new), "region").select("key", F.col("name").alias("a"), F.col(f"`{new}`").alias("b"))


@query("t20_edit_cell", "obs_id:i x:f", "", f"SELECT obs_id, CASE WHEN obs_id = 7 THEN -1.5 ELSE x END AS x FROM ({CUST})")
def _t20(t):
    return tables.edit_cell(_cust(t), "obs_id", 7, "x", -1.5)


@query("v15_axis_ticks", "tick:f", f"{PAR}, e AS (SELECT min(price) AS lo, max(price) AS hi FROM par), s AS (SELECT *, pow(10, floor(log10((hi - lo) / 10))) AS p, (hi - lo) / 10 AS raw FROM e), st AS (SELECT lo, hi, CASE WHEN p >= raw THEN p WHEN 2 * p >= raw THEN 2 * p WHEN 5 * p >= raw THEN 5 * p ELSE 10 * p END AS step FROM s)", "SELECT k * step AS tick FROM st, range(1000) r(k) WHERE k >= floor(lo / step + 1e-9) AND k <= ceil(hi / step - 1e-9)")
def _v15(t):
    low, high = t.parts().agg(F.min("price"), F.max("price")).first()
    return t.spark.createDataFrame([(x,) for x in explore.axis_ticks(low, high)], "tick double")
