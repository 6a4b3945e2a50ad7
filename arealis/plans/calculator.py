"""Calculator, rates and table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from arealis.functions import calc, stats
from arealis.operators import rates, tables
from arealis.operators.rank import hazen, hinges, legacy_quartiles
from arealis.plans.base import NAT, NY, PAR, VAL, WQ, query
from arealis.sources import text

CUST = "SELECT c_custkey AS obs_id, c_acctbal AS x, c_nationkey AS y FROM customer"


def _cust(t):
    return t.customer.select(F.col("c_custkey").alias("obs_id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").alias("y"))


def _scalar(name, fn, sql):
    @query(name, "obs_id:i r:f", f"cust AS ({CUST})", f"SELECT obs_id, {sql} AS r FROM cust")
    def run(t):
        return _cust(t).withColumn("r", fn())

    return run


x, y = "x", "y"
_scalar("c01_assign", lambda: calc.assign("x"), "x")
_scalar("c02_negative", lambda: calc.negative("x"), "-x")
_scalar("c03_invert", lambda: calc.invert(F.col("y")), "CASE WHEN y <> 0 THEN 1.0::DOUBLE / y END")
_scalar("c04_square_root", lambda: calc.square_root("x"), "CASE WHEN x >= 0 THEN sqrt(x) END")
_scalar("c05_log10", lambda: calc.log_ten("x"), "CASE WHEN x > 0 THEN log10(x) END")
_scalar("c06_ln", lambda: calc.log_natural("x"), "CASE WHEN x > 0 THEN ln(x) END")
_scalar("c10_add", lambda: calc.add("x", "y"), "x + y")
_scalar("c10_subtract", lambda: calc.subtract("x", "y"), "x - y")
_scalar("c10_multiply", lambda: calc.multiply("x", F.lit(1.5)), "x * 1.5")
_scalar("c11_divide", lambda: calc.divide("x", "y"), "CASE WHEN y <> 0 THEN x / y END")
_scalar("c12_power", lambda: calc.power(F.col("x") / 10000, F.col("y") % 5 - 2), "CASE WHEN x = 0 AND y % 5 < 2 THEN NULL ELSE pow(x / 10000, y % 5 - 2) END")


@query("c07_deviation_from_mean", "obs_id:i r:f", f"cust AS ({CUST})", "SELECT obs_id, x - avg(x) OVER () AS r FROM cust", digits=4)
def _c07(t):
    return calc.deviation_from_mean(_cust(t), "x", "r")


@query("c08_standardized", "obs_id:i r:f", f"cust AS ({CUST})", "SELECT obs_id, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS r FROM cust")
def _c08(t):
    return calc.standardize(_cust(t), "x", "r")


@query("c09_shuffle", "obs_id:i r:f", f"cust AS ({CUST})", "SELECT a.obs_id, b.x AS r FROM (SELECT obs_id, row_number() OVER (ORDER BY obs_id) k FROM cust) a JOIN (SELECT x, row_number() OVER (ORDER BY md5(concat_ws('|', '42', obs_id::VARCHAR))) k FROM cust) b USING (k)")
def _c09(t):
    return calc.shuffle(_cust(t), "x", "obs_id", "r")


@query("c13_all_times", "obs_id:i time_id:i r:f", NY, "SELECT obs_id, time_id, (v - avg(v) OVER (PARTITION BY time_id)) / stddev_samp(v) OVER (PARTITION BY time_id) AS r FROM ny")
def _c13(t):
    return calc.standardize(t.nation_year(), "v", "r", ["time_id"])


@query("c14_normal_random", "obs_id:i r:f")
def _c14(t):
    return _cust(t).withColumn("r", calc.normal_random(42, 5.0, 2.0))


@query("c15_uniform_random", "obs_id:i r:f")
def _c15(t):
    return _cust(t).withColumn("r", calc.uniform_random(42))


@query("c16_enumerate", "obs_id:i r:i", f"cust AS ({CUST})", "SELECT obs_id, row_number() OVER (ORDER BY obs_id) AS r FROM cust")
def _c16(t):
    return calc.enumerate_rows(_cust(t), "obs_id", "r")


def _rate(name, fn, ctes, sql):
    query(name, "obs_id:i r:f", ctes, sql)(fn)


EB = f"{VAL}, t1 AS (SELECT sum(e) / sum(p) AS b, sum(p) / count(*) AS m, sum(p) AS tp FROM val), t2 AS (SELECT greatest(0, sum(p * (e / p - b) * (e / p - b)) / any_value(tp) - any_value(b) / any_value(m)) AS a, any_value(b) AS b FROM val, t1)"
NEAR = f"{WQ}, {VAL}, around AS (SELECT src, dst FROM wq UNION ALL SELECT DISTINCT src, src FROM wq), n1 AS (SELECT src, sum(e) AS e, sum(p) AS p, count(*) AS n FROM around JOIN val ON obs_id = dst GROUP BY src)"
_rate("r01_raw_rate", lambda t: rates.raw_rate(t.values(), "e", "p", "r"), VAL, "SELECT obs_id, e / p AS r FROM val")
_rate("r02_excess_risk", lambda t: rates.excess_risk(t.values(), "e", "p", "r"), VAL, "SELECT obs_id, e / (p * (sum(e) OVER () / sum(p) OVER ())) AS r FROM val")
_rate("r03_empirical_bayes", lambda t: rates.empirical_bayes(t.values(), "e", "p", "r"), EB, "SELECT obs_id, (a / (a + b / p)) * (e / p) + (1 - a / (a + b / p)) * b AS r FROM val, t2")
_rate("r04_spatial_rate", lambda t: rates.spatial_rate(t.values(), t.queen(), "obs_id", "e", "p", "r"), NEAR, "SELECT src AS obs_id, e / p AS r FROM n1")
_rate("r05_spatial_empirical_bayes", lambda t: rates.spatial_empirical_bayes(t.values(), t.queen(), "obs_id", "e", "p", "r"), NEAR + ", n2 AS (SELECT a.src, any_value(n1.e / n1.p) AS b, greatest(0, sum(v.p * (v.e / v.p - n1.e / n1.p) * (v.e / v.p - n1.e / n1.p)) / any_value(n1.p) - any_value(n1.e / n1.p) / any_value(n1.p / n1.n)) AS a FROM around a JOIN val v ON v.obs_id = a.dst JOIN n1 ON n1.src = a.src GROUP BY a.src)", "SELECT obs_id, coalesce(a / nullif(a + b / p, 0), 0) * (e / p) + (1 - coalesce(a / nullif(a + b / p, 0), 0)) * b AS r FROM val JOIN n2 ON src = obs_id")
_rate("r06_eb_standardization", lambda t: rates.eb_standardize(t.values(), "e", "p", "r"), EB, "SELECT obs_id, (e / p - b) / sqrt(a + b / p) AS r FROM val, t2")


@query("r01_raw_rate_all_times", "obs_id:i time_id:i r:f", NY, "SELECT obs_id, time_id, v / p AS r FROM ny")
def _r01t(t):
    return rates.raw_rate(t.nation_year(), "v", "p", "r", ["time_id"])


# Tables


@query("t01_add_variable", "obs_id:i x:f extra:f", f"cust AS ({CUST})", "SELECT obs_id, x, CAST(NULL AS DOUBLE) AS extra FROM cust")
def _t01(t):
    return tables.add_variable(_cust(t), "extra", "double")


@query("t02_delete_variable", "n_columns:i n:i", "", "SELECT 4 AS n_columns, count(*) AS n FROM customer")
def _t02(t):
    left = tables.delete_variable(t.customer, "c_name")
    return left.agg(F.count(F.lit(1)).alias("n")).withColumn("n_columns", F.lit(len(left.columns)))


@query("t03_clamp_and_truncate", "obs_id:i bal:f name:s", "", "SELECT c_custkey AS obs_id, least(greatest(c_acctbal, -99.99), 999.99) AS bal, substring(c_name, 1, 10) AS name FROM customer")
def _t03(t):
    return tables.rename(t.customer, "c_custkey", "obs_id").withColumn("bal", tables.clamp("c_acctbal", 6, 2)).withColumn("name", tables.truncate("c_name", 10))


@query("t04_reorder_columns", "c_acctbal:f c_custkey:i", "", "SELECT c_acctbal, c_custkey FROM customer")
def _t04(t):
    return tables.reorder_columns(t.customer, ["c_acctbal", "c_custkey"])


@query("t06_add_unique_id", "obs_id:i uid:i", "", "SELECT c_custkey AS obs_id, row_number() OVER (ORDER BY c_custkey) AS uid FROM customer")
def _t06(t):
    return tables.add_unique_id(_cust(t), "obs_id", "uid")


@query("t07_uniqueness_check", "cust_ok:b line_ok:b", "", "SELECT (SELECT count(*) = count(DISTINCT c_custkey) FROM customer) AS cust_ok, (SELECT count(*) = count(DISTINCT l_orderkey) FROM lineitem) AS line_ok")
def _t07(t):
    return t.spark.createDataFrame([(tables.is_unique(t.customer, "c_custkey"), tables.is_unique(t.lineitem, "l_orderkey"))], "cust_ok boolean, line_ok boolean")


@query("t08_sort_by_column", "obs_id:i pos:i", "", "SELECT c_custkey AS obs_id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS pos FROM customer")
def _t08(t):
    from arealis.operators.rank import ranked

    return ranked(_cust(t).withColumn("neg", -F.col("x")), "neg", "pos", ties=["obs_id"])


@query("t09_reverse_order", "obs_id:i x:f", f"cust AS ({CUST})", "SELECT obs_id, x FROM cust ORDER BY obs_id DESC")
def _t09(t):
    return tables.reverse_rows(_cust(t), "obs_id")


@query("t10_selected_to_top", "obs_id:i selected:b", f"cust AS ({CUST})", "SELECT obs_id, x > 5000 AS selected FROM cust ORDER BY selected DESC, obs_id")
def _t10(t):
    return tables.selected_first(_cust(t).withColumn("selected", F.col("x") > 5000), "obs_id")


@query("t11_merge_record_order", "obs_id:i x:f tot:f", f"cust AS ({CUST})", "SELECT a.obs_id, a.x, b.tot FROM (SELECT *, row_number() OVER (ORDER BY obs_id) k FROM cust) a JOIN (SELECT obs_id, x * 2 AS tot, row_number() OVER (ORDER BY obs_id) k FROM cust) b USING (k)")
def _t11(t):
    return tables.merge_by_order(_cust(t), _cust(t).select(F.col("obs_id").alias("id2"), (F.col("x") * 2).alias("tot")), "obs_id", "id2")


@query("t12_merge_key", "obs_id:i x:f tot:f", f"cust AS ({CUST})", "SELECT obs_id, x, coalesce(tot, 0) AS tot FROM cust LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS tot FROM orders GROUP BY 1) o ON o_custkey = obs_id", digits=2)
def _t12(t):
    totals = t.orders.groupBy(F.col("o_custkey").alias("obs_id")).agg(F.sum("o_totalprice").alias("tot"))
    filled = _cust(t).select("obs_id").join(totals, "obs_id", "left").fillna(0.0)
    return tables.merge_by_key(_cust(t), filled, "obs_id", "obs_id")


WIDE = ", ".join(f"sum(v) FILTER (time_id = {k}) AS v_{k}" for k in range(1995, 2002))


@query("t14_group_to_time", "obs_id:i time_id:i v:f", f"{NY}, wide AS (SELECT obs_id, {WIDE} FROM ny GROUP BY 1)", "SELECT obs_id, CAST(substring(n, 3) AS INT) AS time_id, v FROM (UNPIVOT (SELECT * FROM wide) ON v_1995, v_1996, v_1997, v_1998, v_1999, v_2000, v_2001 INTO NAME n VALUE v)")
def _t14(t):
    wide = tables.time_to_columns(t.nation_year(), "obs_id", list(range(1995, 2002)))
    return tables.group_to_time(wide, "obs_id", {f"v_{k}": k for k in range(1995, 2002)}).where("v is not null")


@query("io10_time_columns", "obs_id:i " + " ".join(f"v_{k}:f" for k in range(1995, 2002)), NY, f"SELECT obs_id, {WIDE} FROM ny GROUP BY 1")
def _io10(t):
    return tables.time_to_columns(t.nation_year(), "obs_id", list(range(1995, 2002)))


@query("t15_space_time_check", "n_rows:i n_space:i n_time:i duplicates:i ok:b", NY, "SELECT count(*) AS n_rows, count(DISTINCT obs_id) AS n_space, count(DISTINCT time_id) AS n_time, 0 AS duplicates, true AS ok FROM ny")
def _t15(t):
    return tables.check_space_time(t.nation_year(), "obs_id", "time_id")


@query("t16_time_slice", "obs_id:i v:f", NY, "SELECT obs_id, v FROM ny WHERE time_id = 1998")
def _t16(t):
    return tables.time_slice(t.nation_year(), 1998)


@query("t17_time_alignment", "obs_id:i time_idx:i v:f p:f", f"{NY}, nx AS (SELECT *, dense_rank() OVER (ORDER BY time_id) - 1 AS i FROM ny)", "SELECT a.obs_id, a.i AS time_idx, a.v, b.p FROM nx a JOIN nx b ON a.obs_id = b.obs_id AND b.i = a.i + 2")
def _t17(t):
    return tables.align(t.nation_year(), "obs_id", {"v": 0, "p": 2})


@query("t18_ranges", "time_id:i min_v:f max_v:f min_all:f max_all:f", NY, "SELECT time_id, min(v) AS min_v, max(v) AS max_v, min(min(v)) OVER () AS min_all, max(max(v)) OVER () AS max_all FROM ny GROUP BY 1")
def _t18(t):
    return tables.ranges(t.nation_year())


@query("io03_space_time_join", "obs_id:i x:i time_id:i v:f", f"{NAT}, {NY}", "SELECT obs_id, x, time_id, v FROM nat JOIN ny USING (obs_id)")
def _io03(t):
    return tables.space_time_join(t.lattice().select("obs_id", "x"), t.nation_year(), "obs_id")


@query("io04_space_time_long", "obs_id:i time_id:i p:f v:f", NY, "SELECT obs_id, time_id, p, v FROM ny")
def _io04(t):
    return t.nation_year().select("obs_id", "time_id", "v", "p")


@query("io09_type_ladder", "name:s kind:s", "", "SELECT unnest(['a', 'b', 'c']) AS name, unnest(['bigint', 'double', 'string']) AS kind")
def _io09(t):
    raw = t.customer.select(F.col("c_custkey").cast("string").alias("a"), F.col("c_acctbal").cast("string").alias("b"), F.col("c_name").alias("c"))
    return text.ladder(raw).withColumnRenamed("column", "name")


@query("io22_save_results", "obs_id:i v:f z:f", f"{VAL}", "SELECT obs_id, v, (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS z FROM val")
def _io22(t):
    v = t.values()
    return tables.save_columns(v, calc.standardize(v, "v", "r"), "obs_id", {"r": "z"})


# Statistics

RANKS = f"{PAR}, rk AS (SELECT price, row_number() OVER (ORDER BY price, obs_id) AS r, count(*) OVER () AS n FROM par)"


def _pos(expr: str) -> str:
    return f"((max(CASE WHEN r = floor({expr}) THEN price END) + max(CASE WHEN r = ceil({expr}) THEN price END)) / 2)"


HINGES = f"SELECT count(*) AS n, {_pos('CASE WHEN n % 2 = 0 THEN (n + 2) / 4 ELSE (n + 3) / 4 END')} AS q1, {_pos('(n + 1) / 2')} AS q2, {_pos('CASE WHEN n % 2 = 0 THEN (3 * n + 2) / 4 ELSE (3 * n + 1) / 4 END')} AS q3 FROM rk"


@query("d01_sample_statistics", "n:i min:f max:f mean:f var_n:f var_n1:f sd:f", PAR, "SELECT count(price) AS n, min(price) AS min, max(price) AS max, avg(price) AS mean, var_pop(price) AS var_n, var_samp(price) AS var_n1, stddev_samp(price) AS sd FROM par", digits=4)
def _d01(t):
    return stats.summary(t.parts(), "price")


@query("d02_normal_tail", "obs_id:i p:f", "", "SELECT c_custkey AS obs_id, exp(-z * z / 2) / sqrt(2 * pi()) * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))) AS p FROM (SELECT c_custkey, c_nationkey / 8.0::DOUBLE AS z, 1 / (1 + 0.2316419 * (c_nationkey / 8.0::DOUBLE)) AS t FROM customer)")
def _d02(t):
    return _cust(t).withColumn("p", stats.normal_tail(F.col("y") / 8.0))


REG = "SELECT regr_slope(price, p_size) AS slope, regr_intercept(price, p_size) AS intercept, regr_r2(price, p_size) AS r2, count(*) AS n, sqrt((regr_syy(price, p_size) - regr_sxy(price, p_size) * regr_sxy(price, p_size) / regr_sxx(price, p_size)) / (count(*) - 2) / regr_sxx(price, p_size)) AS se_slope"


@query("d05_simple_regression", "slope:f intercept:f r2:f n:i se_slope:f", PAR, REG + " FROM par", digits=4)
def _d05(t):
    return stats.simple_regression(t.parts(), "p_size", "price")


@query("d06_hinges", "n:i q1:f q2:f q3:f", RANKS, HINGES)
def _d06(t):
    return hinges(t.parts(), "price", "obs_id")


DAYS = "par AS (SELECT o_orderkey AS obs_id, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS price FROM orders), " + RANKS.partition(", ")[2][RANKS.partition(", ")[2].index("rk AS") :]


@query("d06_hinges_of_dates", "n:i q1:f q2:f q3:f", DAYS, HINGES)
def _d06d(t):
    return hinges(t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day")), "day", "o_orderkey")


def _haz(p: float) -> str:
    e = f"least(greatest({p}::DOUBLE * n / 100 + 0.5, 1.0), n)"
    low, high = f"max(CASE WHEN r = floor({e}) THEN price END)", f"max(CASE WHEN r = ceil({e}) THEN price END)"
    return f"({low} + ({high} - {low}) * max({e} - floor({e})))"


@query("d07_hazen_percentiles", "p0:f p1:f p2:f", RANKS, f"SELECT {_haz(10.0)} AS p0, {_haz(50.0)} AS p1, {_haz(99.0)} AS p2 FROM rk")
def _d07(t):
    return hazen(t.parts(), "price", "obs_id", [10.0, 50.0, 99.0])


@query("d11_legacy_quartiles", "q1:f q3:f", RANKS, "SELECT max(CASE WHEN r = (n + 1) // 4 THEN price END) AS q1, max(CASE WHEN r = 3 * (n + 1) // 4 THEN price END) AS q3 FROM rk")
def _d11(t):
    return legacy_quartiles(t.parts(), "price", "obs_id")
