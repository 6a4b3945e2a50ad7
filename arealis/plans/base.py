"""Registration of queries, output specifications, and the spatial fixtures over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arealis.operators.geometry import rectangle
from arealis.operators.weights import queen, rook

#: name -> (query, oracle SQL or None)
REGISTRY: dict[str, tuple[Callable, str | None]] = {}
KINDS = {"i": "bigint", "f": "double", "s": "string", "b": "boolean", "d": "date"}


def query(name: str, spec: str, ctes: str = "", body: str | None = None, digits: int = 6):
    """Register a query. `spec` lists outputs as `name:kind`; both engines cast and round alike."""
    columns = [c.split(":") for c in spec.split()]

    def wrap(fn: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Tables(spark, sf_dir))
            return df.select(*[(F.round(F.col(n).cast("double"), digits) + 0.0 if k == "f" else F.col(n).cast(KINDS[k])).alias(n) for n, k in columns])

        sql = None
        if body is not None:
            with_ = f"WITH {ctes} " if ctes else ""
            outs = ", ".join(f"round(CAST({n} AS DOUBLE), {digits}) + 0.0 AS {n}" if k == "f" else f"CAST({n} AS {'VARCHAR' if k == 's' else KINDS[k].upper()}) AS {n}" for n, k in columns)
            sql = f"SELECT {outs} FROM ({with_}{body}) t"
        REGISTRY[name] = (run, sql)
        return run

    return wrap


class Tables:
    """The driver's tables and the fixtures on them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def lattice(self) -> DataFrame:
        """25 nations on a 5 x 5 grid of unit squares: obs_id, x, y, geom."""
        base = self.nation.select(F.col("n_nationkey").cast("long").alias("obs_id"), (F.col("n_nationkey") % 5).alias("x"), F.floor(F.col("n_nationkey") / 5).cast("int").alias("y"))
        return base.withColumn("geom", rectangle(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1))

    def queen(self) -> DataFrame:
        return queen(self.lattice())

    def rook(self) -> DataFrame:
        return rook(self.lattice())

    def values(self) -> DataFrame:
        """Per customer nation: v revenue in millions, e orders of status F, p orders."""
        joined = self.orders.select("o_custkey", "o_totalprice", "o_orderstatus").join(self.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
        return joined.groupBy(F.col("c_nationkey").cast("long").alias("obs_id")).agg((F.sum("o_totalprice") / 1e6).alias("v"), F.sum(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("e"), F.count(F.lit(1)).cast("double").alias("p"))

    def nation_year(self) -> DataFrame:
        joined = self.orders.select("o_custkey", "o_totalprice", F.year("o_orderdate").alias("time_id")).join(self.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
        return joined.groupBy(F.col("c_nationkey").cast("long").alias("obs_id"), "time_id").agg((F.sum("o_totalprice") / 1e6).alias("v"), F.count(F.lit(1)).cast("double").alias("p"), F.avg("o_totalprice").alias("a"))

    def suppliers(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.supplier.select(k.alias("obs_id"), (k % 10 + (k * 7) % 11 / 100.0).alias("x"), (F.floor(k / 10) + (k * 3) % 13 / 100.0).alias("y"), F.col("s_acctbal").alias("v"))

    def customers(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.customer.select(k.alias("obs_id"), (k % 40 + (k * 7) % 11 / 100.0).alias("x"), (F.floor(k / 40) + (k * 3) % 13 / 100.0).alias("y"), F.col("c_acctbal").alias("v"))

    def globe(self) -> DataFrame:
        """Customers all over the globe, in degrees; those of one latitude in 1801 stand at a pole."""
        k = F.col("c_custkey")
        return self.customer.select(k.alias("obs_id"), ((k * 1375) % 3600 / 10.0 - 180).alias("x"), ((k * 7919) % 1801 / 10.0 - 90).alias("y"))

    def embedded(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("obs_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))

    def parts(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("obs_id"), "p_size", F.col("p_retailprice").alias("price"), "p_brand", "p_type")


NAT = "nat AS (SELECT n_nationkey AS obs_id, n_nationkey % 5 AS x, n_nationkey // 5 AS y FROM nation)"
VAL = "val AS (SELECT c_nationkey AS obs_id, sum(o_totalprice) / 1e6 AS v, sum(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS e, CAST(count(*) AS DOUBLE) AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"
VTX = "vtx AS (SELECT obs_id, x + dx AS vx, y + dy AS vy FROM nat, (VALUES (0, 0), (1, 0), (1, 1), (0, 1)) d(dx, dy))"
WQ = f"{NAT}, {VTX}, wq AS (SELECT DISTINCT a.obs_id AS src, b.obs_id AS dst FROM vtx a JOIN vtx b ON a.vx = b.vx AND a.vy = b.vy AND a.obs_id <> b.obs_id)"
WR = "wr AS (SELECT a.obs_id AS src, b.obs_id AS dst FROM nat a JOIN nat b ON abs(a.x - b.x) + abs(a.y - b.y) = 1)"
NY = "ny AS (SELECT c_nationkey AS obs_id, year(o_orderdate) AS time_id, sum(o_totalprice) / 1e6 AS v, CAST(count(*) AS DOUBLE) AS p, avg(o_totalprice) AS a FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
SUP = "sup AS (SELECT s_suppkey AS obs_id, s_suppkey % 10 + ((s_suppkey * 7) % 11) / 100.0::DOUBLE AS x, s_suppkey // 10 + ((s_suppkey * 3) % 13) / 100.0::DOUBLE AS y, s_acctbal AS v FROM supplier)"
CUS = "cus AS (SELECT c_custkey AS obs_id, c_custkey % 40 + ((c_custkey * 7) % 11) / 100.0::DOUBLE AS x, c_custkey // 40 + ((c_custkey * 3) % 13) / 100.0::DOUBLE AS y, c_acctbal AS v FROM customer)"
GLO = "glo AS (SELECT c_custkey AS obs_id, ((c_custkey * 1375) % 3600) / 10.0::DOUBLE - 180 AS x, ((c_custkey * 7919) % 1801) / 10.0::DOUBLE - 90 AS y FROM customer)"
EMB = "emb AS (SELECT vec_id AS obs_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
PAR = "par AS (SELECT p_partkey AS obs_id, p_size, p_retailprice AS price, p_brand, p_type FROM part)"
#: Standardised values and kernel lags on the lattice.
ZED = f"{WQ}, {VAL}, zed AS (SELECT obs_id, v, (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS z FROM val)"
LAG = f"{ZED}, lg AS (SELECT z.obs_id, z.v, z.z, coalesce((SELECT avg(b.z) FROM wq JOIN zed b ON b.obs_id = wq.dst WHERE wq.src = z.obs_id), 0) AS lag, (SELECT count(*) FROM wq WHERE wq.src = z.obs_id) AS k FROM zed z)"
