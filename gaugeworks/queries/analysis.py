"""Queries of log analysis: boss = order priority, build = nation of the customer, ratio = logged over simulated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions import stats as S
from gaugeworks.operators import selection
from gaugeworks.queries.registry import query
from gaugeworks.session import table

COMPARED = """sim AS (SELECT c_nationkey AS build, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) + 10000 AS sim FROM customer GROUP BY c_nationkey),
logged AS (SELECT o_orderpriority AS boss, c_nationkey AS build, MEDIAN(o_totalprice) AS logs, COUNT(*) AS sample FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
rows_ AS (SELECT boss, build, logs, sample, sim, logs / sim AS ratio FROM logged JOIN sim USING (build))"""


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """boss, build, logs (median), sample, sim and ratio."""
    customers = table(spark, sf_dir, "customer")
    sim = customers.groupBy(F.col("c_nationkey").alias("build")).agg((F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)) + 10000).alias("sim"))
    met = table(spark, sf_dir, "orders").join(customers.select("c_custkey", F.col("c_nationkey").alias("build")), F.col("o_custkey") == F.col("c_custkey"))
    logged = selection.order_statistics(met.withColumnRenamed("o_orderpriority", "boss"), ["boss", "build"], "o_totalprice", {"logs": 0.5})
    logged = logged.select("boss", "build", "logs", F.col("n").alias("sample"))
    return logged.join(sim, "build").withColumn("ratio", F.col("logs") / F.col("sim"))


@query("""SELECT o_orderpriority AS boss, ROUND(MEDIAN(o_totalprice), 3) AS median, ROUND(MIN(o_totalprice), 3) AS low, ROUND(MAX(o_totalprice), 3) AS high, COUNT(o_totalprice) AS n FROM orders GROUP BY 1""")
def spread_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.spreads(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "boss"), ["boss"], "o_totalprice")


@query("""SELECT c_custkey AS build, o_orderpriority AS boss, COUNT(*) AS n, ROUND(MEDIAN(o_totalprice), 4) AS median, CASE WHEN COUNT(*) >= 20 THEN ROUND(QUANTILE_CONT(o_totalprice, 0.95), 4) END AS p95, ROUND(MAX(o_totalprice), 4) AS top
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2 HAVING COUNT(*) >= 5""")
def ranking_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("build"), F.col("o_orderpriority").alias("boss"), "o_totalprice")
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("build"))
    return selection.ranking_summary(rows.join(known, "build", "left_semi"), ["build", "boss"], "o_totalprice", places=4)


_EXPLAINED = """SELECT '{name}' AS grouping_by, ROUND(1 - VAR_POP(ratio - m) / VAR_POP(ratio), 6) AS explained FROM (SELECT *, MEDIAN(ratio) OVER (PARTITION BY {name}) AS m FROM rows_)"""


@query(f"WITH {COMPARED} {_EXPLAINED.format(name='boss')} UNION ALL {_EXPLAINED.format(name='build')}")
def variance_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compared(spark, sf_dir)
    one = lambda g: S.variance_explained(rows, g, "ratio").select(F.lit(g).alias("grouping_by"), F.round("explained", 6).alias("explained"))
    return one("boss").union(one("build"))


_RANKS = """r AS (SELECT boss, CAST(RANK() OVER (PARTITION BY boss ORDER BY logs) AS DOUBLE) + (COUNT(*) OVER (PARTITION BY boss, logs) - 1) / 2.0 AS rx,
  CAST(RANK() OVER (PARTITION BY boss ORDER BY sim) AS DOUBLE) + (COUNT(*) OVER (PARTITION BY boss, sim) - 1) / 2.0 AS ry FROM rows_)"""


@query(f"WITH {COMPARED}, {_RANKS} SELECT boss, COUNT(*) AS n, ROUND(CASE WHEN COUNT(*) >= 8 AND STDDEV_POP(rx) > 0 AND STDDEV_POP(ry) > 0 THEN CORR(rx, ry) END, 6) AS rho FROM r GROUP BY boss")
def rank_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rank_agreement(compared(spark, sf_dir), ["boss"], "logs", "sim", 8).withColumn("rho", F.round("rho", 6))


@query(f"""WITH {COMPARED}, a AS (SELECT *, ratio / MEDIAN(ratio) OVER (PARTITION BY boss) AS adjusted FROM rows_ WHERE sample > 0)
SELECT COUNT(*) AS n, ROUND(CORR(CAST(sample AS DOUBLE), adjusted), 6) AS bias FROM a""")
def sample_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    adjusted = F.col("ratio") / F.median("ratio").over(W.partitionBy("boss"))
    rows = compared(spark, sf_dir).where("sample > 0").withColumn("adjusted", adjusted)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(S.guarded_corr("sample", "adjusted"), 6).alias("bias"))


@query(f"""WITH {COMPARED}, a AS (SELECT *, ratio / MEDIAN(ratio) OVER (PARTITION BY boss) AS field FROM rows_)
SELECT build, COUNT(*) AS n, ROUND(MEDIAN(ratio), 6) AS ratio, CASE WHEN COUNT(*) >= 3 THEN ROUND(MEDIAN(field), 6) END AS vs_field, CASE WHEN COUNT(*) >= 3 THEN ROUND(MIN(field), 6) END AS vs_low, CASE WHEN COUNT(*) >= 3 THEN ROUND(MAX(field), 6) END AS vs_high, CAST(SUM(sample) AS BIGINT) AS sample FROM a GROUP BY build""")
def build_vs_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compared(spark, sf_dir).withColumn("field", F.col("ratio") / F.median("ratio").over(W.partitionBy("boss")))
    enough = lambda c: F.when(F.count(F.lit(1)) >= 3, F.round(c, 6))
    return rows.groupBy("build").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.median("ratio"), 6).alias("ratio"), enough(F.median("field")).alias("vs_field"),
        enough(F.min("field")).alias("vs_low"), enough(F.max("field")).alias("vs_high"), F.sum("sample").alias("sample"),
    )


@query(f"""WITH {COMPARED} SELECT boss, COUNT(*) AS n, ROUND(MEDIAN(ratio), 6) AS median, ROUND(MIN(ratio), 6) AS low, ROUND(MAX(ratio), 6) AS high FROM rows_ GROUP BY boss""")
def boss_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.spreads(compared(spark, sf_dir), ["boss"], "ratio", 6)


@query(f"""WITH {COMPARED} SELECT boss, build, ROW_NUMBER() OVER (PARTITION BY boss ORDER BY logs DESC, build) - ROW_NUMBER() OVER (PARTITION BY boss ORDER BY sim DESC, build) AS move FROM rows_""")
def rank_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = lambda c: F.row_number().over(W.partitionBy("boss").orderBy(F.desc(c), "build")).cast("long")
    return compared(spark, sf_dir).select("boss", "build", (place("logs") - place("sim")).alias("move"))


@query("""WITH c AS (SELECT p_brand AS brand, p_size AS mode, COUNT(*) AS n FROM part GROUP BY 1, 2) SELECT brand, mode, n FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY brand ORDER BY n DESC, mode DESC) = 1""")
def mode_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.mode_high(table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), "p_size"), ["brand"], "p_size")


@query("""SELECT d.lang, l.quality, COUNT(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2""")
def difficulty_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and quality; no label is a group of its own."""
    met = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return met.groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"))
