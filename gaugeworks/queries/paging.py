"""Queries over paged sources: responses are cached pages of the events table, a fight is a user."""

from __future__ import annotations

from math import floor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.queries.registry import query
from gaugeworks.session import scratch_path, table
from gaugeworks.sources import paged
from gaugeworks.sources.ledger import RunLedger

STAMPS, BUCKETS = 10, 16
_PAGES = f"""ev AS (SELECT user_id AS fight, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms, CAST(value AS DECIMAL(18,2)) AS amount FROM events),
pg AS (SELECT *, (DENSE_RANK() OVER (PARTITION BY fight ORDER BY ms) - 1) // {STAMPS} AS page FROM ev),
len AS (SELECT fight, MIN(ms) AS begin_, MAX(ms) - MIN(ms) AS length, MAX(page) AS last_page FROM pg GROUP BY fight)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.floor(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 1000).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("fight"), ms.alias("timestamp"), F.col("event_type").alias("type"), (F.col("event_id") % 5).alias("actor"), "value"
    )


def _cached(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The path of the cached pages, and the fights' lengths."""
    rows = _events(spark, sf_dir)
    path = f"{scratch_path(spark, 'pages')}/pages"
    paged.write_pages(rows.withColumnRenamed("value", "amount"), path, STAMPS, BUCKETS)
    begin = F.min("timestamp")
    return path, rows.groupBy("fight").agg(begin.alias("begin"), (F.max("timestamp") - begin).alias("length"))


@query(f"""WITH {_PAGES}, rd AS (SELECT fight, COUNT(DISTINCT page) AS pages, COUNT(*) AS events, MAX(ms) AS last, SUM(amount) AS total FROM pg WHERE page < 5 GROUP BY fight),
o AS (SELECT fight, pages, events, last_page >= 5 AS truncated, CASE WHEN last_page >= 5 THEN last - begin_ ELSE length END AS reached, length, total FROM rd JOIN len USING (fight))
SELECT fight, pages, events, reached, truncated, CASE WHEN length > 0 THEN ROUND(reached / length, 4) ELSE 0 END AS coverage, CASE WHEN length > 0 THEN ROUND(reached / length, 4) ELSE 0 END >= 0.95 AS complete,
  ROUND(CAST(total AS DOUBLE) / events, 6) AS mean_amount FROM o""")
def paged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five pages of each fight at most: what was read, how far, and the mean over the observed prefix."""
    path, lengths = _cached(spark, sf_dir)
    rows = paged.read_pages(spark, path)
    means = rows.groupBy("fight").agg((F.sum(F.col("amount").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("mean"))
    return paged.observed(rows, lengths).join(means, "fight").select("fight", "pages", "events", "reached", "truncated", "coverage", "complete", F.round("mean", 6).alias("mean_amount"))


@query(f"""WITH {_PAGES}, ls AS (SELECT fight, page, COUNT(*) AS events, MAX(ms) AS last FROM pg GROUP BY fight, page),
n AS (SELECT COUNT(*) AS pages, CAST(FLOOR(0.8 * (COUNT(*) // 2)) AS BIGINT) + 1 AS each FROM ls),
o AS (SELECT fight, page, events, last, (ROW_NUMBER() OVER (ORDER BY fight % {BUCKETS}, fight, page) - 1) // each + 1 AS run FROM ls, n)
SELECT fight, CAST(run AS INT) AS run, COUNT(*) AS pages, CAST(SUM(events) AS BIGINT) AS events, MAX(last) - ANY_VALUE(begin_) AS reached FROM o JOIN len USING (fight) GROUP BY fight, run""")
def paged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, in runs of which each stops at 80 % of a budget of half the pages and the next goes on from its
    offset: what each run read of each fight."""
    path, lengths = _cached(spark, sf_dir)
    pages = spark.read.parquet(path).count()
    budget = max(1, pages // 2)
    each = floor(paged.CEILING * budget) + 1
    out = scratch_path(spark, "paged-stream")
    for run in range(1, -(-pages // each) + 1):
        paged.admitted(paged.stream_pages(spark, path, budget, per_batch=max(100, each // 2)).withColumn("run", F.lit(run)), out)
    read = spark.read.parquet(f"{out}/rows").groupBy("fight", "run").agg(F.countDistinct("page").alias("pages"), F.count(F.lit(1)).alias("events"), F.max("timestamp").alias("last"))
    return read.join(lengths, "fight").select("fight", "run", "pages", "events", (F.col("last") - F.col("begin")).alias("reached"))


@query("""WITH o AS (SELECT o_custkey % 40 AS zone, o_orderkey % 8 + 1 AS page, o_orderkey, o_custkey FROM orders WHERE NOT (o_custkey % 40 % 7 = 3 AND o_orderkey % 8 = 2)),
lim AS (SELECT zone, CASE WHEN zone % 3 = 0 THEN 1 ELSE COUNT(*) // 9 END AS most FROM o GROUP BY zone), p AS (SELECT zone, page, COUNT(*) AS n FROM o WHERE page <= 5 GROUP BY zone, page),
g AS (SELECT lim.zone, k AS page, COALESCE(n, 0) AS n, most FROM lim CROSS JOIN range(1, 6) r(k) LEFT JOIN p ON p.zone = lim.zone AND p.page = k),
s AS (SELECT zone, MIN(page) FILTER (WHERE n = 0 OR n < most) AS stop FROM g GROUP BY zone),
c AS (SELECT o.zone, COUNT(DISTINCT o_custkey) AS codes FROM o JOIN s ON o.zone = s.zone AND o.page <= COALESCE(stop, 5) GROUP BY o.zone)
SELECT s.zone, COALESCE(stop, 5) AS pages, stop IS NULL AS truncated, COALESCE(codes, 0) AS codes FROM s LEFT JOIN c USING (zone)""")
def report_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five pages of reports (customers) of each zone at most; some zones lack a page, some have short ones."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("zone"), (F.col("o_orderkey") % 8 + 1).alias("page"), F.col("o_custkey").alias("code"))
    o = o.where("NOT (zone % 7 = 3 AND page = 3)")
    limits = o.groupBy("zone").agg(F.when(F.col("zone") % 3 == 0, F.lit(1)).otherwise(F.floor(F.count(F.lit(1)) / 9)).alias("limit"))
    pages = o.groupBy("zone", "page").agg(F.collect_list("code").alias("found"))
    codes, ends = paged.searched(pages.join(limits, "zone"), "zone", "limit", 5)
    counted = codes.groupBy("zone").agg(F.count(F.lit(1)).alias("codes"))
    return ends.join(counted, "zone", "left").select("zone", "pages", "truncated", F.coalesce("codes", F.lit(0)).alias("codes"))


@query("""WITH c AS (SELECT event_type AS endpoint, event_id % 3 = 0 AS cached, CASE WHEN event_id % 5 <> 0 THEN event_id * 0.25 END AS reading, ts, event_id FROM events),
s AS (SELECT ROUND(ARG_MAX(reading, (ts, event_id)) - ARG_MIN(reading, (ts, event_id)), 4) AS spent, COUNT(*) FILTER (WHERE NOT cached) AS all_requests FROM c WHERE reading IS NOT NULL),
a AS (SELECT COUNT(*) FILTER (WHERE NOT cached) AS n FROM c)
SELECT CASE WHEN endpoint IN ('click', 'view', 'purchase') THEN endpoint ELSE 'other' END AS endpoint, COUNT(*) FILTER (WHERE NOT cached) AS requests, COUNT(*) FILTER (WHERE cached) AS cache_hits,
  CAST(ANY_VALUE(spent) AS DOUBLE) AS spent, ROUND(ANY_VALUE(n) / 36000.0, 4) AS share FROM c, s, a GROUP BY 1""")
def spend_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of a metered service, counted while they are written."""
    calls = table(spark, sf_dir, "events").select(
        "ts", "event_id", F.col("event_type").alias("endpoint"), (F.col("event_id") % 3 == 0).alias("cached"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") * 0.25).cast("double").alias("reading")
    )
    ledger = RunLedger(["click", "view", "purchase"], 36_000)
    ledger.observed(calls, F.col("endpoint"), F.col("cached"), F.col("reading"), F.struct("ts", "event_id")).write.parquet(scratch_path(spark, "calls"))
    rows = [(*entry, ledger.spent(), ledger.share()) for entry in ledger.entries()]
    return spark.createDataFrame(rows, "endpoint string, requests long, cache_hits long, spent double, share double")
