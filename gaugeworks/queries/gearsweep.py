"""The gear sweep over parts: a group is a brand, a half or a sixth of it, and sweeps one and three targets.

Parts up to size 25 are farmed, larger ones drop at two levels. A set's value is made from its parts' prices; a few
variants have no result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.sweeps import gear_sweep as sweep
from gaugeworks.operators.sweeps import wide
from gaugeworks.queries.registry import query
from gaugeworks.session import checkpointed, table

_SWEEP = """gp AS (SELECT p_partkey AS item, p_size AS size, CAST(p_retailprice * 100 AS BIGINT) AS cents, CAST(SPLIT_PART(p_brand, '#', 2) AS INT) AS b,
  CASE CAST(SPLIT_PART(p_brand, '#', 2) AS INT) % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || '/' || p_partkey % 2 ELSE p_brand || '/' || p_partkey % 6 END AS grp FROM part),
tg AS (SELECT unnest([1, 3]) AS targets), lv AS (SELECT unnest([334, 344]) AS level),
fa AS (SELECT * FROM gp WHERE size <= 25), dr AS (SELECT gp.*, level FROM gp, lv WHERE size > 25 AND grp IN (SELECT grp FROM fa)),
ct AS (SELECT grp, COUNT(*) AS f, COUNT(*) * (COUNT(*) - 1) // 2 AS fp FROM fa GROUP BY grp), cd AS (SELECT grp, COUNT(*) AS c FROM dr WHERE level = 334 GROUP BY grp),
pl AS (SELECT grp, f, fp, CASE WHEN fp + 2 * (f * COALESCE(c, 0) + COALESCE(c, 0) * (COALESCE(c, 0) - 1) // 2) <= 120 THEN 'full' WHEN fp <= 120 THEN 'baseline' ELSE 'additive' END AS method FROM ct LEFT JOIN cd USING (grp)),
ky AS (SELECT pl.*, targets FROM pl, tg),
so AS (SELECT grp, targets, f, method, item, size, cents, (100000 + cents // targets) AS dps FROM ky JOIN fa USING (grp) WHERE f >= 2 AND (item * 3 + targets + 1) % 23 <> 0),
em AS (SELECT grp, targets FROM ky WHERE f >= 2 AND NOT (grp = 'Brand#21' AND targets = 3)),
sg AS (SELECT so.*, so.dps - 100000 AS gain FROM so JOIN em USING (grp, targets)),
pr AS (SELECT ky.grp, targets, method, NULL AS level, x.item AS ia, y.item AS ib, x.cents AS ca, y.cents AS cb, x.size AS sa, y.size AS sb, 0 AS extra, false AS has_drop FROM ky JOIN fa x ON x.grp = ky.grp JOIN fa y ON y.grp = ky.grp AND x.item < y.item WHERE f >= 2 AND method <> 'additive'
  UNION ALL SELECT ky.grp, targets, method, y.level, x.item, y.item, x.cents, y.cents, x.size, y.size, (y.level - 330) * 10, true FROM ky JOIN fa x ON x.grp = ky.grp JOIN dr y ON y.grp = ky.grp WHERE f >= 2 AND method = 'full'
  UNION ALL SELECT ky.grp, targets, method, y.level, x.item, y.item, x.cents, y.cents, x.size, y.size, (y.level - 330) * 10, true FROM ky JOIN dr x ON x.grp = ky.grp JOIN dr y ON y.grp = ky.grp AND x.level = y.level AND x.item < y.item WHERE f >= 2 AND method = 'full'),
me AS (SELECT *, 100000 + ca // targets + cb // targets + 500 * ABS(sa - sb) + extra AS dps FROM pr WHERE ((ia + ib) * 3 + targets + 2) % 23 <> 0),
be AS (SELECT grp, targets, ARG_MIN(ia, (-dps, ia, ib)) AS x, ARG_MIN(ib, (-dps, ia, ib)) AS y, MAX(dps) AS best_dps FROM me WHERE level IS NULL GROUP BY grp, targets),
al AS (SELECT grp, targets, COUNT(*) AS returned, MAX(CASE WHEN k = 1 THEN item END) AS x, MAX(CASE WHEN k = 2 THEN item END) AS y FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY grp, targets ORDER BY gain DESC, item) AS k FROM sg) GROUP BY grp, targets),
ft AS (SELECT ky.grp, ky.targets, method, fp, best_dps, COALESCE(be.x, al.x) AS x, COALESCE(be.y, al.y) AS y,
  CASE WHEN f < 2 THEN 'only ' || f || ' eligible items; need 2 to form a baseline' WHEN em.grp IS NULL THEN 'no result for the empty reference' WHEN COALESCE(returned, 0) < 2 THEN 'only ' || COALESCE(returned, 0) || ' of ' || f || ' pool items returned a result' END AS reason
  FROM ky LEFT JOIN em USING (grp, targets) LEFT JOIN be USING (grp, targets) LEFT JOIN al USING (grp, targets)),
wk AS (SELECT ft.grp, ft.targets, ft.x, ft.y, best_dps, CASE WHEN COALESCE(gx.gain, 0) <= COALESCE(gy.gain, 0) THEN ft.x ELSE ft.y END AS weak, CASE WHEN COALESCE(gx.gain, 0) <= COALESCE(gy.gain, 0) THEN ft.y ELSE ft.x END AS stays
  FROM ft LEFT JOIN sg gx ON gx.grp = ft.grp AND gx.targets = ft.targets AND gx.item = ft.x LEFT JOIN sg gy ON gy.grp = ft.grp AND gy.targets = ft.targets AND gy.item = ft.y WHERE reason IS NULL),
sd AS (SELECT wk.*, 100050 + p.cents // targets + q.cents // targets + 500 * ABS(p.size - q.size) AS std FROM wk JOIN gp p ON p.item = x JOIN gp q ON q.item = y WHERE ((x + y) * 3 + targets + 2) % 23 <> 1),
cn AS (SELECT sd.grp, sd.targets, d.item, d.level, 100050 + d.cents // targets + q.cents // targets + 500 * ABS(d.size - q.size) + (d.level - 330) * 10 AS dps, std FROM sd JOIN dr d ON d.grp = sd.grp JOIN gp q ON q.item = stays WHERE ((d.item + stays) * 3 + targets + 2) % 23 <> 1),
ch AS (SELECT grp, targets, COUNT(*) AS candidates, ARG_MIN(item || '@' || level, (-dps, item, level)) AS best_candidate, MAX(CAST(dps AS DOUBLE) / std - 1) AS best_gain FROM cn GROUP BY grp, targets),
lc AS (SELECT me.* FROM me WHERE level IS NOT NULL UNION ALL SELECT me.* REPLACE (l.level AS level) FROM me JOIN (SELECT DISTINCT grp, level FROM dr) l ON l.grp = me.grp WHERE me.level IS NULL AND method = 'full'),
cl AS (SELECT grp, targets, level, ARG_MIN(ia || '+' || ib, (-dps, has_drop, ia, ib)) AS items, MAX(dps) AS dps FROM lc WHERE method = 'full' GROUP BY grp, targets, level)"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, key = F.substring_index("p_brand", "#", -1).cast("int"), F.col("p_partkey")
    part = lambda n: F.concat("p_brand", F.lit("/"), (key % n).cast("string"))
    grp = F.when(number % 3 == 0, F.col("p_brand")).when(number % 3 == 1, part(2)).otherwise(part(6))
    return table(spark, sf_dir, "part").select(grp.alias("grp"), key.alias("item"), F.col("p_size").alias("size"), F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))


def _sweep(spark: SparkSession, sf_dir: str):
    parts = checkpointed(_groups(spark, sf_dir).withColumn("targets", F.explode(F.array(F.lit(1), F.lit(3)))))
    keys = ["grp", "targets"]
    farmed = parts.where("size <= 25").select(*keys, "item", F.col("item").alias("place"))
    dropped = parts.where("size > 25").join(farmed.select("grp").distinct(), "grp", "left_semi")
    drops = dropped.withColumn("level", F.explode(F.array(F.lit(334), F.lit(344)))).select(*keys, "item", "level", (F.col("item") + (1 << 40)).alias("place"))

    def run(variants: DataFrame) -> DataFrame:
        """What a simulator would measure: prices, a bonus for unlike sizes, a bonus for a level; a few have no result."""
        facts = parts.select("targets", "grp", "item", F.struct("cents", "size").alias("fact"))
        each = variants.withColumn("item", F.explode_outer("items")).join(wide(facts), [*keys, "item"], "left")
        whole = each.groupBy(*keys, "round", "variant", "level").agg(
            F.coalesce(F.sum(F.floor(F.col("fact.cents") / F.col("targets"))), F.lit(0)).alias("value"), F.coalesce(F.sum("item"), F.lit(0)).alias("sum"), F.count("item").alias("n"),
            (F.max("fact.size") - F.min("fact.size")).alias("apart"),
        )
        bonus = F.when(F.col("n") == 2, 500 * F.col("apart")).otherwise(0) + F.coalesce((F.col("level") - 330) * 10, F.lit(0)) + F.when(F.col("round") == 2, 50).otherwise(0)
        lost = (F.col("sum") * 3 + F.col("targets") + F.col("n")) % 23 == F.col("round") - 1
        lost = F.when(F.col("n") == 0, (F.col("grp") == "Brand#21") & (F.col("targets") == 3)).otherwise(lost)
        return whole.where(~lost).select(*keys, "variant", (100000 + F.col("value") + bonus).alias("dps"), (F.lit(0.1) + F.col("n") / 50).alias("error"))

    return sweep(farmed, drops, keys, run)


@query(f"""WITH {_SWEEP}
SELECT ft.grp, CAST(ft.targets AS INT) AS targets, method, CASE WHEN method = 'additive' THEN 0 ELSE fp END AS combinations, CASE WHEN ft.reason IS NULL THEN ft.x || '+' || ft.y END AS items, wk.weak AS replaced, sd.std AS dps,
  ROUND(CAST(sd.std AS DOUBLE) / ft.best_dps - 1, 8) AS drift, COALESCE(candidates, 0) AS candidates, best_candidate, ROUND(best_gain, 8) AS best_gain, COALESCE(ft.reason, CASE WHEN sd.std IS NULL THEN 'no result for the baseline' END) AS reason
FROM ft LEFT JOIN wk USING (grp, targets) LEFT JOIN sd USING (grp, targets) LEFT JOIN ch USING (grp, targets)""")
def gear_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's baseline with its best candidate, or why it failed."""
    out = _sweep(spark, sf_dir)
    keys = ["grp", "targets"]
    named = F.concat(F.col("item").cast("string"), F.lit("@"), F.col("level").cast("string"))
    best = out.candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidates"), F.min_by(named, F.struct(-F.col("dps"), "item", "level")).alias("best_candidate"), F.max("gain").alias("best_gain"))
    return out.baseline.join(best, keys, "left").select(
        *keys, "method", F.col("combinations").cast("long").alias("combinations"), F.array_join(F.col("items").cast("array<string>"), "+").alias("items"), "replaced", "dps",
        F.round("drift", 8).alias("drift"), F.coalesce("candidates", F.lit(0)).alias("candidates"), "best_candidate", F.round("best_gain", 8).alias("best_gain"), "reason",
    )


@query(f"""WITH {_SWEEP} SELECT cl.grp, CAST(cl.targets AS INT) AS targets, level, items, dps, ROUND(CAST(dps AS DOUBLE) / ft.best_dps - 1, 8) AS gain, items = ft.x || '+' || ft.y AS is_baseline
FROM cl JOIN ft USING (grp, targets) WHERE ft.reason IS NULL AND ft.best_dps IS NOT NULL""")
def gear_ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What could be worn at each level, where all combinations were run."""
    out = _sweep(spark, sf_dir).ceilings
    return out.select("grp", "targets", "level", F.array_join(F.col("items").cast("array<string>"), "+").alias("items"), "dps", F.round("gain", 8).alias("gain"), "is_baseline")
