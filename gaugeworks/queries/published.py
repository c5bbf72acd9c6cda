"""Queries of published documents: kills, labels, drawable windows, gear sweeps, talents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions import labels as L
from gaugeworks.functions import stats as S
from gaugeworks.operators import cells as C
from gaugeworks.operators import documents as D
from gaugeworks.operators import gear as G
from gaugeworks.operators import intervals as I
from gaugeworks.operators import kills as Q
from gaugeworks.operators import shapes as H
from gaugeworks.operators import talents as T
from gaugeworks.queries import fights, sweeps
from gaugeworks.queries.registry import query
from gaugeworks.session import checkpointed, dealt, table

_KILLS = """k0 AS (SELECT o_custkey % 50 AS report, o_orderkey AS fight, CAST(LEFT(o_orderpriority, 1) AS INT) AS encounter, o_orderstatus = 'F' AS killed, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS INT) END AS difficulty,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(epoch_us(o_orderdate) // 1000 AS BIGINT) END AS at_ FROM orders),
kills AS (SELECT encounter, report, fight, difficulty, at_ FROM k0 WHERE killed AND (difficulty IS NULL OR difficulty = 2) AND at_ >= 946684800000)"""


def _kills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders are kills, the customer's number by 50 the report; a fifth has no difficulty, an eleventh no time."""
    ms = F.floor(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate)") / 1000).cast("long")
    start = F.when(F.col("o_orderkey") % 11 != 0, ms)
    rows = table(spark, sf_dir, "orders").select(
        F.substr("o_orderpriority", F.lit(1), F.lit(1)).cast("int").alias("encounter"), (F.col("o_custkey") % 50).alias("code"), F.col("o_orderkey").alias("fight"),
        (F.col("o_orderstatus") == "F").alias("killed"), F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 4).cast("int")).alias("difficulty"), Q.kill_time(F.lit(0), start).alias("at"),
    )
    return rows.where(Q.is_kill(F.col("encounter"), F.col("encounter"), F.col("killed"), F.col("difficulty"), F.lit(2), F.col("at")))


@query(f"WITH {_KILLS} SELECT encounter, difficulty, COUNT(*) AS n FROM kills GROUP BY 1, 2")
def kill_difficulties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.difficulties(_kills(spark, sf_dir), ["encounter"])


@query(f"""WITH {_KILLS}, one AS (SELECT * FROM kills QUALIFY ROW_NUMBER() OVER (PARTITION BY encounter, report ORDER BY at_, fight) = 1)
SELECT encounter, report AS code, at_ AS "at", fight FROM one QUALIFY ROW_NUMBER() OVER (PARTITION BY encounter ORDER BY at_, report) <= 10""")
def earliest_kills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.earliest_kills(_kills(spark, sf_dir), 10, ("encounter",))


@query(f"""WITH {_KILLS} SELECT encounter, MIN(at_) AS first, MAX(at_) AS last, ROUND((MAX(at_) - MIN(at_)) / 86400000.0, 1) AS days FROM kills GROUP BY encounter""")
def kill_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.kill_span(_kills(spark, sf_dir), ["encounter"])


@query(f"""WITH {sweeps.CELLS}, c AS (SELECT build, scenario, targets, priority / dps * targets AS v FROM cells WHERE targets > 1)
SELECT scenario, targets, CASE WHEN v IS NULL THEN NULL WHEN v <= 1.08 THEN 'Spread evenly' WHEN v >= 0.92 * targets THEN 'Almost all on main target' WHEN v >= 0.6 * targets THEN 'Very concentrated' WHEN v >= 1.6 THEN 'Concentrated' ELSE 'Slightly favours main target' END AS label, COUNT(*) AS n FROM c GROUP BY ALL""")
def concentration_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sweeps.sweep(spark, sf_dir).where("targets > 1")
    return rows.groupBy("scenario", "targets", L.concentration_label(C.concentration(), F.col("targets")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, 'trinket1=,id=' || p_partkey || CASE WHEN p_size % 3 > 0 THEN ',bonus_id=' || ARRAY_TO_STRING(LIST_TRANSFORM(range(1, p_size % 3 + 1), lambda x: CAST(x * 10 AS VARCHAR)), '/') ELSE '' END || CASE WHEN p_size % 2 = 0 THEN ',ilevel=' || p_size ELSE '' END || ',enchant_id=7' AS option FROM part""")
def item_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    bonuses = F.transform(F.filter(F.array(F.lit(1), F.lit(2)), lambda x: x <= F.col("p_size") % 3), lambda x: x * 10)
    level = F.when(F.col("p_size") % 2 == 0, F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", L.item_option(F.lit("trinket1"), F.col("p_partkey"), bonuses, level, F.array().cast("array<int>"), F.lit(7)).alias("option"))


@query("""SELECT p_partkey, CASE WHEN p_size * 10 >= 20 THEN CAST(FLOOR((p_size * 10 - 20) / 120.0) AS BIGINT) + 1 ELSE 1 END AS casts, CASE WHEN p_size * 10 >= 20 THEN FLOOR((p_size * 10 - 20) / 120.0) * 120.0 ELSE 0.0 END AS last FROM part""")
def cast_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = L.cast_times(F.col("p_size") * 10.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(times).cast("long").alias("casts"), F.element_at(times, -1).alias("last"))


@query(f"""WITH {fights.AURAS}, pooled AS (SELECT ability FROM auras GROUP BY ability HAVING COUNT(DISTINCT fight) >= 2),
m AS (SELECT *, MAX(end_) OVER (PARTITION BY fight, ability ORDER BY start_, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM auras WHERE ability IN (SELECT ability FROM pooled)),
i AS (SELECT *, SUM(CASE WHEN reach IS NULL OR start_ > reach THEN 1 ELSE 0 END) OVER (PARTITION BY fight, ability ORDER BY start_, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM m),
b AS (SELECT fight, ability, MIN(start_) AS s, MAX(end_) AS e, COUNT(*) AS windows, BOOL_OR(truncated) AS truncated FROM i GROUP BY fight, ability, k),
len AS (SELECT fight, MAX(duration) AS d FROM ev GROUP BY fight)
SELECT fight, ability, s AS "start", e AS "end", windows, truncated, GREATEST(COUNT(*) OVER (PARTITION BY fight, ability) - 3, 0) AS hidden, COALESCE((e - s) / NULLIF(d, 0) >= 0.66, FALSE) AS permanent FROM b JOIN len USING (fight) QUALIFY ROW_NUMBER() OVER (PARTITION BY fight, ability ORDER BY s) <= 3""")
def drawable_auras(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = fights._auras(spark, sf_dir)
    pooled = windows.groupBy("ability").agg(F.countDistinct("fight").alias("n")).where("n >= 2")
    length = fights.events(spark, sf_dir).groupBy("fight").agg(F.max("t").alias("duration"))
    return D.drawable(windows.join(length, "fight"), pooled)


@query(f"""WITH RECURSIVE {fights.CLUSTERS}, both_ AS (SELECT fight_a AS fight, fight_b AS other, distance FROM dist UNION ALL SELECT fight_b, fight_a, distance FROM dist),
s AS (SELECT c.encounter, c.cluster, c.fight, ROUND(COALESCE(SUM(b.distance), 0), 6) AS total FROM clusters c LEFT JOIN (both_ b JOIN clusters o ON o.fight = b.other) ON b.fight = c.fight AND o.cluster = c.cluster GROUP BY ALL),
md AS (SELECT encounter, cluster, ARG_MIN(fight, (total, fight)) AS medoid, COUNT(*) AS size FROM s GROUP BY encounter, cluster),
x AS (SELECT *, MAX(n) OVER (PARTITION BY fight) AS peak, COALESCE(LAG(n) OVER (PARTITION BY fight ORDER BY t), -1) AS before FROM steps),
p AS (SELECT fight, MAX(peak) AS peak, COUNT(*) FILTER (WHERE n >= peak AND before < peak) AS visits FROM x GROUP BY fight),
sp AS (SELECT fight, n, window_, GREATEST(COALESCE(LEAD(t) OVER (PARTITION BY fight ORDER BY t), window_) - t, 0) AS span, MAX(n) OVER (PARTITION BY fight) AS peak FROM steps JOIN win USING (fight)),
o AS (SELECT fight, CASE WHEN MAX(window_) > 0 THEN ROUND(SUM(n * span) / MAX(window_), 4) END AS mean, COALESCE(ROUND(SUM(CASE WHEN n = peak THEN span ELSE 0 END) / NULLIF(MAX(window_), 0), 4) >= 0.95, FALSE) AS constant FROM sp GROUP BY fight),
pm AS (SELECT s.encounter, s.fight, CAST(SUM(n) AS DOUBLE) / COUNT(*) AS mean, MAX(window_) AS length FROM samples s JOIN win w ON w.fight = s.fight GROUP BY s.encounter, s.fight),
mm AS (SELECT encounter, MEDIAN(mean) AS mm, MEDIAN(length) AS ml FROM pm GROUP BY encounter),
rep AS (SELECT encounter, ARG_MIN(fight, (ROUND(ABS(mean - mm), 6), ROUND(ABS(length - ml), 6), fight)) AS chosen FROM pm JOIN mm USING (encounter) GROUP BY encounter),
z AS (SELECT md.*, SUM(size) OVER (PARTITION BY encounter) AS whole, SUM(CASE WHEN size >= 2 THEN size ELSE 0 END) OVER (PARTITION BY encounter) AS matched FROM md)
SELECT z.encounter, medoid AS pattern, size AS pulls, ROUND(size / whole, 4) AS share,
  CASE WHEN constant AND peak = 1 THEN '1 target throughout' WHEN constant THEN peak || ' targets throughout'
       ELSE 'peaks at ' || peak || ' ' || CASE visits WHEN 1 THEN 'once' WHEN 2 THEN 'twice' ELSE visits || ' times' END || ', mean ' || CAST(ROUND(CAST(mean AS DECIMAL(18,4)), 1) AS VARCHAR) END AS label,
  CAST(whole - GREATEST(matched, 1) AS BIGINT) AS unmatched
FROM z JOIN p ON p.fight = medoid JOIN o ON o.fight = medoid JOIN rep ON rep.encounter = z.encounter WHERE size >= 2 OR (matched = 0 AND medoid = chosen)""")
def shape_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lives = checkpointed(fights.fight_lives(spark, sf_dir))
    shapes = fights._shapes(spark, sf_dir, lives)
    found = H.medoids(shapes, H.clusters(shapes, "encounter", "fight"), "encounter", "fight")
    steps, until = I.concurrency(lives), fights.windows_of(lives)
    stats = I.concurrency_stats(steps, until.drop("encounter")).select("fight", "mean", "constant")
    chosen = fights._representative(shapes).select("fight", F.lit(True).alias("representative"))
    facts = I.peak_visits(steps).join(until.select("fight", "encounter"), "fight").join(stats, "fight").join(chosen, "fight", "left")
    facts = facts.withColumn("representative", F.coalesce("representative", F.lit(False)))
    return D.patterns(found, facts)


@query(f"""WITH {fights.STEPS}, au AS (SELECT fight, COUNT(*) FILTER (WHERE event_type = 'signup') AS cut FROM ev GROUP BY fight), d AS (SELECT fight, MAX(duration) AS d FROM ev GROUP BY fight),
c AS (SELECT w.encounter, MIN(CASE WHEN d > 0 THEN ROUND(LEAST(window_ / d, 1), 4) END) AS cov, SUM(cut) AS cut, COUNT(*) AS n FROM win w JOIN au USING (fight) JOIN d USING (fight) GROUP BY w.encounter),
v AS (SELECT encounter, CASE WHEN encounter % 11 = 0 THEN NULL WHEN encounter % 3 = 0 THEN 0.97 ELSE cov END AS cov, cut, CASE WHEN encounter % 4 = 0 THEN n % 4 ELSE n END AS n, CASE WHEN encounter % 2 = 0 THEN 'top' ELSE 'kill' END AS ord FROM c)
SELECT encounter, array_to_string(list_filter([CASE WHEN cov IS NULL THEN 'coverage unknown' WHEN cov < 0.95 THEN 'read to ' || CAST(ROUND(CAST(cov * 100 AS DECIMAL(9,2)), 0) AS INT) || '% of the fight' END, CASE WHEN cut > 0 THEN cut || ' windows cut by the start or end' END,
  CASE WHEN n < 3 THEN 'only ' || n || ' pulls' END, CASE WHEN ord = 'top' THEN 'ranked pulls only' END], lambda t: t IS NOT NULL), '; ') AS caveats FROM v""")
def coverage_caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All caveats of every encounter; some have no coverage, a whole one, few pulls, or another order."""
    ev = fights.events(spark, sf_dir)
    marks = ev.groupBy("fight").agg(F.count_if(F.col("event_type") == "signup").alias("cut"), F.max("t").alias("duration"))
    pulls = fights.windows_of(fights.fight_lives(spark, sf_dir)).join(marks, "fight")
    pooled = pulls.groupBy("encounter").agg(F.min(D.coverage_of(F.col("window"), F.col("duration"))).alias("cov"), F.sum("cut").alias("cut"), F.count(F.lit(1)).alias("n"))
    e = F.col("encounter")
    coverage = F.when(e % 11 == 0, F.lit(None).cast("double")).when(e % 3 == 0, 0.97).otherwise(F.col("cov"))
    texts = D.caveats(coverage, F.col("cut"), F.when(e % 4 == 0, F.col("n") % 4).otherwise(F.col("n")), F.when(e % 2 == 0, "top").otherwise("kill"))
    return pooled.select("encounter", F.array_join(texts, "; ").alias("caveats"))


_TARGETS = """string_agg('{"t":' || CAST(ROUND(t * 1000) AS BIGINT) || ',"n":' || n || '}', ',' ORDER BY CAST(ROUND(t * 1000) AS BIGINT), n)"""


@query(f"""WITH {fights.STEPS}, sg AS (SELECT fight, actor FROM (SELECT fight, actor, SUM(total) AS s, SUM(SUM(total)) OVER (PARTITION BY fight) AS w FROM lives GROUP BY fight, actor) WHERE CASE WHEN w > 0 THEN CAST(s AS DOUBLE) / CAST(w AS DOUBLE) ELSE 1 END >= 0.2),
mv AS (SELECT fight, t, SUM(d) AS d FROM (SELECT fight, first AS t, 1 AS d FROM lives SEMI JOIN sg USING (fight, actor) UNION ALL SELECT fight, last, -1 FROM lives SEMI JOIN sg USING (fight, actor)) GROUP BY ALL),
rn AS (SELECT fight, t, CAST(SUM(d) OVER (PARTITION BY fight ORDER BY t) AS BIGINT) AS n FROM mv),
ss AS (SELECT fight, t, n FROM (SELECT *, LAG(n) OVER (PARTITION BY fight ORDER BY t) AS b FROM rn) WHERE b IS NULL OR b <> n UNION ALL SELECT fight, 0.0, 0 FROM rn GROUP BY fight HAVING MIN(t) > 0),
{fights.AURAS[len(fights.EV) + 2:]},
du AS (SELECT fight, MAX(duration) AS d FROM lives GROUP BY fight),
dm AS (SELECT fight, actor, SUM(total) AS total FROM lives SEMI JOIN sg USING (fight, actor) GROUP BY fight, actor),
rk AS (SELECT *, ROW_NUMBER() OVER w AS k, LEAD(total) OVER w AS nxt, COUNT(*) OVER (PARTITION BY fight) AS c FROM dm WINDOW w AS (PARTITION BY fight ORDER BY total DESC, actor)),
pr AS (SELECT fight, actor, CASE WHEN c = 1 THEN 'only' WHEN total > 0 AND (nxt <= 0 OR CAST(total AS DOUBLE) >= 1.25 * CAST(nxt AS DOUBLE)) THEN 'margin' ELSE 'none' END AS reason FROM rk WHERE k = 1),
a1 AS (SELECT fight, {_TARGETS} AS x FROM steps GROUP BY fight), a2 AS (SELECT fight, {_TARGETS} AS x FROM ss GROUP BY fight),
a3 AS (SELECT fight, string_agg('{{"start":' || CAST(ROUND(start_ * 1000) AS BIGINT) || ',"ability":' || ability || ',"end":' || CAST(ROUND(end_ * 1000) AS BIGINT) || CASE WHEN truncated THEN ',"truncated":true' ELSE '' END || '}}', ',' ORDER BY CAST(ROUND(start_ * 1000) AS BIGINT), ability, CAST(ROUND(end_ * 1000) AS BIGINT), truncated) AS x FROM auras GROUP BY fight),
pu AS (SELECT w.encounter, w.fight, window_, d, CASE WHEN d > 0 THEN ROUND(LEAST(window_ / d, 1), 4) END AS cov, a1.x AS x1, a2.x AS x2, a3.x AS x3, CASE WHEN reason <> 'none' THEN actor END AS priority, reason FROM win w JOIN du USING (fight) JOIN pr USING (fight) LEFT JOIN a1 USING (fight) LEFT JOIN a2 USING (fight) LEFT JOIN a3 USING (fight)),
tx AS (SELECT *, array_to_string(list_filter([CASE WHEN cov IS NULL THEN '"coverage unknown"' WHEN cov < 0.95 THEN '"read to ' || CAST(ROUND(CAST(cov * 100 AS DECIMAL(9,2)), 0) AS INT) || '% of the fight"' END, CASE WHEN x3 IS NULL THEN '"no auras"' END, CASE WHEN priority IS NULL THEN '"no priority target"' END], lambda t: t IS NOT NULL), ',') AS notes FROM pu)
SELECT encounter, '{{"encounter":' || encounter || ',"coverage":{{"pulls":' || COUNT(*) || ',"complete":' || COUNT(*) FILTER (WHERE cov >= 0.95) || '}},"pulls":[' || string_agg('{{"fight":' || fight || ',"window":' || CAST(ROUND(window_ * 1000) AS BIGINT) || ',"duration":' || CAST(ROUND(d * 1000) AS BIGINT)
  || COALESCE(',"targets":[' || x1 || ']', '') || COALESCE(',"significantTargets":[' || x2 || ']', '') || COALESCE(',"priority":' || priority, '') || ',"reason":"' || reason || '"' || COALESCE(',"auras":[' || x3 || ']', '') || CASE WHEN notes <> '' THEN ',"warnings":[' || notes || ']' ELSE '' END || '}}', ',' ORDER BY fight) || ']}}' AS document
FROM tx GROUP BY encounter""")
def fight_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each encounter, its pulls inside; enemies of a fifth of the damage count as significant."""
    lives = fights.fight_lives(spark, sf_dir)
    damage = lives.groupBy("fight", "actor").agg(F.sum("total").alias("total"))
    grave = I.significant(damage, "fight", "total", 0.2).select("fight", "actor", F.col("total").cast("double").alias("total"))
    priority = I.nominated(grave, "fight", "actor", "total").withColumnRenamed("actor", "priority")
    length = lives.groupBy("fight").agg(F.max("duration").alias("duration"))
    pulls = fights.windows_of(lives).join(length, "fight").join(priority, "fight")
    few = lives.join(grave.select("fight", "actor"), ["fight", "actor"], "left_semi")
    return D.fight_documents(pulls, I.concurrency(lives), I.concurrency(few), fights._auras(spark, sf_dir))


_VARIANTS = f"""{sweeps.CELLS}, var AS (SELECT build, scenario, CASE WHEN targets = 1 THEN 'empty' ELSE 'v' || targets END AS variant, dps, err, priority FROM cells)"""


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of a sweep as variants: one target is the empty one."""
    name = F.when(F.col("targets") == 1, "empty").otherwise(F.concat(F.lit("v"), F.col("targets")))
    return sweeps.sweep(spark, sf_dir).select("build", "scenario", name.alias("variant"), "dps", F.col("err").alias("error"), "priority")


_SOLO = f"""{_VARIANTS}, solo AS (SELECT v.build, v.scenario, v.variant, v.dps - b.dps AS gain, SQRT(POWER(v.dps * v.err / 100, 2) + POWER(b.dps * b.err / 100, 2)) AS gain_error FROM var v JOIN var b ON b.build = v.build AND b.scenario = v.scenario AND b.variant = 'empty' WHERE v.variant <> 'empty')"""


@query(f"WITH {_SOLO} SELECT build, scenario, variant, ROUND(gain, 2) AS gain, ROUND(gain_error, 4) AS gain_error FROM solo")
def solo_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.solo_gains(_variants(spark, sf_dir), ["build", "scenario"]).withColumn("gain", F.round("gain", 2)).withColumn("gain_error", F.round("gain_error", 4))


@query(f"""WITH {_SOLO}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY build, scenario ORDER BY gain DESC, variant) AS k FROM solo),
weak AS (SELECT build, scenario, ARG_MIN(variant, (gain, k)) AS worn, MIN(gain) AS g, ARG_MIN(gain_error, (gain, k)) AS e FROM r WHERE k <= 2 GROUP BY build, scenario)
SELECT r.build, r.scenario, r.variant AS item, worn AS replaced, ROUND(gain - g, 2) AS gain, ABS(gain - g) <= SQRT(gain_error * gain_error + e * e) AS tie FROM r JOIN weak USING (build, scenario) WHERE k > 2""")
def gear_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best variants are worn; every other is held against the weaker of them."""
    keys = ["build", "scenario"]
    solo = G.solo_gains(_variants(spark, sf_dir), keys)
    ranked = solo.withColumn("socket", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("gain"), "variant")))
    worn = ranked.where("socket <= 2").withColumnRenamed("variant", "worn")
    return G.candidates(solo.withColumnRenamed("variant", "item"), worn, keys).select(*keys, "item", "replaced", F.round("gain", 2).alias("gain"), "tie")


@query(f"""WITH {sweeps._POOL}, o AS (SELECT *, LEAD(total) OVER (PARTITION BY brand ORDER BY total DESC, item_a || '/' || item_b) AS nxt, ROW_NUMBER() OVER (PARTITION BY brand ORDER BY total DESC, item_a || '/' || item_b) AS k FROM pairs)
SELECT brand, item_a, item_b, CAST(total AS DOUBLE) AS dps, ROUND(CAST(total AS DOUBLE) - CAST(nxt AS DOUBLE), 2) AS gap, COALESCE(ABS(CAST(total AS DOUBLE) - CAST(nxt AS DOUBLE)) <= SQRT(POWER(CAST(total AS DOUBLE) * 0.05 / 100, 2) + POWER(CAST(nxt AS DOUBLE) * 0.05 / 100, 2)), FALSE) AS tie FROM o WHERE k = 1""")
def best_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = sweeps._leading_pairs(spark, sf_dir).select("brand", F.array("item_a", "item_b").alias("items"), F.col("total").cast("double").alias("dps"), F.lit(0.05).alias("error"))
    best = G.best_sets(sets, ["brand"])
    return best.select("brand", F.get("items", 0).alias("item_a"), F.get("items", 1).alias("item_b"), "dps", F.round("gap", 2).alias("gap"), "tie")


@query(f"""WITH {sweeps._POOL}, e AS (SELECT brand, item_a AS item, total, item_a || '/' || item_b AS key_ FROM pairs UNION ALL SELECT brand, item_b, total, item_a || '/' || item_b FROM pairs)
SELECT brand, item, CAST(MAX(total) AS DOUBLE) AS dps, ARG_MAX(key_, (total, key_)) AS items FROM e GROUP BY brand, item""")
def best_with_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = sweeps._pairs_of_items(spark, sf_dir).select("brand", F.array("item_a", "item_b").alias("items"), F.col("total").alias("dps"))
    return G.best_with(sets, ["brand"]).select("brand", "item", F.col("dps").cast("double"), F.array_join(F.col("items").cast("array<string>"), "/").alias("items"))


@query(f"""WITH {_VARIANTS}, t AS (SELECT build, scenario, COUNT(*) AS n, ARG_MAX(variant, (dps, variant)) AS best, ARG_MAX(variant, (priority, variant)) FILTER (WHERE priority IS NOT NULL) AS best_priority FROM var GROUP BY build, scenario HAVING COUNT(*) >= 2)
SELECT *, COALESCE(best <> best_priority, FALSE) AS disagree FROM t""")
def talent_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.two_winners(_variants(spark, sf_dir), ["build", "scenario"])


@query(f"""WITH {sweeps._WON}, x AS (SELECT winner, COUNT(*) AS n, MIN((scenario, targets)) AS f FROM won GROUP BY winner)
SELECT ROUND(MEDIAN(noise), 4) AS noise, COUNT(*) FILTER (WHERE NOT COALESCE(margin > noise, FALSE)) AS ties, (SELECT ARG_MIN(winner, (-n, f)) FROM x) AS contested FROM won""")
def contested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.contest(sweeps._won(spark, sf_dir), ["scenario", "targets"], "contested").withColumn("noise", F.round("noise", 4))


_TREE_PICKS = """picks AS (SELECT p_partkey AS id, n AS node, 1 + (p_partkey + n) % 3 AS rank, 1 + n % 3 AS tree FROM part, range(1, 31) r(n) WHERE (p_partkey * 7 + n * n) % 4 = 0)"""


def _picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections of 30 nodes, of which each part takes some; node n is in tree 1 + n % 3, every fifth of two specs."""
    node = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(30).cast("long"))).alias("node")
    parts = dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("spec")), "id")
    picks = parts.select("id", "spec", node).where((F.col("id") * 7 + F.col("node") * F.col("node")) % 4 == 0).withColumn("rank", 1 + (F.col("id") + F.col("node")) % 3).withColumn("entry", F.lit(0))
    specs = F.when(F.col("node") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return picks.withColumn("specs", specs).withColumn("tree", 1 + F.col("node") % 3).withColumn("sub_tree", F.lit(0))


@query(f"""WITH {_TREE_PICKS} SELECT id, CAST(COALESCE(SUM(rank) FILTER (WHERE tree = 1), 0) AS BIGINT) AS class_points, CAST(COALESCE(SUM(rank) FILTER (WHERE tree = 2), 0) AS BIGINT) AS spec_points, CAST(COALESCE(SUM(rank) FILTER (WHERE tree = 3), 0) AS BIGINT) AS hero_points,
  COALESCE(SUM(rank) FILTER (WHERE tree = 1), 0) < 20 AS thin FROM picks GROUP BY id""")
def talent_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.points(_picks(spark, sf_dir), ["id"])


@query(f"""WITH {_TREE_PICKS} SELECT id, MIN(node) AS node, 0 AS entry FROM picks JOIN part ON p_partkey = id WHERE tree <> 3 AND node % 5 = 0 AND p_size NOT IN (1, 2) GROUP BY id""")
def talent_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.violations(_picks(spark, sf_dir), ["id"])


@query("""WITH x AS (SELECT o_custkey AS build, CASE WHEN o_custkey % 3 = 0 THEN 7.25 WHEN o_custkey % 4 = 0 THEN NULL ELSE o_orderkey % 100 / 4 END AS v FROM orders),
s AS (SELECT build, MEDIAN(v) AS m, MIN(v) AS lo, MAX(v) AS hi, COUNT(v) AS n FROM x GROUP BY build)
SELECT build, n, CASE WHEN n = 0 THEN 'not measured' ELSE ROUND(CAST(m AS DECIMAL(18,3)), 1) || 's' || CASE WHEN lo = hi THEN ' (n=' || n || ')' ELSE ' (' || ROUND(CAST(lo AS DECIMAL(18,3)), 1) || '-' || ROUND(CAST(hi AS DECIMAL(18,3)), 1) || ', n=' || n || ')' END END AS text FROM s""")
def spread_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spreads of each customer's orders as text: of one value, of several and of none."""
    key = F.col("o_custkey")
    value = F.when(key % 3 == 0, 7.25).when(key % 4 == 0, F.lit(None).cast("double")).otherwise(F.col("o_orderkey") % 100 / 4)
    rows = table(spark, sf_dir, "orders").select(key.alias("build"), value.alias("v")).groupBy("build").agg(S.spread("v").alias("s"))
    return rows.select("build", F.coalesce("s.n", F.lit(0)).alias("n"), L.spread_text(F.col("s"), "s").alias("text"))
