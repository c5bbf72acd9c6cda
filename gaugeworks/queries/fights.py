"""Queries over fights: a fight is a user's day of events, an encounter is a user.

Hits are clicks, views and purchases with the value as damage, deaths are errors, auras run from signup to
purchase. The actor is event_id % 5, the instance event_id % 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.operators import cells as C
from gaugeworks.operators import intervals as I
from gaugeworks.operators import shapes as H
from gaugeworks.queries.registry import query
from gaugeworks.session import checkpointed, dealt, scratch_path, table

#: Fixed value: samples of a fight.
SAMPLES = 60
EV = """e0 AS (SELECT *, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms FROM events),
ev AS (SELECT event_id, user_id AS encounter, user_id * 100000 + ms // 86400000 AS fight, ms, CAST(ms % 86400000 AS DOUBLE) / 1000 AS t, event_type,
  CAST(value AS DECIMAL(18,2)) AS amount, event_id % 5 AS actor, event_id % 3 AS instance, MAX(CAST(ms % 86400000 AS DOUBLE) / 1000) OVER (PARTITION BY user_id, ms // 86400000) AS duration FROM e0)"""
LIVES = f"""{EV}, hit AS (SELECT fight, encounter, actor, instance, MIN(t) AS f, MAX(t) AS l, SUM(amount) AS total, MAX(duration) AS duration FROM ev WHERE event_type IN ('click', 'view', 'purchase') GROUP BY ALL),
dead AS (SELECT fight, CASE WHEN event_id % 7 = 0 THEN event_id % 4 ELSE actor END AS actor, CASE WHEN event_id % 7 = 0 THEN event_id % 2 ELSE instance END AS instance, MIN(t) AS death FROM ev WHERE event_type = 'error' GROUP BY ALL),
lives AS (SELECT fight, encounter, actor, instance, f AS first, GREATEST(COALESCE(death, LEAST(l, duration)), f) AS last, death IS NOT NULL AS died, total, duration FROM hit LEFT JOIN dead USING (fight, actor, instance))"""
STEPS = f"""{LIVES}, moves AS (SELECT fight, t, SUM(d) AS d FROM (SELECT fight, first AS t, 1 AS d FROM lives UNION ALL SELECT fight, last, -1 FROM lives) GROUP BY ALL),
run AS (SELECT fight, t, CAST(SUM(d) OVER (PARTITION BY fight ORDER BY t) AS BIGINT) AS n FROM moves),
steps AS (SELECT fight, t, n FROM (SELECT *, LAG(n) OVER (PARTITION BY fight ORDER BY t) AS b FROM run) WHERE b IS NULL OR b <> n UNION ALL SELECT fight, 0.0, 0 FROM run GROUP BY fight HAVING MIN(t) > 0),
win AS (SELECT fight, encounter, MAX(LEAST(last, duration)) AS window_ FROM lives GROUP BY ALL)"""
GRID = f"""{STEPS}, grid AS (SELECT fight, encounter, b AS bucket, window_ * (b + 0.5) / {SAMPLES} AS t FROM win, range({SAMPLES}) r(b)),
samples AS (SELECT g.fight, g.encounter, g.bucket, COALESCE(s.n, 0) AS n FROM grid g ASOF LEFT JOIN steps s ON g.fight = s.fight AND g.t >= s.t),
dist AS (SELECT a.encounter, a.fight AS fight_a, b.fight AS fight_b, CAST(SUM(CASE WHEN ABS(a.n - b.n) >= 1 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS distance
  FROM samples a JOIN samples b ON a.encounter = b.encounter AND a.bucket = b.bucket AND a.fight < b.fight GROUP BY ALL)"""
CLUSTERS = f"""{GRID}, links AS (SELECT fight_a AS x, fight_b AS y FROM dist WHERE distance < 0.2 UNION ALL SELECT fight_b, fight_a FROM dist WHERE distance < 0.2),
walk AS (SELECT fight AS x, fight AS y FROM win UNION SELECT w.x, l.y FROM walk w JOIN links l ON w.y = l.x),
clusters AS (SELECT encounter, fight, c AS cluster FROM win JOIN (SELECT x AS fight, MIN(y) AS c FROM walk GROUP BY x) USING (fight))"""
AURAS = f"""{EV}, au AS (SELECT fight, event_id % 2 AS ability, event_id % 4 AS source, t, event_id, duration, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end' END AS kind FROM ev WHERE event_type IN ('signup', 'purchase')),
isl AS (SELECT *, COALESCE(SUM(CASE WHEN kind = 'end' THEN 1 ELSE 0 END) OVER (PARTITION BY fight, ability ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM au),
g AS (SELECT fight, ability, i, MIN(t) FILTER (WHERE kind = 'start') AS s, MAX(t) FILTER (WHERE kind = 'end') AS e, MAX(duration) AS d, COALESCE(ARG_MIN(source, (t, event_id)) FILTER (WHERE kind = 'start'), MAX(source) FILTER (WHERE kind = 'end')) AS opener FROM isl GROUP BY ALL),
auras AS (SELECT fight, ability, COALESCE(s, 0.0) AS start_, COALESCE(e, d) AS end_, s IS NULL OR e IS NULL AS truncated, opener FROM g)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    ev = table(spark, sf_dir, "events").withColumn("ms", F.floor(ms / 1000).cast("long"))
    ev = ev.select(
        "event_id", F.col("user_id").alias("encounter"), (F.col("user_id") * 100000 + F.floor(F.col("ms") / 86400000)).alias("fight"), "ms",
        ((F.col("ms") % 86400000).cast("double") / 1000).alias("t"), "event_type", F.col("value").cast("decimal(18,2)").alias("amount"),
        (F.col("event_id") % 5).alias("actor"), (F.col("event_id") % 3).alias("instance"), "props",
    )
    return ev.withColumn("duration", F.max("t").over(W.partitionBy("fight")))


def fight_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lives, with the fight's encounter and duration."""
    ev = events(spark, sf_dir)
    gone = F.col("event_id") % 7 == 0
    dead = ev.where("event_type = 'error'").select(
        "fight", "t", F.when(~gone, F.col("actor")).alias("actor"), "instance", (F.col("event_id") % 4).alias("source_actor"), (F.col("event_id") % 2).alias("source_instance")
    )
    found = I.lives(ev.where(F.col("event_type").isin("click", "view", "purchase")), dead)
    fights = ev.groupBy("fight").agg(F.first("encounter").alias("encounter"), F.max("t").alias("duration"))
    return found.join(fights, "fight")


def windows_of(lives: DataFrame) -> DataFrame:
    """(fight, encounter, window): how far the fight was observed."""
    return lives.groupBy("fight", "encounter").agg(F.max(F.least("last", "duration")).alias("window"))


def _shapes(spark: SparkSession, sf_dir: str, lives: DataFrame | None = None) -> DataFrame:
    """(fight, encounter, window, shape). Lives are written once, since steps and windows read them, and shapes too:
    clusters and medoids read them again and again."""
    lives = checkpointed(fight_lives(spark, sf_dir)) if lives is None else lives
    return checkpointed(H.sampled(I.concurrency(lives), windows_of(lives), "fight", SAMPLES))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.samples_of(_shapes(spark, sf_dir), "fight", "encounter")


def _dealt_shapes(shapes: DataFrame) -> DataFrame:
    """Shapes by encounter, 20,000 to a task: what they grow into is more than their bytes tell."""
    return dealt(shapes, "encounter", 20_000)


@query(f"WITH {LIVES} SELECT fight, actor, instance, first, last, died, CAST(total AS DOUBLE) AS total FROM lives")
def entity_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fight_lives(spark, sf_dir).select("fight", "actor", "instance", "first", "last", "died", F.col("total").cast("double"))


@query(f"WITH {STEPS} SELECT fight, t, n FROM steps")
def concurrency_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.concurrency(fight_lives(spark, sf_dir))


@query(f"""WITH {STEPS}, sp AS (SELECT fight, t, n, window_, GREATEST(COALESCE(LEAD(t) OVER (PARTITION BY fight ORDER BY t), window_) - t, 0) AS span, MAX(n) OVER (PARTITION BY fight) AS peak FROM steps JOIN win USING (fight)),
o AS (SELECT fight, CASE WHEN MAX(window_) > 0 THEN ROUND(SUM(n * span) / MAX(window_), 4) END AS mean, MAX(peak) AS peak, CASE WHEN MAX(window_) > 0 THEN ROUND(SUM(CASE WHEN n = peak THEN span ELSE 0 END) / MAX(window_), 4) END AS peak_share FROM sp GROUP BY fight)
SELECT *, COALESCE(peak_share >= 0.95, FALSE) AS constant FROM o""")
def concurrency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lives = fight_lives(spark, sf_dir)
    return I.concurrency_stats(I.concurrency(lives), windows_of(lives).drop("encounter"))


def _auras(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "end")
    ev = events(spark, sf_dir).select("fight", "encounter", (F.col("event_id") % 2).alias("ability"), (F.col("event_id") % 4).alias("source"), "t", "event_id", "duration", kind.alias("kind"))
    return I.paired(ev, ["fight", "ability"], ["t", "event_id"])


@query(f"WITH {AURAS} SELECT fight, ability, start_ AS \"start\", end_ AS \"end\", truncated, opener FROM auras")
def aura_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _auras(spark, sf_dir)


@query(f"""WITH {AURAS}, m AS (SELECT *, MAX(end_) OVER (PARTITION BY fight ORDER BY start_, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM auras),
k AS (SELECT *, SUM(CASE WHEN reach IS NULL OR start_ > reach THEN 1 ELSE 0 END) OVER (PARTITION BY fight ORDER BY start_, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
SELECT fight, MIN(start_) AS "start", MAX(end_) AS "end", COUNT(*) AS windows, BOOL_OR(truncated) AS truncated FROM k GROUP BY fight, island""")
def aura_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merged(_auras(spark, sf_dir), ["fight"])


@query(f"""WITH {AURAS}, p AS (SELECT a.*, a.fight // 100000 AS encounter, end_ - start_ AS lasts FROM auras a)
SELECT encounter, ability, COUNT(DISTINCT fight) AS reports, COUNT(*) AS applications, ROUND(MEDIAN(lasts), 6) AS median, ROUND(MIN(lasts), 6) AS low, ROUND(MAX(lasts), 6) AS high, COUNT(DISTINCT opener) AS carriers, BOOL_OR(truncated) AS truncated,
  CASE WHEN COUNT(DISTINCT CASE opener WHEN 0 THEN 'boss' WHEN 1 THEN 'add' WHEN 2 THEN 'add' END) > 1 THEN 'mixed' WHEN BOOL_OR(opener = 3) THEN 'unknown' ELSE MAX(CASE opener WHEN 0 THEN 'boss' ELSE 'add' END) END AS role
FROM p GROUP BY encounter, ability HAVING COUNT(DISTINCT fight) >= 2""")
def pooled_auras(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("opener") == 0, "boss").when(F.col("opener").isin(1, 2), "add").otherwise("unknown")
    windows = _auras(spark, sf_dir).withColumn("encounter", F.floor(F.col("fight") / 100000)).withColumn("lasts", F.col("end") - F.col("start")).withColumn("role", role)
    out = windows.groupBy("encounter", "ability").agg(
        F.countDistinct("fight").alias("reports"), F.count(F.lit(1)).alias("applications"), F.round(F.median("lasts"), 6).alias("median"), F.round(F.min("lasts"), 6).alias("low"),
        F.round(F.max("lasts"), 6).alias("high"), F.countDistinct("opener").alias("carriers"), F.bool_or("truncated").alias("truncated"), I.role_fold(F.collect_set("role")).alias("role"),
    )
    return out.where("reports >= 2")


@query("""WITH o AS (SELECT o_custkey AS customer, o_orderkey, o_orderstatus AS name, CAST(epoch_us(o_orderdate) // 1000000 AS DOUBLE) AS at_ FROM orders),
p AS (SELECT *, MAX(at_) OVER (PARTITION BY customer) + 86400.0 AS duration, ROW_NUMBER() OVER w AS ordinal, FIRST_VALUE(at_) OVER w AS origin, LEAD(at_) OVER w AS nxt FROM o WINDOW w AS (PARTITION BY customer ORDER BY at_, o_orderkey))
SELECT customer, ordinal, name, at_ - origin AS "start", COALESCE(nxt, duration) - origin AS "end" FROM p""")
def phase_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.floor(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate)") / 1000000).cast("double")
    marks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), "o_orderkey", "o_orderstatus", at.alias("at"))
    marks = marks.withColumn("duration", F.max("at").over(W.partitionBy("customer")) + 86400.0)
    return I.phases(marks, ["customer"], "at", ["o_orderkey"], "o_orderstatus", "duration")


@query(f"""WITH {LIVES}, x AS (SELECT *, first - LAG(first) OVER (PARTITION BY fight, actor ORDER BY first, instance) AS gap, SUM(total) OVER (PARTITION BY fight) AS whole FROM lives)
SELECT fight, actor, COUNT(*) AS n, ROUND(MIN(first), 6) AS first, ROUND(MEDIAN(last - first), 6) AS lifetime, ROUND(MEDIAN(gap), 6) AS gap, MIN(first) <= 2.0 AS at_pull, ROUND(CASE WHEN MAX(whole) > 0 THEN CAST(SUM(total) AS DOUBLE) / CAST(MAX(whole) AS DOUBLE) ELSE 0.0 END, 6) AS share FROM x GROUP BY fight, actor""")
def add_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.add_patterns(fight_lives(spark, sf_dir), ["fight", "actor"], places=6)


@query(f"""WITH {STEPS}, x AS (SELECT *, MAX(n) OVER (PARTITION BY fight) AS peak, COALESCE(LAG(n) OVER (PARTITION BY fight ORDER BY t), -1) AS before FROM steps)
SELECT fight, MAX(peak) AS peak, COUNT(*) FILTER (WHERE n >= peak AND before < peak) AS visits FROM x GROUP BY fight""")
def peak_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.peak_visits(I.concurrency(fight_lives(spark, sf_dir)))


_DAMAGE = f"{LIVES}, dmg AS (SELECT fight, actor, SUM(total) AS total FROM lives GROUP BY fight, actor)"


def _damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fight_lives(spark, sf_dir).groupBy("fight", "actor").agg(F.sum("total").alias("total"))


@query(f"""WITH {_DAMAGE}, nm AS (SELECT fight, actor, total, 'Raid ' || fight // 100000 AS encounter, CASE WHEN actor = fight // 100000 % 7 THEN ' RAID ' || fight // 100000 || ' lord ' WHEN actor = 3 AND fight % 4 = 0 THEN 'raid' WHEN actor = 2 THEN '' ELSE 'add ' || actor END AS name FROM dmg),
r AS (SELECT *, ROW_NUMBER() OVER w AS k, LEAD(total) OVER w AS nxt, COUNT(*) OVER (PARTITION BY fight) AS c FROM nm WINDOW w AS (PARTITION BY fight ORDER BY total DESC, actor)),
n AS (SELECT fight, MIN(actor) AS named FROM nm WHERE TRIM(name) <> '' AND (CONTAINS(LOWER(TRIM(name)), LOWER(encounter)) OR CONTAINS(LOWER(encounter), LOWER(TRIM(name)))) GROUP BY fight),
z AS (SELECT r.fight, actor, named, CASE WHEN named IS NOT NULL THEN 'name' WHEN c = 1 THEN 'only' WHEN total > 0 AND (nxt <= 0 OR CAST(total AS DOUBLE) >= 1.25 * CAST(nxt AS DOUBLE)) THEN 'margin' ELSE 'none' END AS reason FROM r LEFT JOIN n USING (fight) WHERE k = 1)
SELECT fight, CASE WHEN named IS NOT NULL THEN named WHEN reason <> 'none' THEN actor END AS actor, reason FROM z""")
def priority_nomination(spark: SparkSession, sf_dir: str) -> DataFrame:
    encounter = F.floor(F.col("fight") / 100000)
    name = F.when(F.col("actor") == encounter % 7, F.concat(F.lit(" RAID "), encounter, F.lit(" lord "))).when((F.col("actor") == 3) & (F.col("fight") % 4 == 0), "raid")
    name = name.when(F.col("actor") == 2, "").otherwise(F.concat(F.lit("add "), "actor"))
    damage = _damage(spark, sf_dir).withColumn("total", F.col("total").cast("double")).withColumn("name", name).withColumn("encounter", F.concat(F.lit("Raid "), encounter))
    return I.nominated(damage, "fight", "actor", "total", "name", "encounter")


@query(f"""WITH {_DAMAGE}, s AS (SELECT fight, actor, CASE WHEN SUM(total) OVER (PARTITION BY fight) > 0 THEN CAST(total AS DOUBLE) / CAST(SUM(total) OVER (PARTITION BY fight) AS DOUBLE) ELSE 1.0 END AS share FROM dmg)
SELECT * FROM s WHERE share >= 0.01""")
def significant_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.significant(_damage(spark, sf_dir), "fight", "total").select("fight", "actor", "share")


@query(f"WITH {GRID} SELECT fight, bucket, n FROM samples")
def resample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).select("fight", "bucket", "n")


@query(f"WITH {GRID} SELECT encounter, fight_a, fight_b, distance FROM dist")
def shape_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.pair_distances(_dealt_shapes(_shapes(spark, sf_dir)), "encounter", "fight")


@query(f"WITH RECURSIVE {CLUSTERS} SELECT encounter, fight, cluster FROM clusters")
def shape_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.clusters(_shapes(spark, sf_dir), "encounter", "fight")


@query(f"""WITH RECURSIVE {CLUSTERS}, both_ AS (SELECT fight_a AS fight, fight_b AS other, distance FROM dist UNION ALL SELECT fight_b, fight_a, distance FROM dist),
s AS (SELECT c.encounter, c.cluster, c.fight, ROUND(COALESCE(SUM(b.distance), 0), 6) AS total, COALESCE(MAX(b.distance), 0) AS far FROM clusters c LEFT JOIN (both_ b JOIN clusters o ON o.fight = b.other) ON b.fight = c.fight AND o.cluster = c.cluster GROUP BY ALL)
SELECT encounter, cluster, ARG_MIN(fight, (total, fight)) AS medoid, MIN(total) AS total, MAX(far) AS diameter, COUNT(*) AS size FROM s GROUP BY encounter, cluster""")
def medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = _shapes(spark, sf_dir)
    return H.medoids(shapes, H.clusters(shapes, "encounter", "fight"), "encounter", "fight")


@query(f"""WITH {GRID}, p AS (SELECT s.encounter, s.fight, CAST(SUM(n) AS DOUBLE) / COUNT(*) AS mean, MAX(window_) AS length FROM samples s JOIN win w ON w.fight = s.fight GROUP BY s.encounter, s.fight),
m AS (SELECT encounter, MEDIAN(mean) AS mm, MEDIAN(length) AS ml FROM p GROUP BY encounter)
SELECT encounter, ARG_MIN(fight, (ROUND(ABS(mean - mm), 6), ROUND(ABS(length - ml), 6), fight)) AS fight FROM p JOIN m USING (encounter) GROUP BY encounter""")
def representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _representative(_shapes(spark, sf_dir))


def _representative(shapes: DataFrame) -> DataFrame:
    whole = F.aggregate("shape", F.lit(0).cast("long"), lambda a, n: a + n)
    pulls = shapes.select("encounter", "fight", (whole.cast("double") / F.size("shape")).alias("mean"), F.col("window").alias("length"))
    return H.representatives(pulls, "encounter", "fight", "mean", "length")


@query(f"""WITH {GRID} SELECT encounter, bucket, COUNT(*) AS pulls, QUANTILE_CONT(n, 0.5) AS median, QUANTILE_CONT(n, 0.25) AS p25, QUANTILE_CONT(n, 0.75) AS p75, MIN(n) AS low, MAX(n) AS high FROM samples GROUP BY encounter, bucket HAVING COUNT(*) >= 2""")
def target_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.band(H.samples_of(_dealt_shapes(_shapes(spark, sf_dir)), "encounter"), "encounter")


@query(f"""WITH {STEPS}, st AS (SELECT s.*, w.encounter FROM steps s JOIN win w USING (fight)), pts AS (SELECT DISTINCT encounter, t FROM st),
g AS (SELECT p.encounter, p.t, w.fight, w.window_ FROM pts p JOIN win w USING (encounter))
SELECT g.encounter, g.t, g.fight, CASE WHEN g.t <= g.window_ THEN COALESCE(s.n, 0) END AS n FROM g ASOF LEFT JOIN st s ON g.fight = s.fight AND g.t >= s.t""")
def asof_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    lives = fight_lives(spark, sf_dir)
    until = windows_of(lives)
    steps = I.concurrency(lives).join(until.select("fight", "encounter"), "fight")
    return H.aligned(steps, until, "encounter", "fight")


@query(f"""WITH {AURAS}, a AS (SELECT fight, opener AS id, MIN(start_) AS start_, MAX(end_ - start_) AS lasts FROM auras WHERE ability = 0 GROUP BY fight, opener),
m AS (SELECT fight, opener AS id, MIN(start_) AS start_, MAX(end_ - start_) AS lasts FROM auras WHERE ability = 1 GROUP BY fight, opener),
z AS (SELECT a.fight, a.id, m.id AS mid, m.start_ AS ms_, ROUND(ABS(a.start_ - m.start_) + ABS(a.lasts - m.lasts), 6) AS gap FROM a JOIN m ON a.fight = m.fight),
b AS (SELECT fight, id, ARG_MIN(mid, (gap, ms_, mid)) AS nearest, MIN(gap) AS gap FROM z WHERE gap <= 3600 GROUP BY fight, id)
SELECT a.fight, a.id, a.start_ AS "start", a.lasts, b.nearest, b.gap FROM a LEFT JOIN b ON a.fight = b.fight AND a.id = b.id""")
def nearest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = _auras(spark, sf_dir).withColumn("lasts", F.col("end") - F.col("start"))
    side = lambda k: windows.where(F.col("ability") == k).groupBy("fight", F.col("opener").alias("id")).agg(F.min("start").alias("start"), F.max("lasts").alias("lasts"))
    return H.nearest_window(side(0), side(1), "fight", most=3600.0)


_HOURS = f"""{EV}, h0 AS (SELECT encounter, ms // 3600000 AS hour, SUM(amount) AS v FROM ev GROUP BY ALL), r AS (SELECT MIN(hour) AS lo, MAX(hour) AS hi FROM h0),
dense AS (SELECT u.encounter, x.hour, COALESCE(h0.v, 0) AS v, x.hour - lo AS k FROM (SELECT DISTINCT encounter FROM h0) u, r, range(lo, hi + 1) x(hour) LEFT JOIN h0 ON h0.encounter = u.encounter AND h0.hour = x.hour)"""


def _hourly(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(encounter, k, v) of the hours that have events, and how many hours the table spans."""
    summed = checkpointed(events(spark, sf_dir).groupBy("encounter", F.floor(F.col("ms") / 3600000).alias("hour")).agg(F.sum("amount").alias("v")))
    first, last = summed.agg(F.min("hour"), F.max("hour")).first()
    return summed.select("encounter", (F.col("hour") - F.lit(first)).alias("k"), "v"), 0 if first is None else last - first + 1


@query(f"""WITH {_HOURS}, w AS (SELECT *, CASE WHEN COUNT(v) OVER x = 20 THEN SUM(v) OVER x END AS s FROM dense WINDOW x AS (PARTITION BY encounter ORDER BY k ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT encounter, COUNT(*) AS n, CASE WHEN COUNT(*) >= 20 AND SUM(v) > 0 THEN CAST(MAX(s) AS DOUBLE) / 20 / (CAST(SUM(v) AS DOUBLE) / COUNT(*)) END AS burst FROM w GROUP BY encounter""")
def burst_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, span = _hourly(spark, sf_dir)
    return C.rolling_burst(series, ["encounter"], "k", "v", span)


@query(f"WITH {_HOURS} SELECT encounter, k // 24 AS bin, CAST(SUM(v) AS DOUBLE) / COUNT(*) AS mean FROM dense GROUP BY ALL")
def binned_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, span = _hourly(spark, sf_dir)
    return C.binned(series, ["encounter"], "k", "v", span, 24)


@query("""WITH p AS (SELECT p_partkey AS plan, CAST(p_size AS DOUBLE) AS first, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 40 AS DOUBLE) END AS cadence, 15.0 AS lasts, 120.0 AS length FROM part),
s AS (SELECT plan, first + k * COALESCE(CASE WHEN cadence > 0 THEN cadence END, 0) AS first, lasts, length FROM (SELECT *, unnest(range(0, CASE WHEN cadence IS NULL OR cadence <= 0 THEN 1 ELSE CAST(FLOOR((length - first) / cadence) AS BIGINT) + 1 END)) AS k FROM p)),
w AS (SELECT plan, first, LEAST(first + lasts, length) AS last FROM s), moves AS (SELECT plan, t, SUM(d) AS d FROM (SELECT plan, first AS t, 1 AS d FROM w UNION ALL SELECT plan, last, -1 FROM w) GROUP BY ALL),
run AS (SELECT plan, t, CAST(SUM(d) OVER (PARTITION BY plan ORDER BY t) AS BIGINT) AS n FROM moves)
SELECT plan, t, n FROM (SELECT *, LAG(n) OVER (PARTITION BY plan ORDER BY t) AS b FROM run) WHERE b IS NULL OR b <> n UNION ALL SELECT plan, 0.0, 0 FROM run GROUP BY plan HAVING MIN(t) > 0""")
def planned_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = F.when(F.col("p_partkey") % 5 != 0, (F.col("p_partkey") % 40).cast("double"))
    waves = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("plan"), F.col("p_size").cast("double").alias("first"), every.alias("cadence"), F.lit(15.0).alias("lasts"), F.lit(120.0).alias("length"))
    return I.concurrency(I.planned_waves(dealt(waves, "plan")), "plan")


_HITS = """SELECT user_id AS encounter, event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL"""


def _drained(stream: DataFrame, mode: str, path: str) -> None:
    """Runs a stream over what is there now, into the folder path/rows."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


@query(f"WITH {AURAS} SELECT fight, ability, start_ AS \"start\", end_ AS \"end\", truncated, opener FROM auras")
def aura_windows_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of aura_windows, paired by a stateful stream over the events as files.

    A step's files hold a sixth of the time; every seventh row comes a step late, which the watermark's delay of two
    steps allows, wherever among a step's files a trigger ends. A last file holds one row far behind the end, which
    lets the watermark pass every fight's end.
    """
    from gaugeworks.streaming.windows import keyed_state, paired_stream

    path = scratch_path(spark, "aura-stream")
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "end")
    ev = events(spark, sf_dir).withColumn("kind", kind).where("kind IS NOT NULL")
    ends = (F.floor(F.col("ms") / 86400000) * 86400000 + F.round(F.col("duration") * 1000)).cast("long").alias("ends")
    rows = ev.select(
        F.timestamp_millis("ms").alias("ts"), "fight", (F.col("event_id") % 2).alias("ability"), "t", F.col("event_id").alias("seq"), "kind",
        (F.col("event_id") % 4).alias("source"), ends, "duration",
    )
    rows = checkpointed(rows)
    first, last, count = rows.agg(F.unix_millis(F.min("ts")), F.unix_millis(F.max("ts")), F.count("ts")).first()
    if first is None:
        return spark.createDataFrame([], "fight long, ability long, start double, end double, truncated boolean, opener long")
    span = (last - first) // 6 + 1
    step = F.floor((F.unix_millis("ts") - first) / span) + F.when(F.col("seq") % 7 == 0, 1).otherwise(0)
    tick = spark.range(1).select(
        F.timestamp_millis(F.lit(last + 3 * span + 2 * 86400000)).alias("ts"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[1:])
    )
    for k in range(7):  # files are read by the time of their writing
        rows.where(step == k).write.mode("append").parquet(f"{path}/in")
    files = len(spark.read.schema(rows.schema).parquet(f"{path}/in").inputFiles())
    tick.coalesce(1).write.mode("append").parquet(f"{path}/in")
    with keyed_state(spark):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // 7)).parquet(f"{path}/in")
        _drained(paired_stream(stream, f"{2 * span} milliseconds", 16 + count // 5_000), "append", path)
    return spark.read.parquet(f"{path}/rows")


@query(_HITS)
def merged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums per user and type, merged batch by batch into a table whose newest rows are read back."""
    from gaugeworks.streaming.sink import MergedTable

    path = scratch_path(spark, "merged-stream")
    rows = events(spark, sf_dir).select("encounter", "event_type", "amount", (F.col("event_id") % 4).alias("part"))
    rows.repartition(4, "part").write.parquet(f"{path}/in")
    kept = MergedTable(spark, f"{path}/table", "encounter BIGINT, event_type STRING, n BIGINT, total DECIMAL(28,2)", ["encounter", "event_type"], "n", ["total"])
    sums = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in").groupBy("encounter", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
    sums.writeStream.outputMode("update").foreachBatch(kept.write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return kept.read().withColumn("total", F.col("total").cast("double"))
