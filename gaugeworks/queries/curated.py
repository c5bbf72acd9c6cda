"""Queries of curated facts and of what replaces them: proposals, notes, carried-over fields, load checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import merge as M
from gaugeworks.operators.selection import order_statistics
from gaugeworks.plans import rules as R
from gaugeworks.queries.registry import query
from gaugeworks.session import table
from gaugeworks.sources import scans


@query("""WITH p AS (SELECT l_suppkey AS encounter, l_orderkey, COUNT(*) AS size, SUM(l_quantity) AS length FROM lineitem GROUP BY ALL),
s AS (SELECT encounter, MEDIAN(length) AS length, MIN(size) AS low, MEDIAN(size) AS mid, MAX(size) AS high FROM p GROUP BY encounter)
SELECT encounter, CAST(ROUND_EVEN(length, 0) AS BIGINT) AS seconds, CAST(ROUND_EVEN(mid, 0) AS BIGINT) AS size, CASE WHEN low <> high THEN 'the sampled fights logged different group sizes (' || low || '-' || high || ')' END AS withheld FROM s""")
def fight_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and size of an encounter's fights; a fight is what a supplier has of one order."""
    pulls = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("encounter"), "l_orderkey").agg(F.count(F.lit(1)).alias("size"), F.sum("l_quantity").cast("double").alias("length"))
    middle = lambda c: order_statistics(pulls, ["encounter"], c, {c: 0.5}).select("encounter", F.col(c), F.col("low").alias(f"low_{c}"), F.col("high").alias(f"high_{c}"))
    met = middle("length").join(middle("size"), "encounter")
    size = R.raid_size(F.col("low_size"), F.col("size"), F.col("high_size"))
    return met.select("encounter", R.fight_length(F.col("length")).alias("seconds"), size["value"].alias("size"), size["withheld"].alias("withheld"))


@query("""WITH s AS (SELECT o_orderkey AS id, 'Season ' || o_custkey % 4 AS label, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 9 END AS season,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '' ELSE ' SEASON ' || o_orderkey % 4 || ' ' END AS name FROM orders),
n AS (SELECT *, CASE WHEN season IS NOT NULL AND COALESCE(name, '') <> '' THEN LOWER(TRIM(name)) = LOWER(TRIM(label)) END AS agrees FROM s)
SELECT label, CASE WHEN season IS NULL THEN 'not reported' WHEN COALESCE(name, '') = '' THEN 'not named' WHEN agrees THEN 'agrees' ELSE 'differs' END AS state, agrees, COUNT(*) AS n FROM n GROUP BY ALL""")
def season_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    name = F.when(key % 5 == 0, F.lit(None).cast("string")).when(key % 5 == 1, "").otherwise(F.concat(F.lit(" SEASON "), (key % 4).cast("string"), F.lit(" ")))
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("Season "), F.col("o_custkey") % 4).alias("label"), F.when(key % 7 != 0, key % 9).alias("season"), name.alias("name"))
    noted = rows.select("label", R.season_note(F.col("label"), F.col("season"), F.col("name")).alias("n"))
    return noted.groupBy("label", "n.state", "n.agrees").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey END AS own_id, CASE p_partkey % 4 WHEN 0 THEN 'boss' WHEN 1 THEN 'add' ELSE 'unknown' END AS own_role,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS m_id, CASE p_size % 6 WHEN 0 THEN 'mixed' WHEN 1 THEN 'unknown' WHEN 2 THEN NULL WHEN 3 THEN 'boss' ELSE 'add' END AS m_role FROM part),
f AS (SELECT *, own_id IS NULL AND m_id IS NOT NULL AS a, own_role = 'unknown' AND COALESCE(m_role IN ('boss', 'add'), FALSE) AS b FROM x)
SELECT id, CASE WHEN a THEN m_id ELSE own_id END AS ability, CASE WHEN b THEN m_role ELSE own_role END AS role, a OR b AS changed FROM f""")
def amplification_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    role = F.when(key % 4 == 0, "boss").when(key % 4 == 1, "add").otherwise("unknown")
    matched = F.when(size % 6 == 0, "mixed").when(size % 6 == 1, "unknown").when(size % 6 == 2, F.lit(None).cast("string")).when(size % 6 == 3, "boss").otherwise("add")
    out = R.filled(F.when(key % 3 != 0, key), role, F.when(size % 5 != 0, size), matched)
    return table(spark, sf_dir, "part").select(key.alias("id"), out.alias("f")).select("id", F.col("f.id").alias("ability"), "f.role", "f.changed")


@query("""WITH d AS (SELECT p_partkey AS item, p_brand AS slot, p_name AS name FROM part WHERE p_partkey % 5 <> 0),
o AS (SELECT p_partkey AS item, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS gem, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size * 2 END AS enchant FROM part WHERE p_partkey % 3 <> 0),
a AS (SELECT 'Brand#' || k AS slot, CASE WHEN k % 3 = 0 THEN NULL ELSE 100 + k END AS gem, CASE WHEN k % 3 = 0 OR k % 2 = 0 THEN NULL ELSE 200 + k END AS enchant FROM range(1, 15) r(k))
SELECT d.item, d.slot, d.name, CAST(CASE WHEN COALESCE(a.gem, a.enchant) IS NOT NULL THEN a.gem ELSE o.gem END AS BIGINT) AS gem, CAST(CASE WHEN COALESCE(a.gem, a.enchant) IS NOT NULL THEN a.enchant ELSE o.enchant END AS BIGINT) AS enchant
FROM d LEFT JOIN o USING (item) LEFT JOIN a USING (slot)""")
def rebuilt_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived pool that keeps how its items were worn, then as profiles adorn their sockets."""
    parts, size = table(spark, sf_dir, "part"), F.col("p_size").cast("long")
    derived = parts.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("slot"), F.col("p_name").alias("name"))
    gem, enchant = F.when(size % 3 != 0, size), F.when(size % 4 != 0, size * 2)
    old = parts.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("item"), gem.alias("gem"), enchant.alias("enchant"), F.lit("old").alias("note"))
    k = F.col("id")
    sockets = spark.range(1, 15).select(F.concat(F.lit("Brand#"), k.cast("string")).alias("slot"), F.when(k % 3 != 0, 100 + k).alias("gem"), F.when((k % 3 != 0) & (k % 2 != 0), 200 + k).alias("enchant"))
    return M.adorned(M.rebuilt(derived, old, ["item"], ["gem", "enchant"]), sockets, ["slot"], ["gem", "enchant"])


@query("""WITH v AS (SELECT event_id, event_id % 6 AS k, event_type FROM events)
SELECT event_id, k > 3 AS loads, CASE k WHEN 0 THEN 'Error: Initialization error: Hash ''x'' ' || event_id WHEN 1 THEN LEFT('Unable to generate ' || repeat('y', 300), 200) WHEN 2 THEN 'Error: Initialization error of ' || event_id WHEN 3 THEN 'Error: Hash ''z''' END AS reason, k = 0 AS stale FROM v""")
def load_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of a program for every event, with errors of each kind, in other orders than the rule's."""
    key, kind, line = F.col("event_id"), F.col("event_type"), F.lit("\n")
    middle = F.when(key % 6 == 0, F.concat(F.lit("  Setup failure in "), kind, line, F.lit("Error: Initialization error: Hash 'x' "), key.cast("string")))
    middle = middle.when(key % 6 == 1, F.concat(F.lit("Unable to generate "), F.repeat(F.lit("y"), F.lit(300)))).when(key % 6 == 2, F.concat(F.lit("Error: Initialization error of "), key.cast("string")))
    middle = middle.when(key % 6 == 3, F.concat(F.lit("Error: Hash 'z'"), line, F.lit("Error: second"))).otherwise("fine")
    rows = table(spark, sf_dir, "events").select(key, scans.loads(F.concat(F.lit("start "), kind, line, middle, line, F.lit("end"))).alias("v"))
    return rows.select("event_id", "v.loads", "v.reason", "v.stale")


@query("""WITH l AS (SELECT p_partkey AS line, p_name AS name, 'set' || p_size % 7 AS option, p_brand AS tier, p_partkey % 13 - 1 AS class FROM part WHERE p_partkey % 4 <> 0)
SELECT ARG_MIN(name, line) AS name, option, tier, CAST(class AS INT) AS class FROM l GROUP BY option, tier, class""")
def set_bonus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated table with a row for each part; a quarter of the lines are of another kind."""
    key = F.col("p_partkey")
    row = F.format_string('  { "%s" , "%s", "%s", 3, -1,  2, %d, 0, 17 },', "p_name", F.concat(F.lit("set"), F.col("p_size") % 7), "p_brand", key % 13 - 1)
    text = F.when(key % 4 == 0, F.concat(F.lit("// "), F.col("p_name"))).otherwise(row)
    return scans.set_bonuses(table(spark, sf_dir, "part").select(key.alias("line"), text.alias("text")))


@query("""WITH p AS (SELECT 'T' || p_size % 3 AS tier, p_brand AS slot, p_partkey AS item FROM part)
SELECT slot, COUNT(*) AS items, CAST(0 AS BIGINT) AS unknown_facts FROM p WHERE tier = 'T1' GROUP BY slot""")
def curated_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pools of a tier that there is, and the facts of one that there isn't."""
    pools = table(spark, sf_dir, "part").select(F.concat(F.lit("T"), F.col("p_size") % 3).alias("tier"), F.col("p_brand").alias("slot"), F.col("p_partkey").alias("item"))
    facts = scans.facts_of_tier(pools, "T9").groupBy("slot").agg(F.count(F.lit(1)).alias("unknown_facts"))
    own = scans.pool_of_tier(pools, "T1").groupBy("slot").agg(F.count(F.lit(1)).alias("items"))
    return own.join(facts, "slot", "left").select("slot", "items", F.coalesce("unknown_facts", F.lit(0)).alias("unknown_facts"))
