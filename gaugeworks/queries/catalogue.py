"""Queries of catalogues: parts are items, suppliers' nations the instances that drop them, regions the builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions import bits as B
from gaugeworks.functions import text as T
from gaugeworks.operators import catalog as K
from gaugeworks.operators import merge as M
from gaugeworks.plans import rules as R
from gaugeworks.queries import fights, sweeps
from gaugeworks.queries.registry import query
from gaugeworks.session import dealt, table

STATS = ("str", "agi", "int")


@query("""WITH items AS (SELECT p_brand AS brand, p_partkey AS item, CASE p_partkey % 4 WHEN 0 THEN 'str' WHEN 1 THEN 'agi' WHEN 2 THEN 'int' END AS stat, p_size % 25 AS instance, p_size % 3 = 0 AS dungeon, CASE p_partkey % 7 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS derived, p_brand <> 'Brand#3' AS placed FROM part),
x AS (SELECT r_regionkey AS region, brand, COALESCE(CASE r_regionkey WHEN 0 THEN stat IS NULL OR stat = 'str' WHEN 1 THEN stat IS NULL OR stat = 'agi' WHEN 2 THEN stat IS NULL OR stat = 'int' WHEN 3 THEN stat IS NULL OR stat IN ('str', 'agi') ELSE FALSE END, FALSE) AS ok,
  CASE WHEN dungeon AND derived IS NOT NULL THEN derived WHEN r_regionkey = 4 OR NOT dungeon THEN TRUE WHEN NOT placed THEN TRUE ELSE instance < 12 END AS rotating FROM items, region)
SELECT region, brand, COUNT(*) FILTER (WHERE ok) AS eligible, COUNT(*) FILTER (WHERE ok AND rotating) AS baseline, COUNT(*) FILTER (WHERE ok AND NOT rotating) AS candidates FROM x GROUP BY region, brand""")
def eligibility_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.when(F.col("r_regionkey") == 3, F.array(F.lit("str"), F.lit("agi")))
    for k, stat in enumerate(STATS):
        allowed = allowed.when(F.col("r_regionkey") == k, F.array(F.lit(stat)))
    builds = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), allowed.alias("allowed"))
    which = F.get(F.array(*map(F.lit, STATS), F.lit(None)), (F.col("p_partkey") + 0) % 4)
    items = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("brand"), which.alias("stat"), (F.col("p_size") % 25).alias("instance"), (F.col("p_size") % 3 == 0).alias("dungeon"),
        F.when(F.col("p_partkey") % 7 == 0, True).when(F.col("p_partkey") % 7 == 1, False).alias("derived"), (F.col("p_brand") != "Brand#3").alias("placed"),
    )
    counted = items.groupBy("brand", "stat", "instance", "dungeon", "derived", "placed").agg(F.count(F.lit(1)).alias("n"))
    met = counted.join(F.broadcast(builds))  # five regions
    rotation = F.when(F.col("region") != 4, F.array(*map(F.lit, range(12))))  # the last has none
    ok, rotating = K.eligible(F.col("stat"), F.col("allowed")), K.in_rotation(F.col("derived"), F.col("dungeon"), rotation, F.col("placed"), F.col("instance"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return met.groupBy("region", "brand").agg(total(ok).alias("eligible"), total(ok & rotating).alias("baseline"), total(ok & ~rotating).alias("candidates"))


def _drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), "l_suppkey", "l_orderkey", "l_linenumber")
    places = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return lines.join(places.select("s_suppkey", F.col("n_nationkey").alias("instance"), F.col("n_regionkey").alias("region")), F.col("l_suppkey") == F.col("s_suppkey"))


_DROPS = """drops AS (SELECT l_partkey AS item, n_nationkey AS instance, n_regionkey AS region, l_orderkey, l_linenumber FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


@query(f"""WITH {_DROPS} SELECT item, instance, CASE WHEN region = 0 THEN 'raid' ELSE 'rotation' END AS source FROM drops WHERE region <= 2
QUALIFY ROW_NUMBER() OVER (PARTITION BY item ORDER BY CASE WHEN region = 0 THEN 0 ELSE 1 END, l_orderkey, l_linenumber, instance) = 1""")
def placement_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("region") == 0, 0).when(F.col("region") <= 2, 1)
    best = K.first_drop(_drops(spark, sf_dir), "item", rank, ["l_orderkey", "l_linenumber", "instance"], ["instance", "region"])
    return best.select("item", "instance", F.when(F.col("region") == 0, "raid").otherwise("rotation").alias("source"))


@query(f"""WITH {_DROPS}, a AS (SELECT DISTINCT item FROM drops WHERE region = 0), b AS (SELECT DISTINCT item FROM drops WHERE region = 1)
SELECT COALESCE(a.item, b.item) AS item, CASE WHEN a.item IS NULL THEN 'gained' WHEN b.item IS NULL THEN 'lost' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.item = b.item""")
def pool_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    drops = _drops(spark, sf_dir)
    return K.pool_changes(drops.where("region = 0"), drops.where("region = 1"), "item")


@query("""WITH d AS (SELECT o_custkey AS customer, o_orderkey % 25 AS nation FROM orders WHERE o_orderstatus = 'F'), g AS (SELECT customer, COUNT(DISTINCT nation) AS sources, LIST(DISTINCT nation) AS l FROM d GROUP BY customer)
SELECT c_custkey AS customer, c_nationkey AS asserted, COALESCE(sources, 0) AS sources, CASE WHEN l IS NULL THEN 'unresolved' WHEN list_contains(l, c_nationkey) AND sources > 1 THEN 'multiple' WHEN list_contains(l, c_nationkey) THEN 'agree' ELSE 'disagree' END AS state
FROM customer LEFT JOIN g ON customer = c_custkey""")
def reconcile_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    asserted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("nation"))
    derived = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("customer"), (F.col("o_orderkey") % 25).cast("int").alias("nation"))
    return K.reconciled(asserted, derived, "customer", "nation").select("customer", "asserted", F.col("sources").cast("long"), "state")


@query(f"""WITH {_DROPS}, c AS (SELECT instance, region, COUNT(DISTINCT item) AS items FROM drops GROUP BY 1, 2), b AS (SELECT instance AS bi, region AS br FROM c ORDER BY items DESC, instance LIMIT 1)
SELECT instance, region, items, CASE WHEN instance = bi THEN 'current' WHEN region = br THEN 'companion' ELSE 'legacy' END AS state FROM c, b""")
def identify_best_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.best_group(_drops(spark, sf_dir), "instance", "item", "region")


_COVER = """grid AS (SELECT DISTINCT n_nationkey AS nation, c_mktsegment AS segment FROM nation, customer),
played AS (SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS segment FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P' AND o_totalprice > 300000),
refused AS (SELECT c_nationkey AS nation, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment, 'r' || (c_custkey % 7) AS reason FROM customer WHERE c_acctbal < -900),
cov AS (SELECT g.nation, g.segment, p.nation IS NOT NULL AS covered, CASE WHEN p.nation IS NULL THEN COALESCE((SELECT MIN(reason) FROM refused r WHERE r.nation = g.nation AND r.segment = g.segment), (SELECT MIN(reason) FROM refused r WHERE r.nation = g.nation AND r.segment IS NULL), 'missing') END AS reason
  FROM grid g LEFT JOIN played p ON p.nation = g.nation AND p.segment = g.segment)"""


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    segments = customers.select("segment").distinct()
    grid = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation")).join(F.broadcast(segments))  # two small dimensions
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    played = customers.join(orders, "c_custkey", "left_semi")
    refused = customers.where("c_acctbal < -900").select("nation", F.when(F.col("c_custkey") % 2 == 0, F.col("segment")).alias("segment"), F.concat(F.lit("r"), F.col("c_custkey") % 7).alias("reason"))
    return K.coverage(grid, played, refused, ["nation", "segment"], "segment")


@query(f"WITH {_COVER} SELECT nation, segment, covered, reason FROM cov")
def coverage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir)


@query(f"""WITH {_COVER} SELECT nation, COUNT(*) FILTER (WHERE covered) AS shipped, COUNT(*) FILTER (WHERE NOT covered AND reason <> 'missing') AS unvalidated, COUNT(*) FILTER (WHERE reason = 'missing') AS missing, BOOL_AND(covered OR reason = 'missing') AS only_missing FROM cov GROUP BY nation""")
def coverage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = F.coalesce(F.col("reason") == "missing", F.lit(False))
    return _coverage(spark, sf_dir).groupBy("nation").agg(
        F.count_if("covered").alias("shipped"), F.count_if(~F.col("covered") & ~missing).alias("unvalidated"), F.count_if(missing).alias("missing"), F.bool_and(F.col("covered") | missing).alias("only_missing")
    )


@query("""SELECT user_id, event_type, event_id, CAST(value AS DOUBLE) AS value FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def shard_merge_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two shards of the table together; the newest row of a user and type stays."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    shards = ev.where("event_id % 2 = 0").unionByName(ev.where("event_id % 2 = 1"))
    return M.last_write_wins(shards, ["user_id", "event_type"], "ts", ["event_id"]).drop("ts")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal ELSE s_acctbal + 1 END AS s_acctbal, CASE WHEN s_suppkey % 3 <> 0 THEN 'added' WHEN s_suppkey % 2 = 0 THEN 'kept' ELSE 'absent' END AS state FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 2 = 0""")
def upsert_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seed file lists the even suppliers anew; those whose key is a multiple of three are there already."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    existing, incoming = rows.where("s_suppkey % 3 = 0"), rows.where("s_suppkey % 2 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 1)
    return M.seeded(existing, incoming, ["s_suppkey"])


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def earliest_per_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.first_per(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query("""WITH t AS (SELECT p_type AS tag, COUNT(*) AS n FROM part GROUP BY 1), r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY n DESC, tag) AS place FROM t)
SELECT tag, n, place FROM r WHERE place <= 12 UNION ALL SELECT 'other tags', COUNT(*), 13 FROM r WHERE place > 12 HAVING COUNT(*) > 0""")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve commonest tags, and the number of other tags. Only the twelve are ordered in one place."""
    tags = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    top = tags.orderBy(F.desc("n"), "tag").limit(12)
    placed = top.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "tag")).cast("long"))
    rest = tags.agg((F.count(F.lit(1)) - 12).alias("n")).where("n > 0").select(F.lit("other tags").alias("tag"), "n", F.lit(13).cast("long").alias("place"))
    return placed.unionByName(rest)


@query("""SELECT p_partkey, TRIM(REGEXP_REPLACE(LOWER(p_name || '_' || p_brand || CASE WHEN p_size % 2 = 0 THEN '_' || p_type ELSE '' END), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part""")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", T.slugify(F.col("p_name"), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("")).alias("slug"))


@query("""SELECT p_partkey, REGEXP_REPLACE(REPLACE(LOWER(p_name || ' & ' || p_type), '&', 'and'), '[^a-z0-9]', '', 'g') AS name FROM part""")
def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.normal_name(F.concat("p_name", F.lit(" & "), "p_type")).alias("name"))


@query("""SELECT doc_id, CAST(LEN(REGEXP_EXTRACT_ALL(text, '([0-9]+)', 1)) AS BIGINT) AS numbers, LIST_LAST(REGEXP_EXTRACT_ALL(text, '([0-9]+)', 1)) AS last FROM documents""")
def regex_extract_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", T.all_numbers(F.col("text")).alias("a"))
    return found.select("doc_id", F.size("a").cast("long").alias("numbers"), F.try_element_at("a", F.lit(-1)).alias("last"))


@query(r"""SELECT page_id, TRY_CAST(NULLIF(REGEXP_EXTRACT('/data/item/' || page_id || CASE WHEN page_id % 3 = 0 THEN '' ELSE '?ns=x' END, '/item/([0-9]+)', 1), '') AS BIGINT) AS item, TRY_CAST(NULLIF(REGEXP_EXTRACT(url, '/p/([0-9]+)', 1), '') AS BIGINT) AS page FROM pages""")
def href_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    href = F.concat(F.lit("/data/item/"), F.col("page_id"), F.when(F.col("page_id") % 3 == 0, "").otherwise("?ns=x"))
    return table(spark, sf_dir, "pages").select("page_id", T.href_id(href, "item").alias("item"), T.href_id(F.col("url"), "p").alias("page"))


@query("""SELECT event_type, COUNT(*) AS n, SUM(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, MAX(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS top, COUNT(*) FILTER (WHERE json_extract_string(props, '$.missing') IS NULL) AS absent FROM events GROUP BY 1""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    absent = F.try_variant_get(F.try_parse_json("props"), "$.missing", "string").isNull()
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.max(k).alias("top"), F.count_if(absent).alias("absent"))


@query(f"""WITH {fights.STEPS}, p AS (SELECT fight, encounter, MAX(n) AS peak, MAX(window_) AS w, MAX(duration) AS d FROM steps JOIN win USING (fight) JOIN (SELECT fight, MAX(duration) AS duration FROM ev GROUP BY fight) USING (fight) GROUP BY ALL),
a AS (SELECT encounter, COUNT(*) AS sample, MEDIAN(peak) AS peak, MIN(peak) AS lo, MAX(peak) AS hi, MIN(ROUND(LEAST(CASE WHEN d > 0 THEN w / d END, 1), 4)) AS cov FROM p GROUP BY encounter),
g AS (SELECT encounter, sample, CASE WHEN encounter % 3 = 0 THEN CAST(encounter % 4 AS DOUBLE) END AS stored, encounter % 2 = 0 AS hand, encounter % 5 = 0 AS fills, peak, CASE WHEN cov IS NULL THEN 'coverage unknown' WHEN cov < 0.95 THEN 'coverage too low' WHEN lo <> hi THEN 'peaks differ' END AS withheld, encounter % 100 / 100.0 >= 0.95 AS constant FROM (SELECT encounter, CASE WHEN encounter % 13 = 0 THEN 2 ELSE sample END AS sample, peak, lo, CASE WHEN encounter % 4 < 2 THEN lo ELSE hi END AS hi, CASE WHEN encounter % 17 = 0 THEN NULL WHEN encounter % 3 < 2 THEN 1.0 ELSE cov END AS cov FROM a))
SELECT encounter, sample, peak, withheld, constant, CASE WHEN stored IS NOT NULL AND hand AND NOT fills THEN 'blocked' WHEN sample < 3 OR withheld IS NOT NULL THEN 'hold' WHEN fills THEN 'eligible' WHEN stored IS NOT NULL THEN 'supersedes' ELSE 'new' END AS state,
  stored IS NOT NULL AND NOT fills AND withheld IS NULL AND stored IS DISTINCT FROM peak AS disagrees FROM g""")
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeworks.operators import intervals as I

    lives = fights.fight_lives(spark, sf_dir)
    until = fights.windows_of(lives)
    peaks = I.concurrency(lives).groupBy("fight").agg(F.max("n").alias("peak"))
    length = lives.groupBy("fight").agg(F.max("duration").alias("duration"))
    pulls = peaks.join(until, "fight").join(length, "fight").withColumn("cov", F.round(F.least(F.when(F.col("duration") > 0, F.col("window") / F.col("duration")), F.when(F.col("duration") > 0, F.lit(1.0))), 4))
    pooled = pulls.groupBy("encounter").agg(F.count(F.lit(1)).alias("sample"), F.median("peak").alias("peak"), F.min("peak").alias("lo"), F.max("peak").alias("hi"), F.min("cov").alias("cov"))
    e = F.col("encounter")  # of some encounters the facts are replaced, so that every case occurs
    coverage = F.when(e % 17 == 0, F.lit(None).cast("double")).when(e % 3 < 2, 1.0).otherwise(F.col("cov"))
    pooled = pooled.withColumn("sample", F.when(e % 13 == 0, 2).otherwise(F.col("sample"))).withColumn("hi", F.when(e % 4 < 2, F.col("lo")).otherwise(F.col("hi")))
    proposal = R.target_count(coverage, F.col("lo"), F.col("peak"), F.col("hi"), e % 100 / 100)
    stored = F.when(F.col("encounter") % 3 == 0, (F.col("encounter") % 4).cast("double"))
    gated = pooled.withColumn("p", proposal).withColumn("g", R.gate(stored, F.col("encounter") % 2 == 0, F.col("encounter") % 5 == 0, F.col("p.value"), F.col("sample"), F.col("p.withheld")))
    return gated.select("encounter", "sample", "peak", "p.withheld", "p.constant", "g.state", "g.disagrees")


@query("""WITH RECURSIVE t AS (SELECT conv_id * 1000 + turn AS n, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS p FROM conversations),
w AS (SELECT n AS node, n AS at_, 0 AS depth FROM t UNION ALL SELECT w.node, t.p, depth + 1 FROM w JOIN t ON t.n = w.at_ WHERE t.p IS NOT NULL)
SELECT node, ARG_MAX(at_, depth) AS root, CAST(MAX(depth) AS BIGINT) AS depth FROM w GROUP BY node""")
def recursive_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's first turn, through the turn before it."""
    node = F.col("conv_id") * 1000 + F.col("turn")
    turns = table(spark, sf_dir, "conversations").select(node.alias("node"), F.when(F.col("turn") > 0, node - 1).alias("parent"))
    return K.owners(turns, "node", "parent")


@query("""WITH r AS (SELECT s_suppkey, ROW_NUMBER() OVER (ORDER BY s_name, s_suppkey) AS position FROM supplier) SELECT s_suppkey, position FROM r WHERE (position - 1) % 4 = 1""")
def shard_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.shard(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), ["s_name", "s_suppkey"], 1, 4).select("s_suppkey", "position")


@query("""SELECT p_partkey, CASE WHEN p_size > 50 THEN NULL WHEN p_retailprice / 1000 >= 1.5 THEN 'far above' WHEN p_retailprice / 1000 >= 1.1 THEN 'above' WHEN p_retailprice / 1000 >= 0.95 THEN 'even' ELSE 'below' END AS label FROM part""")
def bucket_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.when(F.col("p_size") <= 50, F.col("p_retailprice") / 1000)
    return table(spark, sf_dir, "part").select("p_partkey", T.bracketed(ratio, [(1.5, "far above"), (1.1, "above"), (0.95, "even")], "below").alias("label"))


@query("""SELECT s_suppkey, s_acctbal, CASE WHEN s_suppkey % 4 = 0 THEN 'new' ELSE 'old' END AS stamp FROM supplier""")
def settle_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over rows of which a quarter has changed: the others keep their old stamp."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    old = rows.withColumn("s_acctbal", F.when(F.col("s_suppkey") % 4 == 0, F.col("s_acctbal") - 1).otherwise(F.col("s_acctbal"))).withColumn("stamp", F.lit("old"))
    return M.settled(rows.withColumn("stamp", F.lit("new")), old, ["s_suppkey"], ["stamp"])


@query("""SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal WHEN c_custkey % 3 = 1 THEN c_acctbal + 5 END AS measured FROM customer""")
def keep_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new run measured a third of the keys; another third was measured before and isn't lost."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = rows.select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("measured"))
    old = rows.where("c_custkey % 3 = 1").select("c_custkey", (F.col("c_acctbal") + 5).alias("measured"))
    return M.keep_measured(new, old, ["c_custkey"], ["measured"])


@query("""WITH g AS (SELECT s_nationkey AS zone, s_suppkey AS member FROM supplier WHERE s_nationkey < 20), f AS (SELECT DISTINCT l_suppkey AS member FROM lineitem WHERE l_quantity >= 50)
SELECT zone, COUNT(DISTINCT member) AS hits FROM g JOIN f USING (member) GROUP BY zone UNION ALL SELECT NULL, COUNT(*) FROM f WHERE member NOT IN (SELECT member FROM g)""")
def zone_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones by the filed members that they hold; a null zone counts those that no zone holds."""
    groups = table(spark, sf_dir, "supplier").where("s_nationkey < 20").select(F.col("s_nationkey").alias("zone"), F.col("s_suppkey").alias("member"))
    filed = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_suppkey").alias("member")).distinct()
    hits, unplaced = K.overlap_counts(groups, filed, "zone", "member")
    return hits.unionByName(unplaced.agg(F.lit(None).cast("int").alias("zone"), F.count(F.lit(1)).alias("hits")))


TREE = [(k, 1 + k % 3, 4) for k in range(1, 41)]

#: The format in SQL, apart from the codec: the bits of a stream as text, then six of them a letter, lowest first.
_STREAM = f"""bits AS (SELECT p_partkey, picks, '01000000' || reverse(lpad(bin(p_size), 16, '0')) || repeat('0', 128) || list_aggregate(list_transform(range(1, 41), lambda n:
    CASE WHEN (p_partkey + n * n) % 3 <> 0 THEN '0' ELSE '11'
      || CASE WHEN p_partkey % (n % 3 + 1) = n % 3 THEN '0' ELSE '1' || reverse(lpad(bin(1 + p_partkey % (n % 3 + 1)), 6, '0')) END
      || CASE WHEN n % 4 = 0 THEN '0' ELSE '1' || reverse(lpad(bin(n % 4), 2, '0')) END END), 'string_agg', '') AS b FROM parts),
streams AS (SELECT p_partkey, picks, list_aggregate(list_transform(range(0, (length(b) + 5) // 6), lambda k:
    substr('{B.ALPHABET}', 1 + list_sum(list_transform(range(0, 6), lambda j: CASE WHEN substr(b, 6 * k + j + 1, 1) = '1' THEN 1 << j ELSE 0 END))::INT, 1)), 'string_agg', '') AS stream FROM bits)"""


@query(f"""WITH parts AS (SELECT p_partkey, p_size, len(list_filter(range(1, 41), lambda n: (p_partkey + n * n) % 3 = 0)) AS picks FROM part),
{_STREAM} SELECT p_partkey, stream, CAST(picks AS INT) AS n, TRUE AS same FROM streams""")
def talent_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection for every part, written as a bit stream and read back; same tells that nothing was lost."""
    chosen = F.filter(F.sequence(F.lit(1), F.lit(40)), lambda n: (F.col("p_partkey") + n * n) % 3 == 0)
    picks = F.transform(chosen, lambda n: F.struct(n.alias("node"), (F.lit(1) + (F.col("p_partkey") % (n % 3 + 1))).cast("int").alias("rank"), (n % 4).alias("entry")))
    parts = dealt(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("spec")), "p_partkey").withColumn("picks", picks)
    written = parts.withColumn("stream", B.encoded(F.lit(B.VERSION), F.col("spec"), F.col("picks"), TREE))
    read = written.withColumn("d", B.decoded(F.col("stream"), TREE)).withColumn("h", B.header(F.col("stream")))
    same = (F.to_json("d.picks") == F.to_json("picks")) & (F.col("d.spec") == F.col("spec")) & (F.col("h.spec") == F.col("spec")) & (F.col("h.version") == 2)
    return read.select("p_partkey", "stream", F.size("picks").alias("n"), same.alias("same"))


@query(f"""WITH {sweeps.CELLS}, p AS (SELECT build, targets, ROW_NUMBER() OVER (PARTITION BY targets ORDER BY SUM(dps) DESC, build) AS place FROM cells GROUP BY build, targets)
SELECT build, COUNT(*) FILTER (WHERE place <= 10) AS top_places, MIN(place) AS best FROM p GROUP BY build""")
def top_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    summed = sweeps.sweep(spark, sf_dir).groupBy("build", "targets").agg(F.sum("dps").alias("dps"))
    placed = summed.withColumn("place", F.row_number().over(W.partitionBy("targets").orderBy(F.desc("dps"), "build")).cast("long"))
    return placed.groupBy("build").agg(F.count_if(F.col("place") <= 10).alias("top_places"), F.min("place").alias("best"))
