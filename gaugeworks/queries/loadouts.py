"""Queries of talent streams against a trait table.

Every part is an entry of a trait table: its key is the line of the file and the entry's number. Every customer has a
stream, written here as text of bits. The trees are of three classes and 24 nodes; some streams can't be read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.bits import ALPHABET
from gaugeworks.operators import talents as T
from gaugeworks.queries.registry import query
from gaugeworks.session import checkpointed, table

_TRAITS = """raw AS (SELECT p_partkey AS line, p_partkey % 3 AS class, p_partkey * 5 % 24 + 1 AS node, p_partkey AS entry, CAST(1 + p_size % 3 AS INT) AS rank,
  CASE WHEN p_partkey * 5 % 24 + 1 = 24 THEN 4 WHEN p_partkey % 97 = 0 THEN 6 ELSE CAST(1 + (p_partkey * 5 % 24 + 1) % 3 AS INT) END AS tree,
  CAST(31 + p_partkey // 3 % 2 AS INT) AS sub_tree, (p_partkey * 5 % 24 + 1) % 7 = 0 AS tiered, CASE WHEN p_size % 4 = 0 THEN [CAST(1 + p_size // 4 % 5 AS INT)] ELSE CAST([] AS INT[]) END AS specs FROM part),
tr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY class, node ORDER BY line) - 1 AS place FROM raw WHERE tree < 5),
nd AS (SELECT class, node, COUNT(*) AS entries, CASE WHEN BOOL_OR(tiered) THEN SUM(rank) ELSE MIN(rank) FILTER (WHERE place = 0) END AS top FROM tr GROUP BY class, node)"""
_BUILDS = f"""{_TRAITS}, cu AS (SELECT c_custkey AS id, c_custkey % 3 AS class, c_nationkey % 5 + 1 AS spec FROM customer),
pk AS (SELECT id, class, spec, node, entries, top, (id + node) % 4 AS kind, CASE WHEN id % 11 = 0 AND node = 7 THEN 3 ELSE (id + node) % LEAST(entries, 4) END AS choice FROM cu JOIN nd USING (class) WHERE (id * 3 + node * node) % 5 < 2 OR (id % 11 = 0 AND node = 7)),
er AS (SELECT id, CASE WHEN id % 19 = 0 THEN 'unknown letter *' WHEN id % 13 = 0 THEN 'version 3' ELSE bad END AS error FROM cu
  LEFT JOIN (SELECT id, ARG_MIN('node ' || node || ' has no entry ' || choice, node) AS bad FROM pk WHERE kind <> 0 AND choice >= entries GROUP BY id) USING (id)),
sl AS (SELECT pk.id, pk.class, pk.spec, pk.node, CASE kind WHEN 0 THEN 1 WHEN 1 THEN 1 + pk.id % 2 ELSE pk.top END AS ranks, t.entry, t.tree, t.sub_tree, t.specs
  FROM pk JOIN er ON er.id = pk.id AND error IS NULL JOIN tr t ON t.class = pk.class AND t.node = pk.node AND t.place = CASE WHEN kind = 0 THEN 0 ELSE choice END),
ch AS (SELECT id, CASE WHEN COUNT(DISTINCT sub_tree) FILTER (WHERE tree = 4) = 1 THEN MIN(sub_tree) FILTER (WHERE tree = 4) END AS chosen FROM sl GROUP BY id),
vi AS (SELECT id, MIN((node, entry)) AS v FROM sl WHERE tree NOT IN (3, 4) AND len(specs) > 0 AND NOT list_contains(specs, spec) GROUP BY id),
rf AS (SELECT er.id, COALESCE(error, 'Selected node ' || v[1] || ' entry ' || v[2] || ' is not available to player''s spec') AS reason FROM er LEFT JOIN vi USING (id) WHERE error IS NOT NULL OR v IS NOT NULL)"""


def _traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    node = key * 5 % 24 + 1
    tree = F.when(node == 24, 4).when(key % 97 == 0, 6).otherwise(1 + node % 3).cast("int")
    specs = F.when(size % 4 == 0, F.array((1 + F.floor(size / 4) % 5).cast("int"), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(0)))
    rows = table(spark, sf_dir, "part").select(
        key.alias("line"), (key % 3).cast("int").alias("class"), node.cast("int").alias("node"), key.alias("entry"), (1 + size % 3).cast("int").alias("rank"), tree.alias("tree"),
        (31 + F.floor(key / 3) % 2).cast("int").alias("sub_tree"), (node % 7 == 0).alias("tiered"), specs.alias("specs"), F.col("p_name").alias("name"),
    )
    return checkpointed(T.placed_traits(rows, "line"))


def _low_first(number: F.Column, width: int) -> F.Column:
    return F.reverse(F.lpad(F.bin(number), width, "0"))


def _streams(spark: SparkSession, sf_dir: str, traits: DataFrame) -> DataFrame:
    """(id, class, spec, stream): the bits of every customer's picks as text, then six of them a letter."""
    i, n = F.col("id"), F.col("node")
    builds = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3).cast("int").alias("class"), (F.col("c_nationkey") % 5 + 1).alias("spec"))
    met = builds.join(F.broadcast(T.nodes(traits)), "class")  # 72 nodes
    is_odd = (i % 11 == 0) & (n == 7)
    taken = ((i * 3 + n * n) % 5 < 2) | is_odd
    kind, choice = (i + n) % 4, F.when(is_odd, 3).otherwise((i + n) % F.least("entries", F.lit(4)))
    partial = F.when(kind == 1, F.concat(F.lit("1"), _low_first(1 + i % 2, 6))).otherwise("0")
    chosen = F.when(choice > 0, F.concat(F.lit("1"), _low_first(choice, 2))).otherwise("0")
    field = F.when(~taken, "0").when(kind == 0, "10").otherwise(F.concat(F.lit("11"), partial, chosen))
    fields = F.array_sort(F.collect_list(F.struct("node", field.alias("bits"))))["bits"]
    head = F.concat(_low_first(F.when(i % 13 == 0, 3).otherwise(2), 8), _low_first(F.col("spec"), 16), F.lit("0" * 128))
    text = met.groupBy("id", "class", "spec").agg(F.array_join(fields, "").alias("b")).withColumn("b", F.concat(head, "b"))
    letters = F.transform(F.sequence(F.lit(0), F.floor((F.length("b") - 1) / 6).cast("int")), lambda k: F.conv(F.reverse(F.rpad(F.substr(F.col("b"), 6 * k + 1, F.lit(6)), 6, "0")), 2, 10).cast("int"))
    stream = F.array_join(F.transform(letters, lambda v: F.substr(F.lit(ALPHABET), v + 1, F.lit(1))), "")
    return text.select("id", "class", "spec", F.when(i % 19 == 0, F.concat(stream, F.lit("*"))).otherwise(stream).alias("stream"))


def _read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    traits = _traits(spark, sf_dir)
    read = checkpointed(T.read_streams(_streams(spark, sf_dir, traits), traits))
    return read, T.selections(read, traits)


@query(f"""WITH {_BUILDS} SELECT id, CAST(COALESCE(SUM(ranks) FILTER (WHERE tree = 1), 0) AS BIGINT) AS class_points, CAST(COALESCE(SUM(ranks) FILTER (WHERE tree = 2), 0) AS BIGINT) AS spec_points,
  CAST(COALESCE(SUM(ranks) FILTER (WHERE tree = 3 AND (chosen IS NULL OR sub_tree = chosen)), 0) AS BIGINT) AS hero_points, COALESCE(SUM(ranks) FILTER (WHERE tree = 1), 0) < 20 AS thin FROM sl JOIN ch USING (id) GROUP BY id""")
def loadout_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.points(_read(spark, sf_dir)[1], ["id"])


@query(f"WITH {_BUILDS} SELECT id, reason FROM rf")
def loadout_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    read, picks = _read(spark, sf_dir)
    return T.refused(read, picks, ["id"])


@query(f"""WITH {_BUILDS}, w AS (SELECT id, class, spec, chosen FROM (SELECT DISTINCT id, class, spec FROM sl) JOIN ch USING (id)),
b AS (SELECT w.*, reason FROM w LEFT JOIN rf ON rf.id = w.id)
SELECT class, spec, '[' || string_agg('{{"id":' || id || COALESCE(',"subTree":' || chosen, '') || COALESCE(',"hero":"Tree ' || CASE chosen WHEN 31 THEN 'one' END || '"', '') || COALESCE(',"refused":"' || reason || '"', '') || '}}', ',' ORDER BY id) || ']' AS builds FROM b GROUP BY class, spec""")
def spec_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds of every spec as a document; one of the two hero trees has a name."""
    read, picks = _read(spark, sf_dir)
    names = spark.createDataFrame([(31, "Tree one")], "sub_tree int, name string")
    return T.spec_index(picks, names, T.refused(read, picks, ["id"]))


@query(f"""WITH {_TRAITS}, wanted AS (SELECT class, spec, sub_tree FROM range(3) a(class), range(1, 6) b(spec), (VALUES (31), (32), (NULL)) c(sub_tree)),
f AS (SELECT *, FIRST_VALUE(tree) OVER (PARTITION BY class, node ORDER BY place) AS of_tree FROM tr),
s AS (SELECT w.class, w.spec, w.sub_tree, f.node, f.of_tree, f.entry, f.rank, f.tiered, f.place FROM f JOIN wanted w ON w.class = f.class
  WHERE of_tree IN (1, 2) AND (len(specs) = 0 OR list_contains(specs, w.spec)) OR of_tree = 3 AND f.sub_tree = w.sub_tree)
SELECT CAST(class AS INT) AS class, CAST(spec AS INT) AS spec, CAST(sub_tree AS INT) AS sub_tree, node, CAST(of_tree AS INT) AS tree, CAST(CASE WHEN BOOL_OR(tiered) THEN SUM(rank) ELSE ARG_MIN(rank, place) END AS INT) AS max_rank, string_agg(entry, ' ' ORDER BY place) AS entries
FROM s GROUP BY ALL""")
def tree_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What players of each class and spec see, with either hero tree and without one."""
    wanted = spark.createDataFrame([(c, s, t) for c in range(3) for s in range(1, 6) for t in (31, 32, None)], "class int, spec int, sub_tree int")
    return T.layout(_traits(spark, sf_dir), wanted).withColumn("entries", F.array_join("entries", " "))
