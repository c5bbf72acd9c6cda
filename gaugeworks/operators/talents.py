"""Talent trees: streams read against a trait table, layouts, rules, points and names.

A trait table has a row for each entry: class, node, place (its place among the node's entries in the file), entry,
rank (the most it takes), tree, sub_tree, tiered, specs (empty for all) and name. A stream names an entry by its place,
so the order of the file is data.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions import bits

# The numbers of the trees of a trait table, the first that players don't have, and the points below
# which a class tree counts as thin.
CLASS_TREE, SPEC_TREE, HERO_TREE, SELECTION_TREE, FIRST_OTHER = 1, 2, 3, 4, 5
THIN_CLASS_TREE = 20
#: Fixed value: how a selection outside its spec is refused.
NOT_OF_SPEC = "Selected node %d entry %d is not available to player's spec"
#: Nodes of all classes that are sent to the tasks which read streams.
MOST_NODES = 100_000


def placed_traits(rows: DataFrame, at: str) -> DataFrame:
    """rows (class, node, tree, specs and more) of the players' trees, with place: the number of the entry among its
    node's, from 0, in the order of `at`, the line of the file. Zeros among specs are padding and go."""
    mine = rows.where((F.col("tree") >= 0) & (F.col("tree") < FIRST_OTHER))
    place = F.row_number().over(W.partitionBy("class", "node").orderBy(at)) - 1
    return mine.withColumn("place", place).withColumn("specs", F.filter(F.coalesce("specs", F.array().cast("array<int>")), lambda s: s != 0))


def _top(entries: Column) -> Column:
    """The most ranks of a node, from its entries in order: all together if it is tiered, else the first entry's."""
    first = F.get(entries, 0)
    return F.when(first["tiered"], F.aggregate(entries, F.lit(0), lambda a, e: a + e["rank"])).otherwise(first["rank"])


def _in_order(*columns: str) -> Column:
    return F.array_sort(F.collect_list(F.struct("place", *columns)))


def nodes(traits: DataFrame) -> DataFrame:
    """(class, node, top, entries): what a stream's reader has to know of every node; entries is their number."""
    grouped = traits.groupBy("class", "node").agg(_in_order("rank", "tiered").alias("e"))
    return grouped.select("class", "node", _top(F.col("e")).cast("int").alias("top"), F.size("e").alias("entries"))


def layout(traits: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, spec, sub_tree, node, tree, max_rank, entries): the nodes that a player of each wanted (class, spec,
    sub_tree) sees, taken or not. Entries are in the file's order.

    Of a node outside the hero tree only entries without specs, or with the wanted one, are seen; of a hero node only
    those of the wanted sub-tree, none if that is null. The first of all entries tells a node's tree; nodes of the
    selection tree, and of none, aren't seen. A node that loses all its entries isn't either.
    """
    tree = F.first_value("tree").over(W.partitionBy("class", "node").orderBy("place"))
    met = traits.withColumn("tree", tree).where(f"tree NOT IN (0, {SELECTION_TREE})").withColumnRenamed("sub_tree", "_sub").join(F.broadcast(wanted), "class")
    is_open = F.when(F.col("tree") == HERO_TREE, F.col("_sub") == F.col("sub_tree")).otherwise((F.size("specs") == 0) | F.array_contains("specs", F.col("spec")))
    seen = met.where(is_open).groupBy("class", "spec", "sub_tree", "node", "tree").agg(_in_order("entry", "rank", "tiered").alias("e"))
    return seen.select("class", "spec", "sub_tree", "node", "tree", _top(F.col("e")).alias("max_rank"), F.col("e.entry").alias("entries"))


def read_streams(streams: DataFrame, traits: DataFrame) -> DataFrame:
    """(id, class, spec, error, node, rank, place): a row for each pick of each stream (id, class, stream), and one
    without a node for each stream, which has its error if it can't be read; then it has no picks.

    The streams are read by a table function that is joined laterally. It holds the nodes of all classes; a trait
    table of more than MOST_NODES of them is refused.
    """
    rows = nodes(traits).limit(MOST_NODES + 1).collect()
    if len(rows) > MOST_NODES:
        raise ValueError(f"a trait table of more than {MOST_NODES} nodes")
    known: dict[int, list[bits.Node]] = {}
    for r in rows:
        known.setdefault(r["class"], []).append((r["node"], r["top"], r["entries"]))

    class ReadStream:
        def eval(self, of_class: int, text: str) -> Iterator[tuple]:
            got = bits.decode_one(text, known.get(of_class, []))
            yield got["spec"], got["error"], None, None, None
            for p in got["picks"] or []:
                yield got["spec"], None, p["node"], p["rank"], p["entry"]

    read = F.udtf(ReadStream, returnType="spec int, error string, node int, rank int, place int", useArrow=True)
    plain = streams.select("id", F.col("class").cast("int").alias("class"), "stream")
    return plain.lateralJoin(read(F.col("class").outer(), F.col("stream").outer())).drop("stream")


def selections(read: DataFrame, traits: DataFrame) -> DataFrame:
    """(id, class, spec, node, rank, entry, name, tree, sub_tree, specs) of the picks of read_streams()."""
    picks = read.where("node IS NOT NULL").drop("error")
    facts = traits.select("class", "node", "place", "entry", "name", "tree", "sub_tree", "specs")
    return picks.join(facts, ["class", "node", "place"]).drop("place")


def chosen_sub_trees(picks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chosen): the sub-tree that the selection node names; null if several do, or none."""
    named = F.when(F.col("tree") == SELECTION_TREE, F.col("sub_tree"))
    return picks.groupBy(*keys).agg(F.when(F.min(named) == F.max(named), F.min(named)).alias("chosen"))


def points(picks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, class_points, spec_points, hero_points, thin): ranks by tree. Hero nodes lie in several sub-trees; only
    those of the chosen one count, all where none is chosen. picks: keys, tree, sub_tree, rank.

    Ranks are summed by sub-tree, of which a build has few; so the chosen one needs no join."""
    at = lambda t: F.sum(F.when(F.col("tree") == t, F.col("rank")))
    named = F.when(F.col("tree") == SELECTION_TREE, F.col("sub_tree"))
    summed = picks.groupBy(*keys, "sub_tree").agg(at(CLASS_TREE).alias("_class"), at(SPEC_TREE).alias("_spec"), at(HERO_TREE).alias("hero"), F.min(named).alias("_low"), F.max(named).alias("_high"))
    zero = F.lit(0).cast("long")
    whole = summed.groupBy(*keys).agg(
        F.coalesce(F.sum("_class"), zero).alias("class_points"), F.coalesce(F.sum("_spec"), zero).alias("spec_points"), F.when(F.min("_low") == F.max("_high"), F.min("_low")).alias("_chosen"),
        F.collect_list(F.when(F.col("hero").isNotNull(), F.struct("sub_tree", "hero"))).alias("_trees"),
    )
    mine = F.filter("_trees", lambda t: F.col("_chosen").isNull() | (t["sub_tree"] == F.col("_chosen")))
    out = whole.withColumn("hero_points", F.aggregate(mine, zero, lambda a, t: a + t["hero"])).drop("_chosen", "_trees")
    return out.withColumn("thin", F.col("class_points") < THIN_CLASS_TREE)


def violations(picks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, entry): the first selected entry, by node, outside the hero and selection trees whose specs lack
    the spec of the build. picks: keys, spec, node, entry, tree, specs."""
    bad = picks.where(~F.col("tree").isin(HERO_TREE, SELECTION_TREE) & (F.size("specs") > 0) & ~F.array_contains("specs", F.col("spec")))
    return bad.groupBy(*keys).agg(F.min(F.struct("node", "entry")).alias("v")).select(*keys, "v.*")


def refused(read: DataFrame, picks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reason) of the builds that won't load: an error of reading, else the rule that a selection breaks."""
    broken = violations(picks, keys)
    met = read.where("node IS NULL").select(*keys, "error").join(broken, keys, "left")
    reason = F.coalesce("error", F.when(F.col("node").isNotNull(), F.format_string(NOT_OF_SPEC, "node", "entry")))
    return met.select(*keys, reason.alias("reason")).where("reason IS NOT NULL")


def spec_index(picks: DataFrame, names: DataFrame, reasons: DataFrame) -> DataFrame:
    """(class, spec, builds): for each spec its builds by id, each with its hero tree, the tree's name and why it won't
    load; keys without a value are absent from the JSON text. names: sub_tree, name. reasons: id, reason."""
    chosen = chosen_sub_trees(picks, ["id", "class", "spec"])
    trees = names.select(F.col("sub_tree").alias("chosen"), F.col("name").alias("hero"))
    met = chosen.join(trees, "chosen", "left").join(reasons, "id", "left")
    build = F.struct("id", F.col("chosen").alias("subTree"), "hero", F.col("reason").alias("refused"))
    grouped = met.groupBy("class", "spec").agg(F.array_sort(F.collect_list(build)).alias("b"))
    return grouped.select("class", "spec", F.to_json("b", {"ignoreNullFields": "true"}).alias("builds"))


def hero_names(builds: DataFrame, trees: DataFrame, overrides: DataFrame) -> DataFrame:
    """builds (id, sub_tree) with hero, and why it isn't known: an override of the id, else the tree's name."""
    met = builds.join(trees.select(F.col("sub_tree"), F.col("name").alias("_tree")), "sub_tree", "left").join(overrides.select("id", F.col("name").alias("_own")), "id", "left")
    hero = F.coalesce("_own", "_tree")
    reason = F.when(hero.isNotNull(), F.lit(None).cast("string")).when(F.col("sub_tree").isNull(), "no hero tree").otherwise("unnamed hero tree")
    return met.select("id", "sub_tree", hero.alias("hero"), reason.alias("unresolved"), (F.col("_own") != F.col("_tree")).alias("renamed"))


def tree_of_key(key):
    """The sub-tree number after the last - of a build's key; null if there is none."""
    return F.try_to_number(F.nullif(F.regexp_extract(key, "-([0-9]+)$", 1), F.lit("")), F.lit("9999999999")).cast("long")
