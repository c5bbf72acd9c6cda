"""Items, drops and coverage: who may use what, where it comes from, and whether two accounts of it agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.session import checkpointed


def eligible(stat: Column, allowed: Column) -> Column:
    """An item without a primary stat suits everyone; a build whose stat is unknown (null) suits nothing."""
    return F.when(allowed.isNull(), False).otherwise(stat.isNull() | F.coalesce(F.array_contains(allowed, stat), F.lit(False)))


def in_rotation(derived: Column, is_dungeon: Column, rotation: Column, placed: Column, instance: Column) -> Column:
    """The first that applies: a derived answer of a dungeon item; true without a rotation or for another
    source; true where nothing of the pool is placed; else whether the rotation holds the instance."""
    return (
        F.when(is_dungeon & derived.isNotNull(), derived)
        .when(rotation.isNull() | ~is_dungeon, True)
        .when(~placed, True)
        .otherwise(F.coalesce(F.array_contains(rotation, instance), F.lit(False)))
    )


def first_drop(drops: DataFrame, item: str, rank: Column, walk: list[str], keep: list[str]) -> DataFrame:
    """One drop per item: the best rank (null ranks don't count), then the first of the walk."""
    known = drops.withColumn("_rank", rank).where("_rank IS NOT NULL")
    fields = [F.col(c) for c in keep]
    best = known.groupBy(item).agg(F.min_by(F.struct(*fields), F.struct("_rank", *walk)).alias("_d"))
    return best.select(item, "_d.*")


def reconciled(asserted: DataFrame, derived: DataFrame, key: str, value: str) -> DataFrame:
    """(key, asserted, derived, sources, state) of every asserted row: unresolved without a derived value, agree,
    disagree, or multiple where several values are derived and the asserted one is among them."""
    found = derived.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("derived"))
    met = asserted.select(key, F.col(value).alias("asserted")).join(found, key, "left").withColumn("sources", F.coalesce(F.size("derived"), F.lit(0)))
    held = F.coalesce(F.array_contains("derived", F.col("asserted")), F.lit(False))
    state = F.when(F.col("derived").isNull(), "unresolved").when(held & (F.col("sources") > 1), "multiple").when(held, "agree").otherwise("disagree")
    return met.withColumn("state", state)


def differences(asserted: Column, derived: Column) -> Column:
    """struct(asserted_only, derived_only) of two lists, in their order; both empty where either list is."""
    either = (F.size(asserted) == 0) | (F.size(derived) == 0)
    nothing = F.slice(asserted, 1, 0)
    return F.struct(F.when(either, nothing).otherwise(F.array_except(asserted, derived)).alias("asserted_only"), F.when(either, nothing).otherwise(F.array_except(derived, asserted)).alias("derived_only"))


def best_group(hits: DataFrame, group: str, item: str, kind: str) -> DataFrame:
    """(group, items, state): distinct items per group; the best (then the smallest name) is current, others of
    its kind are companions, the rest legacy."""
    counted = hits.groupBy(group, kind).agg(F.countDistinct(item).alias("items"))
    best = counted.agg(F.min_by(F.struct(group, kind), F.struct(-F.col("items"), group)).alias("b"))
    met = counted.crossJoin(F.broadcast(best))  # one row
    state = F.when(F.col(group) == F.col(f"b.{group}"), "current").when(F.col(kind) == F.col(f"b.{kind}"), "companion").otherwise("legacy")
    return met.select(group, kind, "items", state.alias("state"))


def pool_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): gained, lost or unchanged."""
    a, b = old.select(key).distinct().withColumn("_old", F.lit(True)), new.select(key).distinct().withColumn("_new", F.lit(True))
    change = F.when(F.col("_old").isNull(), "gained").when(F.col("_new").isNull(), "lost").otherwise("unchanged")
    return a.join(b, key, "full").select(key, change.alias("change"))


def coverage(grid: DataFrame, played: DataFrame, refused: DataFrame, keys: list[str], loose: str) -> DataFrame:
    """grid (keys) with covered, and for uncovered cells the reason: a refusal of the very cell comes before one
    that names no `loose` part. refused: keys and reason, `loose` null for any."""
    rest = [k for k in keys if k != loose]
    seen = played.select(*keys).distinct().withColumn("covered", F.lit(True))
    exact = refused.where(F.col(loose).isNotNull()).groupBy(*keys).agg(F.min("reason").alias("exact"))
    any_ = refused.where(F.col(loose).isNull()).groupBy(*rest).agg(F.min("reason").alias("any_reason"))
    met = grid.join(seen, keys, "left").join(exact, keys, "left").join(any_, rest, "left")
    covered = F.coalesce("covered", F.lit(False))
    return met.select(*keys, covered.alias("covered"), F.when(~covered, F.coalesce("exact", "any_reason", F.lit("missing"))).alias("reason"))


def overlap_counts(groups: DataFrame, filed: DataFrame, group: str, member: str) -> tuple[DataFrame, DataFrame]:
    """Groups by how many of the filed members they hold, most first; and the filed members that none holds."""
    met = groups.join(filed.select(member).distinct(), member, "left_semi")
    hits = met.groupBy(group).agg(F.countDistinct(member).alias("hits"))
    return hits.orderBy(F.desc("hits"), group), filed.join(groups, member, "left_anti")


def shard(df: DataFrame, order: list[str], index: int, count: int) -> DataFrame:
    """Every count-th row from index on, in the given order. The order is dealt out by ranges and numbered from
    the ranges' sizes, so no task sees all rows."""
    if not 0 <= index < count:
        raise ValueError(f"shard {index} of {count}")
    return numbered(df, order).where((F.col("position") - 1) % count == index)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds position, 1-based in the given total order. The ranges are written once, so that sizes and rows are of the
    same cut."""
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))  # one row for each partition
    return placed.join(F.broadcast(starts), "_part").withColumn("position", F.col("_before") + F.col("_at") + 1).drop("_id", "_part", "_at", "_before")


#: A parent of at least this share of all rows is met by broadcast; there are 1 / HOT_SHARE of them at most.
HOT_SHARE = 1e-3


def _at_parents(rows: DataFrame, parents: DataFrame, total: int) -> DataFrame:
    """rows joined with parents, a row for each p; rows of hot parents stay where they are."""
    hot = checkpointed(rows.groupBy("p").count().where(F.col("count") >= max(2, int(total * HOT_SHARE))).select("p"))
    if hot.isEmpty():
        return rows.join(parents, "p", "left")
    at_hot = rows.join(F.broadcast(hot), "p", "left_semi").join(F.broadcast(parents.join(F.broadcast(hot), "p", "left_semi")), "p", "left")
    return at_hot.unionByName(rows.join(F.broadcast(hot), "p", "left_anti").join(parents, "p", "left"))


def owners(edges: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root, depth): follows parents to the top, twice as far each round. A parent that is no node itself is a
    root. Nodes of a cycle, and those that lead to one, have no row.

    A node whose parent is a root, or has found its own, is settled and leaves the loop, so a round costs as much as
    there are nodes deeper than its reach. Nodes are unique; the loop ends after log2 of the longest chain.
    """
    rows = edges.select(F.col(node).alias("n"), F.col(parent).alias("p"))
    settled = checkpointed(rows.where("p IS NULL").select("n", F.col("n").alias("root"), F.lit(0).cast("long").alias("depth")))
    inner = checkpointed(rows.where("p IS NOT NULL").withColumn("d", F.lit(1).cast("long")))
    total = inner.count()
    names = inner.select(F.col("n").alias("p"), F.lit(True).alias("is_inner"))
    met = checkpointed(_at_parents(inner, names, total))
    done = met.where("is_inner IS NULL").select("n", F.col("p").alias("root"), F.col("d").alias("depth"))
    found, open_ = checkpointed(done), checkpointed(met.where("is_inner").select("n", "p", "d"))
    reach = 1
    while reach <= total and not open_.isEmpty():
        ahead = found.select(F.col("n").alias("p"), F.col("root").alias("to"), F.col("depth").alias("more"), F.lit(True).alias("at_root"))
        ahead = ahead.union(open_.select(F.col("n").alias("p"), F.col("p").alias("to"), F.col("d").alias("more"), F.lit(False)))
        step = checkpointed(_at_parents(open_, ahead, total))
        ends = step.where("at_root").select("n", F.col("to").alias("root"), (F.col("d") + F.col("more")).alias("depth"))
        found = checkpointed(found.union(ends))
        open_ = checkpointed(step.where("NOT at_root").select("n", F.col("to").alias("p"), (F.col("d") + F.col("more")).alias("d")))
        reach *= 2
    return settled.union(found).select(F.col("n").alias(node), "root", "depth")
