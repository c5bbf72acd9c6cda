"""Shards of published rows brought together, without losing what was measured before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_write_wins(rows: DataFrame, keys: list[str], stamp: str, ties: list[str]) -> DataFrame:
    """The newest row of each key; a null stamp is older than any, equal stamps go to the largest tie columns.
    One aggregation, so a hot key is reduced before it is shuffled."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(stamp, *ties)).alias("_row"))
    return newest.select(*keys, "_row.*")


def first_per(rows: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*")


def seeded(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """existing as it is, and the incoming rows whose key it lacks; state tells which: kept, added, or absent
    (kept, but no longer incoming)."""
    here = incoming.select(*keys).distinct().withColumn("_in", F.lit(True))
    old = existing.join(here, keys, "left").withColumn("state", F.when(F.col("_in"), "kept").otherwise("absent")).drop("_in")
    new = incoming.join(existing.select(*keys), keys, "left_anti").withColumn("state", F.lit("added"))
    return old.unionByName(new)


def moved(target: DataFrame, source: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(target with the rows of source that collide with none of its keys, the rows that stay behind)."""
    goes = source.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(goes), source.join(target.select(*keys), keys, "left_semi")


def keep_measured(new: DataFrame, old: DataFrame, keys: list[str], measured: list[str]) -> DataFrame:
    """new, with the measured columns of old where new has none."""
    before = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in measured])
    met = new.join(before, keys, "left")
    return met.select(*[F.coalesce(c, f"_old_{c}").alias(c) if c in measured else F.col(c) for c in new.columns])


def content_hash(df: DataFrame, stamps: list[str]) -> Column:
    """A hash of a row's content in the order of its column names; stamps don't count, nulls count as absent."""
    return F.xxhash64(F.to_json(F.struct(*sorted(c for c in df.columns if c not in stamps))))


def settled(new: DataFrame, old: DataFrame, keys: list[str], stamps: list[str]) -> DataFrame:
    """new, with the old stamps on rows whose content hasn't changed, so that a run over the same input writes
    the same rows."""
    before = old.select(*keys, content_hash(old, stamps).alias("_hash"), *[F.col(c).alias(f"_old_{c}") for c in stamps])
    met = new.withColumn("_now", content_hash(new, stamps)).join(before, keys, "left")
    same = F.coalesce(F.col("_now") == F.col("_hash"), F.lit(False))
    return met.select(*[F.when(same, F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) if c in stamps else F.col(c) for c in new.columns])


def resumed(previous: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """All keys of either side; fresh values come before previous ones."""
    rest = [c for c in fresh.columns if c not in keys]
    a, b = fresh.withColumn("_f", F.lit(True)), previous.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in rest])
    met = a.join(b, keys, "full")
    return met.select(*keys, *[F.when(F.col("_f"), F.col(c)).otherwise(F.col(f"_p_{c}")).alias(c) for c in rest])


def complete(fights: Column, wanted: Column, exhausted: Column, budget: Column, new_budget: Column, order: Column, new_order: Column) -> Column:
    """Whether a finished probe need not be run again: enough fights or nothing more to find, by no smaller a
    budget and in the same order (either may be unrecorded)."""
    enough = (fights >= wanted) | F.coalesce(exhausted, F.lit(False))
    return enough & (budget.isNull() | (budget >= new_budget)) & (order.isNull() | (order == new_order))


def adorned(items: DataFrame, adornments: DataFrame, keys: list[str], worn: list[str]) -> DataFrame:
    """items as a profile wears them: where it adorns the socket, all of `worn` (gems, enchant) are the profile's, nulls
    too; a bare socket, with none of them, or an unknown one leaves an item as it is."""
    plain = adornments.where(" OR ".join(f"{c} IS NOT NULL" for c in worn)).select(*keys, F.struct(*worn).alias("_worn"))
    met = items.join(plain, keys, "left")
    return met.select(*(F.when(F.col("_worn").isNotNull(), F.col(f"_worn.{c}")).otherwise(F.col(c)).alias(c) if c in worn else F.col(c) for c in items.columns))


def rebuilt(derived: DataFrame, previous: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """derived items with the hand-written columns of their predecessors; what has none gets nulls. Items that aren't
    derived any more go, and so does every other column of previous. A predecessor that repeats is taken once, the
    last by its values."""
    before = previous.groupBy(*keys).agg(F.max(F.struct(*carried)).alias("_was"))
    met = derived.select(*(c for c in derived.columns if c not in carried)).join(before, keys, "left")
    return met.select("*", *(F.col(f"_was.{c}").alias(c) for c in carried)).drop("_was")
