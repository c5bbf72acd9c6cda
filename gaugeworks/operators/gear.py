"""Gear and talent sweeps: measured variants into solo gains, best sets, candidates and readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.compare import combined_error, first_two, is_tie


def method(full: int, baseline: int, budget: int = 120) -> str:
    """How a pool of so many combinations is swept."""
    return "exhaustive" if full <= budget else "baseline" if baseline <= budget else "additive"


def solo_gains(variants: DataFrame, keys: list[str], empty: str = "empty") -> DataFrame:
    """(keys, variant, gain, gain_error): each variant over the empty one; missing results are left out."""
    base = variants.where(F.col("variant") == empty).select(*keys, F.col("dps").alias("_b"), F.col("error").alias("_e"))
    met = variants.where(F.col("variant") != empty).join(base, keys)
    return met.select(*keys, "variant", (F.col("dps") - F.col("_b")).alias("gain"), combined_error(F.col("dps"), F.col("error"), F.col("_b"), F.col("_e")).alias("gain_error"))


def best_sets(sets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, items, dps, gap, gap_error, tie): the best measured set of each key, and how far the next is.
    sets: keys, items (array, sorted), dps, error."""
    two = first_two(sets, keys, [F.desc("dps"), F.array_join(F.col("items").cast("array<string>"), "/")], ["items", "dps", "error"])
    a, b = F.col("one"), F.col("two")
    out = two.select(*keys, a["items"].alias("items"), a["dps"].alias("dps"), (a["dps"] - b["dps"]).alias("gap"), combined_error(a["dps"], a["error"], b["dps"], b["error"]).alias("gap_error"))
    return out.withColumn("tie", F.coalesce(is_tie(F.col("gap"), F.col("gap_error")), F.lit(False)))


def candidates(items: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item, replaced, gain, gain_error, tie): an item against the weaker of the worn ones; of equally weak
    ones the first socket. items: keys, item, gain, gain_error. baseline: keys, socket, worn, gain, gain_error."""
    weaker = baseline.groupBy(*keys).agg(F.min_by(F.struct("worn", F.col("gain").alias("_g"), F.col("gain_error").alias("_e")), F.struct("gain", "socket")).alias("w"))
    worn = baseline.select(*keys, F.col("worn").alias("item"))
    met = items.join(worn, [*keys, "item"], "left_anti").join(weaker, keys)
    out = met.select(*keys, "item", F.col("w.worn").alias("replaced"), (F.col("gain") - F.col("w._g")).alias("gain"), F.hypot("gain_error", "w._e").alias("gain_error"))
    return out.withColumn("tie", is_tie(F.col("gain"), F.col("gain_error")))


def best_with(sets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item, dps, items): for each item the best measured set that holds it."""
    each = sets.select(*keys, "dps", "items", F.explode("items").alias("item"))
    order = F.struct("dps", F.array_join(F.col("items").cast("array<string>"), "/"))
    return each.groupBy(*keys, "item").agg(F.max("dps").alias("dps"), F.max_by("items", order).alias("items"))


def drift(sets: DataFrame, solo: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, drift): how far, in percent, the best set lies from what its items' solo gains add up to.
    sets: keys, items, dps, base. solo: keys, item, gain."""
    each = sets.select(*keys, "dps", "base", F.explode("items").alias("item")).join(solo.select(*keys, "item", "gain"), [*keys, "item"])
    return each.groupBy(*keys).agg(F.round((F.max("dps") / (F.max("base") + F.sum("gain")) - 1) * 100, 4).alias("drift"))


def two_winners(variants: DataFrame, keys: list[str], first: str = "dps", second: str = "priority") -> DataFrame:
    """(keys, best, best_priority, disagree): winners by two measures where at least two variants ran; variants
    without the second measure don't compete in it."""
    best = lambda v: F.max_by("variant", F.struct(F.col(v), F.col("variant")))
    known = F.when(F.col(second).isNotNull(), F.struct(second, "variant"))
    out = variants.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), best(first).alias("best"), F.max_by("variant", known).alias("best_priority")).where("n >= 2")
    return out.withColumn("disagree", F.coalesce(F.col("best") != F.col("best_priority"), F.lit(False)))


def contest(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row: median noise, ties, and the most often winning name; of equally frequent ones the first to win.
    rows: winners with noise, decisive and an order in keys."""
    wins = rows.groupBy("winner").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*keys)).alias("first"))
    top = wins.agg(F.min_by("winner", F.struct(-F.col("n"), F.col("first"))).alias(name))
    return rows.agg(F.median("noise").alias("noise"), F.count_if(~F.col("decisive")).alias("ties")).join(F.broadcast(top))  # one row each


def candidate_matrix(gains: DataFrame, item: str, build: str, value: str) -> DataFrame:
    """(item, gains, mean, best): an item's gains by build as a map; builds are few."""
    entry = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(build), F.col(value)))))
    return gains.groupBy(item).agg(entry.alias("gains"), F.avg(value).alias("mean"), F.max(value).alias("best"))
