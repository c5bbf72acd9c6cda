"""A gear sweep of two sockets as two dependent rounds over one frame.

Which branch a group takes is a column, decided by how many combinations its pool has, and a group that fails has an
error row while the others go on. What a variant is worth is asked of `run`, a function from variants to results: it
gets a row for each variant (keys, round, variant, items, level) and returns (keys, variant, dps, error) of those that
were measured. Errors are in percent of the value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.operators.compare import first_two
from gaugeworks.session import checkpointed

#: Combinations that a pool may have to be enumerated, and the sockets.
BUDGET, SOCKETS = 120, 2
EMPTY, STANDARD = "empty", "standard"


@dataclass
class Sweep:
    """baseline: keys, method, combinations, items (in order of their sockets), replaced, dps, error, drift,
    drift_error, reason (null unless the group failed; then the rest may be null). pool: keys, item, gain (alone),
    best_combination, chosen. candidates: keys, item, level, replaces, dps, gain, gain_error. ceilings: keys, level,
    items, dps, gain over the baseline, runner_up (dps), is_baseline."""

    baseline: DataFrame
    pool: DataFrame
    candidates: DataFrame
    ceilings: DataFrame


def wide(rows: DataFrame) -> DataFrame:
    """Rows by item or variant grow with the pools: they are shuffled, whatever the size of the files they come from
    lets Spark expect, and never gathered at the driver to be broadcast. Rows by group are few."""
    return rows.hint("merge")


def combination_counts(farmed: DataFrame, drops: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, farmed, baseline, full): items, their pairs, and all pairs that hold drops of one level too; no item
    is paired with itself. Nothing is enumerated."""
    own = farmed.groupBy(*keys).agg(F.count(F.lit(1)).alias("farmed"))
    met = drops.join(wide(farmed.select(*keys, "item", F.lit(1).alias("both"))), [*keys, "item"], "left")
    by_level = met.groupBy(*keys, "level").agg(F.count(F.lit(1)).alias("c"), F.count("both").alias("twice")).join(own, keys)
    pairs = F.col("farmed") * F.col("c") - F.col("twice") + F.col("c") * (F.col("c") - 1) / 2
    more = by_level.groupBy(*keys).agg(F.sum(pairs.cast("long")).alias("more"))
    baseline = (F.col("farmed") * (F.col("farmed") - 1) / 2).cast("long")
    return own.join(more, keys, "left").select(*keys, "farmed", baseline.alias("baseline"), (baseline + F.coalesce("more", F.lit(0))).alias("full"))


def _pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of offers (keys, item, place) in the order of places, of groups whose combinations the budget bounds."""
    side = lambda rows, x: rows.select(*keys, *(F.col(c).alias(f"{c}_{x}") for c in ("item", "place")))
    return side(a, "a").join(side(b, "b"), keys).where("place_a < place_b AND item_a <> item_b")


def _variant(kind: str, *ids: Column, level: Column | None = None) -> Column:
    key = F.concat(F.lit(f"{kind}:"), F.concat_ws("+", *(i.cast("string") for i in ids)))
    return key if level is None else F.concat(key, F.lit("@"), level.cast("string"))


def gear_sweep(farmed: DataFrame, drops: DataFrame, keys: list[str], run: Callable[[DataFrame], DataFrame], budget: int = BUDGET) -> Sweep:
    """farmed: keys, item, place (the pool's order; both unique). drops: keys, item, level (unique), place, behind all
    places of farmed. Groups without farmed items aren't known.

    Method full enumerates all pairs, baseline only those of farmed items, additive none: then the two items of the
    largest gains alone are worn. Equal values go by the pool's order. Candidates replace the worn item whose gain
    alone is less, in its socket. Ceilings exist for full only.
    """
    counts = checkpointed(combination_counts(farmed, drops, keys))
    method = F.when(F.col("full") <= budget, "full").when(F.col("baseline") <= budget, "baseline").otherwise("additive")
    plan = checkpointed(counts.select(*keys, "farmed", "baseline", "full", method.alias("method")))
    able = plan.where(F.col("farmed") >= SOCKETS)
    own = farmed.join(F.broadcast(able.select(*keys, "method")), keys)  # a row for each group
    no_level = F.lit(None).cast(drops.schema["level"].dataType)

    sets = _pairs(own.where("method <> 'additive'"), own, keys).withColumn("level", no_level)
    whole = able.where("method = 'full'").select(*keys)
    offers = drops.join(whole, keys)
    levels = offers.select(*keys, "level").distinct()
    at_level = _pairs(own.join(levels, keys).unionByName(offers, allowMissingColumns=True), offers, [*keys, "level"])
    sets = sets.unionByName(at_level.select(sets.columns))
    sets = sets.withColumn("items", F.array("item_a", "item_b")).withColumn("variant", F.when(F.col("level").isNull(), _variant("set", F.col("item_a"), F.col("item_b"))).otherwise(_variant("set", F.col("item_a"), F.col("item_b"), level=F.col("level"))))
    sets = checkpointed(sets)
    none = F.array().cast(f"array<{farmed.schema['item'].dataType.simpleString()}>")
    first = able.select(*keys, F.lit(EMPTY).alias("variant"), none.alias("items"), no_level.alias("level"))
    first = first.union(own.select(*keys, _variant("solo", F.col("item")), F.array("item"), no_level)).union(sets.select(*keys, "variant", "items", "level"))
    got = checkpointed(run(first.withColumn("round", F.lit(1))).select(*keys, "variant", "dps", "error"))

    base = got.where(F.col("variant") == EMPTY).select(*keys, F.col("dps").alias("empty_dps"))
    solo = own.withColumn("variant", _variant("solo", F.col("item"))).join(wide(got), [*keys, "variant"]).join(base, keys)
    solo = checkpointed(solo.select(*keys, "item", "place", (F.col("dps") - F.col("empty_dps")).alias("gain")))
    returned = solo.groupBy(*keys).agg(F.count(F.lit(1)).alias("returned"))
    measured = checkpointed(sets.join(wide(got), [*keys, "variant"]))
    order = [F.desc("dps"), "place_a", "place_b"]
    best = first_two(measured.where("level IS NULL"), keys, order, ["items", "dps", "error"]).select(*keys, F.col("one.items").alias("best"), F.col("one.dps").alias("best_dps"), F.col("one.error").alias("best_error"))
    alone = first_two(solo, keys, [F.desc("gain"), "place"], ["item"]).select(*keys, F.array("one.item", "two.item").alias("top"))
    fates = plan.join(base, keys, "left").join(returned, keys, "left").join(best, keys, "left").join(alone, keys, "left")
    enough = F.coalesce("returned", F.lit(0)) >= SOCKETS
    reason = (
        F.when(F.col("farmed") < SOCKETS, F.format_string("only %d eligible items; need %d to form a baseline", "farmed", F.lit(SOCKETS)))
        .when(F.col("empty_dps").isNull(), "no result for the empty reference")
        .when(~enough, F.format_string("only %d of %d pool items returned a result", F.coalesce("returned", F.lit(0)), F.col("farmed")))
    )
    fates = checkpointed(fates.withColumn("reason", reason).withColumn("items", F.when(reason.isNull(), F.coalesce("best", "top"))))

    on = fates.where("reason IS NULL")
    worn = on.select(*keys, F.posexplode("items").alias("socket", "item")).join(wide(solo.select(*keys, "item", "gain")), [*keys, "item"], "left")
    weak = worn.groupBy(*keys).agg(F.min_by(F.struct("socket", "item"), F.struct(F.coalesce("gain", F.lit(0)), "socket")).alias("weak"))
    on = on.join(weak, keys)
    every = drops.select(*keys, "item").distinct().join(F.broadcast(drops.select(*keys, "level").distinct()), keys)  # a row for each level of a group
    swaps = every.join(on.select(*keys, "items", "weak"), keys)
    in_place = F.transform("items", lambda x, i: F.when(i == F.col("weak.socket"), F.col("item")).otherwise(x))
    swaps = swaps.select(*keys, "item", "level", F.col("weak.item").alias("replaces"), in_place.alias("items"), _variant("swap", F.col("item"), level=F.col("level")).alias("variant"))
    second = on.select(*keys, F.lit(STANDARD).alias("variant"), "items", no_level.alias("level")).union(swaps.select(*keys, "variant", "items", "level"))
    again = checkpointed(run(second.withColumn("round", F.lit(2))).select(*keys, "variant", "dps", "error"))
    standard = again.where(F.col("variant") == STANDARD).select(*keys, F.col("dps").alias("std"), F.col("error").alias("std_error"))

    reason = F.coalesce("reason", F.when(F.col("std").isNull(), "no result for the baseline"))
    baseline = fates.join(weak, keys, "left").join(standard, keys, "left")
    baseline = baseline.select(
        *keys, "method", F.when(F.col("method") == "additive", 0).otherwise(F.col("baseline")).alias("combinations"), "items", F.col("weak.item").alias("replaced"), F.col("std").alias("dps"),
        F.col("std_error").alias("error"), (F.col("std") / F.col("best_dps") - 1).alias("drift"), (F.hypot("std_error", "best_error") / 100).alias("drift_error"), reason.alias("reason"),
    )
    candidates = swaps.drop("items").join(wide(again), [*keys, "variant"]).join(standard, keys).select(
        *keys, "item", "level", "replaces", "dps", (F.col("dps") / F.col("std") - 1).alias("gain"), (F.hypot("error", "std_error") / 100).alias("gain_error")
    )
    each = measured.where("level IS NULL").select(*keys, "dps", F.explode("items").alias("item")).groupBy(*keys, "item").agg(F.max("dps").alias("best_combination"))
    kept = on.select(*keys, F.explode("items").alias("item"), F.lit(True).alias("chosen"))
    pool = solo.join(on.select(*keys), keys, "left_semi").join(wide(each), [*keys, "item"], "left").join(kept, [*keys, "item"], "left")
    pool = pool.select(*keys, "item", "gain", "best_combination", F.coalesce("chosen", F.lit(False)).alias("chosen"))
    ranked = measured.where("level IS NULL").drop("level").join(levels, keys).unionByName(measured.where("level IS NOT NULL").select(*measured.columns))
    top = first_two(ranked.withColumn("has_drop", F.startswith("variant", F.lit("set:")) & F.contains("variant", F.lit("@"))), [*keys, "level"], [F.desc("dps"), "has_drop", "place_a", "place_b"], ["items", "dps"])
    ceilings = top.join(on.where("best IS NOT NULL AND method = 'full'").select(*keys, "best", "best_dps"), keys).select(
        *keys, "level", F.col("one.items").alias("items"), F.col("one.dps").alias("dps"), (F.col("one.dps") / F.col("best_dps") - 1).alias("gain"), F.col("two.dps").alias("runner_up"), (F.col("one.items") == F.col("best")).alias("is_baseline")
    )
    return Sweep(baseline, pool, candidates, ceilings)
