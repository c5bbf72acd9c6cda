"""Measurements of a parameter sweep: one cell per (build, scenario, targets), and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.operators.selection import order_statistics

CELL = ["build", "scenario", "targets"]


def priority_share() -> Column:
    return F.try_divide("priority", "dps")


def concentration() -> Column:
    """Share of the priority target times the number of targets; undefined for one target."""
    return F.when(F.col("targets") > 1, priority_share() * F.col("targets"))


def with_baseline_gain(cells: DataFrame, baseline: Column | str = "scenario", at: int = 1) -> DataFrame:
    """Adds base_dps and funnel_gain: priority over the dps that the same build has at `at` targets of its
    baseline scenario (by default its own). Null where there is no baseline, or it isn't above 0."""
    base = cells.where((F.col("targets") == at) & (F.col("dps") > 0))
    base = base.select(F.col("build").alias("b_build"), F.col("scenario").alias("b_scenario"), F.col("dps").alias("base_dps"))
    cells = cells.withColumn("_base", F.col(baseline) if isinstance(baseline, str) else baseline)
    met = cells.join(base, (F.col("build") == F.col("b_build")) & (F.col("_base") == F.col("b_scenario")), "left")
    return met.drop("b_build", "b_scenario", "_base").withColumn("funnel_gain", F.try_divide("priority", "base_dps"))


def indexed(cells: DataFrame, value: str = "dps", at: int = 1) -> DataFrame:
    """Adds indexed: the value over that of the same build and scenario at `at` targets."""
    first = F.max(F.when(F.col("targets") == at, F.col(value))).over(W.partitionBy("build", "scenario"))
    return cells.withColumn("indexed", F.when(first > 0, F.col(value) / first))


def summary(cells: DataFrame, targets: tuple[int, ...], value: str = "dps") -> DataFrame:
    """One row per build and scenario, a column for each number of targets."""
    at = [F.max(F.when(F.col("targets") == n, F.col(value))).alias(f"{value}_{n}") for n in targets]
    return cells.groupBy("build", "scenario").agg(*at)


def top_with_other(df: DataFrame, keys: list[str], name: str, amount: str, k: int, least_share: float = 0.001) -> DataFrame:
    """(keys, rank, name, amount, share): amounts summed by name, the k largest of each group, and what is left
    as "Other" where it is over `least_share` of the group's total. Equal amounts go by name.

    Each task passes on its k largest of a group at most, and the rest is the total less the k largest."""
    sums = df.groupBy(*keys, name).agg(F.sum(amount).alias("amount")).where(F.col("amount") > 0)
    totals = sums.groupBy(*keys).agg(F.sum("amount").alias("all"), F.count(F.lit(1)).alias("names"))
    order = W.partitionBy(*keys).orderBy(F.desc("amount"), name)
    top = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = top.join(totals, keys).select(*keys, "rank", F.col(name).alias("name"), "amount", "all")
    held = top.groupBy(*keys).agg(F.sum("amount").alias("held"))
    rest = totals.where(F.col("names") > k).join(held, keys)
    other = rest.select(*keys, F.lit(k + 1).alias("rank"), F.lit("Other").alias("name"), (F.col("all") - F.col("held")).alias("amount"), "all")
    share = F.col("amount").cast("double") / F.col("all").cast("double")
    return named.union(other).withColumn("share", share).where((F.col("rank") <= k) | (F.col("share") > least_share)).drop("all")


def rolling_burst(series: DataFrame, keys: list[str], at: str, value: str, span: int, width: int = 20) -> DataFrame:
    """(keys, n, burst): the largest mean of `width` consecutive positions over the mean of all `span` of them, from 0;
    null if there are fewer, or for a mean that isn't above 0. A position without a row has the value 0.

    The sum of a window changes only where a value enters it, or leaves it `width` later: it is the running sum of both
    kinds of changes, and is looked at there and at the end of the first whole window, so that positions without values
    cost nothing. Decimal sums are exact. Rows without a position or outside the span go.
    """
    known = series.where(F.col(at).between(0, span - 1)).select(*keys, F.col(at).alias("_at"), F.coalesce(value, F.lit(0)).alias("_v"))
    moves = known.union(known.select(*keys, F.col("_at") + width, -F.col("_v"))).groupBy(*keys, "_at").agg(F.sum("_v").alias("_v"))
    order = W.partitionBy(*keys).orderBy("_at")
    running = moves.withColumn("_s", F.sum("_v").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("_next", F.lead("_at").over(order))
    # the last change at or before the end of the first window tells that window's sum
    is_whole = (F.col("_at") < span) & (F.coalesce("_next", F.lit(span)) > width - 1)
    started = F.when(F.min("_at") > width - 1, F.lit(0))  # then the first window is empty
    sums = running.groupBy(*keys).agg(F.greatest(F.max(F.when(is_whole, F.col("_s"))), started).alias("_most"))
    totals = known.groupBy(*keys).agg(F.sum("_v").alias("_all"))
    mean = F.col("_all").cast("double") / span
    burst = F.when((F.lit(span) >= width) & (mean > 0), F.col("_most").cast("double") / width / mean)
    return totals.join(sums, keys).select(*keys, F.lit(span).cast("long").alias("n"), burst.alias("burst"))


def binned(series: DataFrame, keys: list[str], at: str, value: str, span: int, width: int) -> DataFrame:
    """(keys, bin, mean): means of consecutive chunks of `width` of `span` positions, from 0; the last may be short. A
    position without a row has the value 0, and so has the mean of a bin without any."""
    known = series.where(F.col(at).between(0, span - 1))
    sums = known.groupBy(*keys, F.floor(F.col(at) / width).cast("long").alias("bin")).agg(F.sum(value).alias("_v"))
    bins = known.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((span - 1) // width).cast("long"))))
    length = F.least(F.lit(width), F.lit(span) - F.col("bin") * width)
    return bins.join(sums, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce(F.col("_v").cast("double") / length, F.lit(0.0)).alias("mean"))


def context_median(cells: DataFrame, value: str = "dps") -> DataFrame:
    """Median over builds at each number of targets, with the lowest and highest."""
    return order_statistics(cells, ["targets"], value, {"median": 0.5}).select("targets", "median", "low", "high")
