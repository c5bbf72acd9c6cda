"""Exact order statistics of groups of any size, without a group's values in one task.

Groups of at most LARGE values are left to Spark's percentile. Of larger ones the distinct values are counted, which
spreads a group over all tasks, and the interval that holds a wanted rank is narrowed round by round: approximate
quantiles of its distinct values part it into BINS bins, the exact counts of the bins say in which the rank lies, and
that bin is the next interval, of some 1 / BINS of the values. Approximation only decides where bins end, so results
are exact. The last interval of LARGE distinct values at most is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.session import checkpointed

LARGE, BINS, FEW_GROUPS = 10_000, 64, 10_000

#: Instead of a share: the element just above the middle of an even count.
UPPER_MEDIAN = "upper"


def _ranks(n: Column, share: float | str) -> tuple[Column, Column, Column]:
    """The two neighbouring ranks, from 0, of a share of n values, and the weight of the upper one."""
    if share == UPPER_MEDIAN:
        middle = F.floor(n / 2)
        return middle, middle, F.lit(0.0)
    place = (n - 1) * F.lit(float(share))
    return F.floor(place), F.ceil(place), place - F.floor(place)


def _narrowed(counted: DataFrame, wanted: DataFrame, keys: list[str], large: int) -> DataFrame:
    """wanted (keys, share, r0, r1, lo, hi, below) until no interval holds more than `large` distinct values."""
    by = [*keys, "share"]
    while True:
        inside = _inside(counted, wanted, keys)
        cuts = inside.groupBy(*by).agg(F.percentile_approx("v", [k / BINS for k in range(1, BINS)], 20 * BINS).alias("cuts"))
        binned = inside.join(_small(cuts), by).withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("v"))))
        bins = binned.groupBy(*by, "bin").agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("values"))
        order = W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # BINS rows at most
        ranked = bins.withColumn("before", F.coalesce(F.sum("c").over(order), F.lit(0)))
        met = ranked.join(_small(wanted.select(*by, "r0", "r1", "weight", "below")), by)
        first, end = F.col("below") + F.col("before"), F.col("below") + F.col("before") + F.col("c")
        held = met.where(((F.col("r0") >= first) & (F.col("r0") < end)) | ((F.col("r1") >= first) & (F.col("r1") < end)))
        wanted = held.groupBy(*by, "r0", "r1", "weight").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(first).alias("below"), F.sum("values").alias("values"))
        wanted = checkpointed(wanted)
        # ranks in two bins that aren't neighbours have no value between them; two values are the least that can stay
        if wanted.agg(F.max("values")).first()[0] <= max(large, 2):
            return wanted


def _small(groups: DataFrame) -> DataFrame:
    """A row for each large group and share: broadcast if there are few, counted; else shuffled."""
    few = groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    return F.broadcast(groups) if few else groups


def _inside(counted: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    met = counted.join(_small(wanted.select(*keys, "share", "lo", "hi")), keys)
    return met.where("v >= lo AND v <= hi").select(*keys, "share", "v", "c")


def order_statistics(df: DataFrame, keys: list[str], value: str, shares: dict[str, float | str], large: int = LARGE) -> DataFrame:
    """(keys, n, low, high and a column for each of shares) of the non-null values of each group.

    A share from 0 to 1 is interpolated between its two nearest ranks; UPPER_MEDIAN takes the element above the middle.
    Groups without a value have no row; a null key is a key like others, and keys may be none at all. Equal values
    count as often as they come; NaN is larger than any other number.
    """
    by = [f"_key{k}" for k in range(len(keys))] + ["_all"]
    rows = df.where(F.col(value).isNotNull()).select(*(F.col(k).alias(b) for k, b in zip(keys, by, strict=False)), F.lit(0).alias("_all"), F.col(value).alias("v"))
    # null keys must meet in joins: a key is joined by its text, whose null has a text of its own
    rows = rows.withColumn("_group", F.to_json(F.struct(*by), {"ignoreNullFields": "false"}))
    rows = checkpointed(rows.select("_group", *by, "v"))
    sizes = checkpointed(rows.groupBy("_group", *by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    hot = sizes.where(F.col("n") > large)
    is_hot = not hot.isEmpty()
    few = rows.join(_small(hot.select("_group")), "_group", "left_anti") if is_hot else rows

    def of(name: str, share: float | str) -> Column:
        if share == UPPER_MEDIAN:
            values = F.array_sort(F.collect_list("v"))  # `large` at most
            return F.get(values, F.floor(F.size(values) / 2).cast("int")).cast("double").alias(name)
        return F.percentile("v", F.lit(float(share))).alias(name)

    out = few.groupBy("_group").agg(*[of(name, share) for name, share in shares.items()])
    if is_hot:
        counted = checkpointed(rows.join(_small(hot.select("_group")), "_group", "left_semi").groupBy("_group", "v").agg(F.count(F.lit(1)).alias("c")))
        parts = []
        for name, share in shares.items():
            r0, r1, weight = _ranks(F.col("n"), share)
            parts.append(F.struct(F.lit(name).alias("share"), r0.cast("long").alias("r0"), r1.cast("long").alias("r1"), weight.alias("weight")))
        wanted = hot.select("_group", F.col("low").alias("lo"), F.col("high").alias("hi"), F.explode(F.array(*parts)).alias("w"))
        wanted = checkpointed(wanted.select("_group", "w.*", "lo", "hi", F.lit(0).cast("long").alias("below")))
        wanted = _narrowed(counted, wanted, ["_group"], large)
        order = W.partitionBy("_group", "share").orderBy("v").rowsBetween(W.unboundedPreceding, 0)  # `large` values at most
        last = _inside(counted, wanted, ["_group"]).withColumn("upto", F.sum("c").over(order))
        last = last.join(_small(wanted.select("_group", "share", "r0", "r1", "weight", "below")), ["_group", "share"])
        at = lambda r: F.min(F.when(F.col("below") + F.col("upto") > F.col(r), F.col("v")))
        picked = last.groupBy("_group", "share", "weight").agg(at("r0").cast("double").alias("v0"), at("r1").cast("double").alias("v1"))
        between = F.when(F.col("v0") == F.col("v1"), F.col("v0")).otherwise((1 - F.col("weight")) * F.col("v0") + F.col("weight") * F.col("v1"))
        picked = picked.select("_group", "share", between.alias("q"))
        wide = picked.groupBy("_group").agg(*[F.max(F.when(F.col("share") == name, F.col("q"))).alias(name) for name in shares])
        out = out.unionByName(wide)
    met = sizes.join(out, "_group")
    return met.select(*(F.col(b).alias(k) for k, b in zip(keys, by, strict=False)), "n", "low", "high", *shares)


def spreads(df: DataFrame, keys: list[str], value: str, places: int = 3) -> DataFrame:
    """(keys, median, low, high, n), rounded, of the non-null values of each group."""
    out = order_statistics(df, keys, value, {"median": 0.5})
    return out.select(*keys, *(F.round(c, places).alias(c) for c in ("median", "low", "high")), "n")


def ranking_summary(df: DataFrame, keys: list[str], value: str, least: int = 5, tail_least: int = 20, places: int = 1) -> DataFrame:
    """n, median, p95 and top of groups of `least` values or more; p95 only from `tail_least` on."""
    out = order_statistics(df, keys, value, {"median": 0.5, "p95": 0.95}).where(F.col("n") >= least)
    tail = F.when(F.col("n") >= tail_least, F.round("p95", places)).alias("p95")
    return out.select(*keys, "n", F.round("median", places).alias("median"), tail, F.round("high", places).alias("top"))
