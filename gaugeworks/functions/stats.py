"""Statistics as columns and grouped frames. Undefined readings are null; they never raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def interpolated(value: Column | str, share: float) -> Column:
    """Percentile with linear interpolation between the two nearest ranks; null for no values."""
    return F.percentile(value, F.lit(share))


def spread(value: Column | str, places: int = 3) -> Column:
    """struct(median, low, high, n) of the non-null values; null if there are none."""
    value = F.col(value) if isinstance(value, str) else value
    n = F.count(value)
    parts = [F.round(f, places).alias(name) for f, name in ((F.median(value), "median"), (F.min(value), "low"), (F.max(value), "high"))]
    return F.when(n > 0, F.struct(*parts, n.alias("n")))


def upper_median(value: Column | str) -> Column:
    """The element just above the middle of an even count; no interpolation."""
    values = F.array_sort(F.collect_list(value))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def mode_high(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value of each group; of equally frequent ones the largest."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("n", value)).alias("mode"), F.max("n").alias("n"))


def average_rank(partition: list[str], value: str) -> Column:
    """1-based ascending rank; equal values share the mean of their ranks."""
    ahead = F.rank().over(W.partitionBy(*partition).orderBy(value))
    same = F.count(F.lit(1)).over(W.partitionBy(*partition, value))
    return ahead.cast("double") + (same - 1).cast("double") / F.lit(2.0)


def guarded_corr(x: str, y: str, least: int = 3) -> Column:
    """Pearson correlation of the complete pairs; null below `least` pairs or where a side has no spread."""
    a = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(x).cast("double"))
    b = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(y).cast("double"))
    defined = (F.count(a) >= least) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
    return F.when(defined, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def rank_agreement(df: DataFrame, keys: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Spearman's rho of each group: the correlation of average ranks."""
    ranked = df.select(*keys, average_rank(keys, x).alias("rx"), average_rank(keys, y).alias("ry"))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), guarded_corr("rx", "ry", least).alias("rho"))


def variance_explained(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: 1 - variance of the distances from the group medians / variance of all; null without variance."""
    medians = df.groupBy(group).agg(F.median(value).alias("mid"))
    met = df.join(medians, group).where(F.col(value).isNotNull())
    ratio = F.try_divide(F.var_pop(F.col(value) - F.col("mid")), F.var_pop(value))
    return met.agg(F.when((F.count(value) >= 2) & (F.var_pop(value) > 0), 1 - ratio).alias("explained"))
