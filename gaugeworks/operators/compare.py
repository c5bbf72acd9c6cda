"""Variants against each other: winners, ties inside the noise, gains, combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def combined_error(value_a: Column, error_a: Column, value_b: Column, error_b: Column) -> Column:
    """Absolute error of a difference: percent errors of both sides, as amounts, added in quadrature."""
    return F.hypot(value_a * error_a / 100, value_b * error_b / 100)


def is_tie(gain: Column, error: Column) -> Column:
    """A gap that isn't over its error is a tie; so is one that equals it."""
    return F.abs(gain) <= error


def first_two(df: DataFrame, keys: list[str], order: list, columns: list[str]) -> DataFrame:
    """(keys, one, two): structs of `columns` of the first and second row of each group; two is null for a lone row.

    The filter by rank stands straight on its window, so that each task passes on two rows of a group at most."""
    top = df.select(*keys, *columns, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).alias("_n")).where("_n <= 2")
    at = lambda n: F.max(F.when(F.col("_n") == n, F.struct(*columns)))
    return top.groupBy(*keys).agg(at(1).alias("one"), at(2).alias("two"))


def winner_and_runner_up(df: DataFrame, keys: list[str], name: str, value: str, error: str) -> DataFrame:
    """(keys, winner, runner_up, margin, noise, decisive): the two largest values of each group; equal values go
    by name. error is in percent of the value. A lone entry wins without a margin and isn't decisive."""
    two = first_two(df, keys, [F.desc(value), name], [name, value, error])
    a, b = F.col("one"), F.col("two")
    out = two.select(
        *keys, a[name].alias("winner"), b[name].alias("runner_up"), (a[value] - b[value]).alias("margin"), combined_error(a[value], a[error], b[value], b[error]).alias("noise")
    )
    return out.withColumn("decisive", F.coalesce(F.col("margin") > F.col("noise"), F.lit(False)))


def lead_changes(won: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, first_winner, changed_at, next_winner): the first decisive winner along `at`, and the first
    decisive row that another wins; null where that never comes."""
    sure = won.where("decisive")
    first = F.min_by("winner", at).over(W.partitionBy(*keys))
    tagged = sure.withColumn("first_winner", first)
    other = F.when(F.col("winner") != F.col("first_winner"), F.col(at))
    return tagged.groupBy(*keys).agg(
        F.first("first_winner").alias("first_winner"), F.min(other).alias("changed_at"), F.min_by("winner", other).alias("next_winner")
    )


def pairs_of(items: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Unordered pairs of different items of a group, as <column>_a and <column>_b. Meant for pools whose size
    the sweep's budget bounds."""
    a = items.select(*keys, *[F.col(c).alias(f"{c}_a") for c in columns])
    b = items.select(*keys, *[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(b, keys).where(F.col(f"{order}_a") < F.col(f"{order}_b"))


def best_by(df: DataFrame, keys: list[str], value: str, ties: list[str], keep: list[str]) -> DataFrame:
    """The row of each group with the largest value; of equal ones that whose tie columns sort first."""
    order = W.partitionBy(*keys).orderBy(F.desc(value), *ties)
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*keys, *keep)


def set_key(*ids: Column) -> Column:
    """One text for a set of ids, whatever their order."""
    return F.array_join(F.sort_array(F.array(*ids)).cast("array<string>"), "/")


def effects(runs: DataFrame, keys: list[str], variant: str, value: str, steps: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per group with a gain for each named step (variant with, variant without): with / without - 1,
    rounded to 5 places; null where a side is missing or the base isn't above 0."""
    at = lambda v: F.max(F.when(F.col(variant) == v, F.col(value)))
    gain = lambda a, b: F.when(b > 0, F.round(a / b - 1, 5))
    return runs.groupBy(*keys).agg(*[gain(at(a), at(b)).alias(name) for name, (a, b) in steps.items()])


def either_top(df: DataFrame, keys: list[str], first: str, second: str, name: str, k: int) -> DataFrame:
    """Rows among the k best of a group by either measure, with both ranks, in the order of the first."""
    per = W.partitionBy(*keys)
    ranked = df.withColumn("rank_a", F.row_number().over(per.orderBy(F.desc(first), name))).withColumn("rank_b", F.row_number().over(per.orderBy(F.desc(second), name)))
    return ranked.where((F.col("rank_a") <= k) | (F.col("rank_b") <= k))
