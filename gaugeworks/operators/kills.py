"""Ranked and searched kills: which fights count, how far a search went, which are taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.merge import first_per

#: 2000-01-01 in milliseconds; a time before it is a report-relative one that lost its report.
YEAR_2000_MS = 946_684_800_000
DAY_MS = 86_400_000


def kill_time(report_start: Column, start: Column) -> Column:
    """Absolute milliseconds of a fight whose time counts from its report; null if that isn't a real date."""
    at = (F.try_to_number(report_start.cast("string"), F.lit("9999999999999")) + F.try_to_number(start.cast("string"), F.lit("9999999999999"))).cast("long")
    return F.when(at >= YEAR_2000_MS, at)


def is_kill(encounter: Column, wanted: Column, killed: Column, difficulty: Column, wanted_difficulty: Column, at: Column) -> Column:
    """The wanted encounter, killed, at the wanted difficulty or an unrecorded one, at a real time."""
    right = difficulty.isNull() | (difficulty == wanted_difficulty)
    return F.coalesce((encounter == wanted) & killed & right & at.isNotNull(), F.lit(False))


def search_window(anchor: Column, now: Column, before: int = 10, after: int = 14) -> Column:
    """struct(from, to) in milliseconds around the first known kill; all time until now without one."""
    start = F.when(anchor > 0, F.greatest(anchor - before * DAY_MS, F.lit(0))).otherwise(F.lit(0))
    return F.struct(start.cast("long").alias("from"), F.when(anchor > 0, anchor + after * DAY_MS).otherwise(now).cast("long").alias("to"))


def earliest_kills(kills: DataFrame, most: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """One kill per report, its earliest; of these the `most` earliest (of each key), by time and code."""
    one = first_per(kills, [*keys, "code"], ["at", "fight"], ["at", "fight"])
    if not keys:
        return one.orderBy("at", "code").limit(most)
    from pyspark.sql import Window as W

    return one.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("at", "code"))).where(F.col("_n") <= most).drop("_n")


def report_fights(rankings: DataFrame, order: str, top: bool = False) -> DataFrame:
    """The first-seen fight of each report; then by start, unknown starts (0) last, or as they came if top."""
    one = first_per(rankings, ["code"], [order], ["fight", "start", order])
    return one.orderBy(order) if top else one.orderBy(F.col("start") == 0, "start", "code")


def kill_span(kills: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first, last, days): the time over which kills were seen; 0 is an unknown time."""
    known = F.when(F.col("at") > 0, F.col("at"))
    days = F.round((F.max(known) - F.min(known)) / DAY_MS, 1)
    return kills.groupBy(*keys).agg(F.min(known).alias("first"), F.max(known).alias("last"), days.alias("days"))


def difficulties(kills: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by difficulty; an unrecorded one is a group of its own."""
    return kills.groupBy(*keys, "difficulty").agg(F.count(F.lit(1)).alias("n"))
