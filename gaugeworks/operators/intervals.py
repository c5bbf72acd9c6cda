"""Intervals out of event streams: lives, concurrency, paired windows, phases.

Columns: fight (any type), t (seconds from the fight's start), duration (seconds). All work is windows and
grouped aggregates; a fight's events share a partition, never a driver loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.operators.compare import first_two


def lives(hits: DataFrame, deaths: DataFrame) -> DataFrame:
    """(fight, actor, instance, first, last, died, total) of every entity that was hit.

    hits: fight, t, actor, instance, amount, duration. deaths: fight, t, actor, instance, source_actor,
    source_instance; a death without a target counts for its source. The earliest death ends a life, even after
    the fight's end; without one the last hit does, no later than the fight's end. No life ends before it began.
    """
    key = ["fight", "actor", "instance"]
    hit = hits.withColumn("instance", F.coalesce("instance", F.lit(0))).groupBy(*key).agg(
        F.min("t").alias("first"), F.max("t").alias("_last"), F.sum("amount").alias("total"), F.max("duration").alias("duration")
    )
    has = F.col("actor").isNotNull()
    dead = deaths.select(
        "fight",
        "t",
        F.when(has, F.col("actor")).otherwise(F.col("source_actor")).alias("actor"),
        F.coalesce(F.when(has, F.col("instance")).otherwise(F.col("source_instance")), F.lit(0)).alias("instance"),
    )
    met = hit.join(dead.groupBy(*key).agg(F.min("t").alias("death")), key, "left")
    end = F.coalesce("death", F.least("_last", "duration"))
    return met.select(*key, "first", F.greatest(end, "first").alias("last"), F.col("death").isNotNull().alias("died"), "total")


def concurrency(spans: DataFrame, group: str = "fight", start: str = "first", end: str = "last") -> DataFrame:
    """(group, t, n): how many spans are open from t on, a row at every change. Starts from (0, 0) where the first
    change comes later. Spans without width cancel out."""
    edges = spans.select(group, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("e"))
    moves = edges.groupBy(group, F.col("e.t").alias("t")).agg(F.sum("e.d").alias("d"))
    order = W.partitionBy(group).orderBy("t")
    running = moves.withColumn("n", F.sum("d").over(order.rowsBetween(W.unboundedPreceding, 0)))
    steps = running.withColumn("before", F.lag("n").over(order)).where(F.col("before").isNull() | (F.col("before") != F.col("n")))
    zero = F.struct(F.lit(0.0).alias("t"), F.lit(0).cast("long").alias("n"))
    own = F.struct("t", "n")
    return steps.select(group, F.inline(F.when(F.col("before").isNull() & (F.col("t") > 0), F.array(zero, own)).otherwise(F.array(own))))


def step_spans(steps: DataFrame, until: DataFrame, group: str = "fight") -> DataFrame:
    """Adds span, the seconds that each step holds: up to the next step, or the observed end in until (group, window)."""
    nxt = F.lead("t").over(W.partitionBy(group).orderBy("t"))
    return steps.join(until, group).withColumn("span", F.greatest(F.coalesce(nxt, "window") - F.col("t"), F.lit(0.0)))


def concurrency_stats(steps: DataFrame, until: DataFrame, group: str = "fight") -> DataFrame:
    """(group, mean, peak, peak_share, constant) over the observed window; constant if the peak holds 95 % of it."""
    spans = step_spans(steps, until, group).withColumn("peak", F.max("n").over(W.partitionBy(group)))
    window = F.max("window")
    held = F.sum(F.when(F.col("n") == F.col("peak"), F.col("span")).otherwise(0.0))
    out = spans.groupBy(group).agg(
        F.round(F.try_divide(F.sum(F.col("n") * F.col("span")), window), 4).alias("mean"), F.max("peak").alias("peak"), F.round(F.try_divide(held, window), 4).alias("peak_share")
    )
    return out.withColumn("constant", F.coalesce(F.col("peak_share") >= 0.95, F.lit(False)))


def paired(events: DataFrame, keys: list[str], order: list[str], duration: str = "duration") -> DataFrame:
    """(keys, start, end, truncated, opener): windows of kind 'start' to kind 'end'.

    The first start opens; later ones are ignored while open. An end without a start closes a window from 0;
    a start without an end stays open to the duration; both are truncated. Rows of other kinds are ignored.
    """
    known = events.where(F.col("kind").isin("start", "end"))
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    island = F.coalesce(F.sum(F.when(F.col("kind") == "end", 1).otherwise(0)).over(before), F.lit(0))
    at = lambda kind, value: F.when(F.col("kind") == kind, value)
    opened = F.min_by("source", at("start", F.struct(*order)))
    grouped = known.withColumn("island", island).groupBy(*keys, "island").agg(
        F.min(at("start", F.col("t"))).alias("s"), F.max(at("end", F.col("t"))).alias("e"), F.max(duration).alias("d"),
        F.coalesce(opened, F.max(at("end", F.col("source")))).alias("opener"),
    )
    return grouped.select(
        *keys, F.coalesce("s", F.lit(0.0)).alias("start"), F.coalesce("e", "d").alias("end"), (F.col("s").isNull() | F.col("e").isNull()).alias("truncated"), "opener"
    )


def merged(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end, windows, truncated): spans that overlap or touch become one."""
    order = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    marked = spans.withColumn("_new", new)
    marked = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(
        F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("windows"), F.bool_or("truncated").alias("truncated")
    ).drop("_island")


def phases(marks: DataFrame, keys: list[str], at: str, ties: list[str], name: str, duration: str) -> DataFrame:
    """(keys, ordinal, name, start, end): each mark runs to the next, the last to the duration; time 0 is the first mark."""
    order = W.partitionBy(*keys).orderBy(at, *ties)
    origin = F.first(at).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    nxt = F.lead(at).over(order)
    return marks.select(
        *keys, F.row_number().over(order).cast("long").alias("ordinal"), F.col(name).alias("name"), (F.col(at) - origin).alias("start"),
        (F.coalesce(nxt, F.greatest(F.col(duration), F.col(at))) - origin).alias("end"),
    )


def add_patterns(spans: DataFrame, keys: list[str], present_within: float = 2.0, places: int = 3) -> DataFrame:
    """(keys, n, first, lifetime, gap, at_pull, share): an actor's lives in a fight. gap is the median time between
    starts; share is of all damage of the fight. keys: the fight, then the actor."""
    order = W.partitionBy(*keys).orderBy("first", "instance")
    gap = F.col("first") - F.lag("first").over(order)
    total = F.sum("total").over(W.partitionBy(keys[0]))
    tagged = spans.withColumn("gap", gap).withColumn("all", total)
    return tagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("first"), places).alias("first"), F.round(F.median(F.col("last") - F.col("first")), places).alias("lifetime"),
        F.round(F.median("gap"), places).alias("gap"), (F.min("first") <= present_within).alias("at_pull"),
        F.round(F.when(F.max("all") > 0, F.sum("total").cast("double") / F.max("all").cast("double")).otherwise(0.0), 6).alias("share"),
    )


def peak_visits(steps: DataFrame, group: str = "fight") -> DataFrame:
    """(group, peak, visits): how often the count rises to its peak."""
    tagged = steps.withColumn("peak", F.max("n").over(W.partitionBy(group)))
    up = (F.col("n") >= F.col("peak")) & (F.coalesce(F.lag("n").over(W.partitionBy(group).orderBy("t")), F.lit(-1)) < F.col("peak"))
    return tagged.withColumn("up", up).groupBy(group).agg(F.max("peak").alias("peak"), F.count_if("up").alias("visits"))


#: Fixed value: how far ahead of the next an actor's damage nominates it.
MARGIN = 1.25


def nominated(damage: DataFrame, group: str, actor: str, amount: str, name: str | None = None, encounter: str | None = None, margin: float = MARGIN) -> DataFrame:
    """(group, actor, reason), by the first rule that holds: the first actor by id whose name is the encounter's,
    stands in it or holds it ("name"; case and outer white space aside, empty names are none); the only actor
    ("only"); the one whose damage is `margin` times the next's, any times if the next did nothing ("margin"); else
    none. Without the columns of names the first rule is left out.

    Each task passes on two actors of a group at most."""
    two = first_two(damage, [group], [F.desc(amount), actor], [actor, amount])
    one, nxt = F.col("one"), F.col("two")
    ahead = (one[amount] > 0) & ((nxt[amount] <= 0) | (one[amount] >= margin * nxt[amount]))
    if name is None or encounter is None:
        met = two.withColumn("_named", F.lit(None).cast(damage.schema[actor].dataType))
    else:
        low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
        own, whole = low(name), low(encounter)
        is_named = (own != "") & (whole != "") & (F.contains(whole, own) | F.contains(own, whole))
        met = two.join(damage.where(is_named).groupBy(group).agg(F.min(actor).alias("_named")), group, "left")
    reason = F.when(F.col("_named").isNotNull(), "name").when(nxt.isNull(), "only").when(ahead, "margin").otherwise("none")
    chosen = F.when(F.col("_named").isNotNull(), F.col("_named")).when(reason != "none", one[actor])
    return met.select(group, chosen.alias(actor), reason.alias("reason"))


def significant(damage: DataFrame, group: str, amount: str, least: float = 0.01) -> DataFrame:
    """Rows with at least `least` of their group's amount; all of them where the group has none."""
    total = F.sum(amount).over(W.partitionBy(group))
    share = F.when(total > 0, F.col(amount).cast("double") / total.cast("double")).otherwise(1.0)
    return damage.withColumn("share", share).where(F.col("share") >= least)


def role_fold(roles: Column) -> Column:
    """One role of a set: the only one, 'mixed' for several known ones, 'unknown' where nothing else is known for sure."""
    known = F.array_remove(roles, "unknown")
    return F.when(F.size(known) > 1, "mixed").when(F.array_contains(roles, "unknown") | (F.size(known) == 0), "unknown").otherwise(F.get(known, 0))


def planned_waves(waves: DataFrame, key: str = "plan") -> DataFrame:
    """(key, first, last) of every spawn: waves (key, first, cadence, lasts, length) come again each cadence until
    the length; a cadence of null, 0 or less, or 10000 and more is one spawn. Ends stop at the length."""
    once = F.col("cadence").isNull() | (F.col("cadence") <= 0) | (F.col("cadence") >= 10_000)
    count = F.when(once, 0).otherwise(F.floor((F.col("length") - F.col("first")) / F.when(once, 1).otherwise(F.col("cadence"))))
    start = F.col("first") + F.col("k") * F.coalesce(F.when(once, 0).otherwise(F.col("cadence")), F.lit(0))
    spawned = waves.where("first <= length").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long"))))
    return spawned.select(key, start.cast("double").alias("first"), F.least(start + F.col("lasts"), F.col("length")).cast("double").alias("last"))
