"""Published fight documents: drawable windows, patterns, caveats, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions.labels import pattern_label
from gaugeworks.operators.intervals import merged

#: Fixed value: share of a fight from which a window counts as permanent.
PERMANENT = 0.66


def is_permanent(start: Column, end: Column, length: Column) -> Column:
    return F.coalesce((end - start) / F.when(length > 0, length) >= PERMANENT, F.lit(False))


def drawable(windows: DataFrame, pooled: DataFrame, most: int = 3) -> DataFrame:
    """(fight, ability, start, end, windows, truncated, permanent, hidden): windows of pooled abilities, merged;
    the first `most` of each ability, with the number that isn't shown. windows: fight, ability, start, end,
    truncated, duration."""
    length = windows.groupBy("fight").agg(F.max("duration").alias("duration"))
    bands = merged(windows.join(pooled.select("ability").distinct(), "ability", "left_semi"), ["fight", "ability"]).join(length, "fight")
    per = W.partitionBy("fight", "ability")
    ranked = bands.withColumn("_n", F.row_number().over(per.orderBy("start"))).withColumn("hidden", F.greatest(F.count(F.lit(1)).over(per) - most, F.lit(0)))
    return ranked.where(F.col("_n") <= most).withColumn("permanent", is_permanent(F.col("start"), F.col("end"), F.col("duration"))).drop("_n", "duration")


def shortest_bands(bands: DataFrame, most: int = 3) -> DataFrame:
    """The `most` shortest bands of each ability, in the order of time."""
    order = W.partitionBy("fight", "ability").orderBy(F.col("end") - F.col("start"), "start")
    return bands.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n").orderBy("fight", "ability", "start")


def patterns(clustered: DataFrame, facts: DataFrame) -> DataFrame:
    """(encounter, pattern, pulls, share, label, unmatched): clusters of two pulls or more with the label of their
    medoid; of an encounter without any, the representative alone. clustered: encounter, cluster, medoid, size.
    facts: encounter, fight, peak, visits, mean, constant, representative."""
    all_pulls = F.sum("size").over(W.partitionBy("encounter"))
    sized = clustered.withColumn("all", all_pulls).withColumn("matched", F.sum(F.when(F.col("size") >= 2, F.col("size")).otherwise(0)).over(W.partitionBy("encounter")))
    fact = facts.select("encounter", F.col("fight").alias("medoid"), "peak", "visits", "mean", "constant", "representative")
    met = sized.join(fact, ["encounter", "medoid"])
    kept = met.where((F.col("size") >= 2) | ((F.col("matched") == 0) & F.col("representative")))
    label = pattern_label(F.col("peak"), F.col("visits"), F.col("mean"), F.col("constant"))
    return kept.select(
        "encounter", F.col("medoid").alias("pattern"), F.col("size").alias("pulls"), F.round(F.col("size") / F.col("all"), 4).alias("share"), label.alias("label"),
        (F.col("all") - F.greatest("matched", F.lit(1))).alias("unmatched"),
    )


def _read_to(coverage: Column) -> Column:
    """Whole percent, halves up, of a share that has 4 places."""
    return F.format_string("read to %d%% of the fight", F.round((coverage * 100).cast("decimal(9,2)"), 0).cast("int"))


def caveats(coverage: Column, truncated: Column, sample: Column, order: Column) -> Column:
    """What a reader must know, in a fixed order."""
    texts = F.array(
        F.when(coverage.isNull(), "coverage unknown").when(coverage < 0.95, _read_to(coverage)),
        F.when(truncated > 0, F.format_string("%d windows cut by the start or end", truncated)),
        F.when(sample < 3, F.format_string("only %d pulls", sample)),
        F.when(order == "top", "ranked pulls only"),
    )
    return F.filter(texts, lambda t: t.isNotNull())


def coverage_of(window: Column, duration: Column) -> Column:
    """Share of a fight that was read: at most 1, 4 places; null without a duration."""
    return F.when(duration > 0, F.round(F.least(window / duration, F.lit(1.0)), 4))


def fight_documents(pulls: DataFrame, steps: DataFrame, significant: DataFrame, auras: DataFrame) -> DataFrame:
    """(encounter, document): a JSON text for each encounter, with its pulls in order, and in each its numbers of targets
    over all enemies and over the significant ones, its priority target, its auras and what a reader must know.

    pulls: encounter, fight, window and duration (seconds), priority (an actor, or null) and reason. steps and
    significant: fight, t, n. auras: fight, ability, start, end, truncated. Times are whole milliseconds. Keys without
    a value are absent, as are lists that have no entry. All is grouped within one partitioning by encounter, so that
    what belongs to a pull meets it without further shuffles; a document is as large as its encounter.
    """
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    owner = pulls.select("fight", "encounter")
    kinds = {
        "targets": steps.select("fight", F.struct(ms("t").alias("t"), "n").alias("x")),
        "significantTargets": significant.select("fight", F.struct(ms("t").alias("t"), "n").alias("x")),
        "auras": auras.select("fight", F.struct(ms("start").alias("start"), "ability", ms("end").alias("end"), F.when(F.col("truncated"), True).alias("truncated")).alias("x")),
    }
    out = pulls.repartition("encounter")
    for name, rows in kinds.items():
        grouped = rows.join(owner, "fight").repartition("encounter").groupBy("encounter", "fight").agg(F.array_sort(F.collect_list("x")).alias(name))
        out = out.join(grouped, ["encounter", "fight"], "left")
    coverage = coverage_of(F.col("window"), F.col("duration"))
    warnings = F.filter(
        F.array(
            F.when(coverage.isNull(), "coverage unknown").when(coverage < 0.95, _read_to(coverage)),
            F.when(F.col("auras").isNull(), "no auras"), F.when(F.col("priority").isNull(), "no priority target"),
        ), lambda t: t.isNotNull(),
    )
    pull = F.struct(
        "fight", ms("window").alias("window"), ms("duration").alias("duration"), "targets", "significantTargets", "priority", "reason", "auras", F.when(F.size(warnings) > 0, warnings).alias("warnings")
    )
    grouped = out.groupBy("encounter").agg(
        F.array_sort(F.collect_list(pull), lambda a, b: F.when(a["fight"] < b["fight"], -1).when(a["fight"] > b["fight"], 1).otherwise(0)).alias("pulls"),
        F.struct(F.count(F.lit(1)).alias("pulls"), F.count_if(F.coalesce(coverage >= 0.95, F.lit(False))).alias("complete")).alias("coverage"),
    )
    return grouped.select("encounter", F.to_json(F.struct("encounter", "coverage", "pulls"), {"ignoreNullFields": "true"}).alias("document"))
