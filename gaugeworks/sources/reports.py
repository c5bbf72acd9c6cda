"""Simulation reports: one JSON document per run, to cells, abilities, timelines and variant results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks import schemas


def read_reports(spark: SparkSession, path: str, in_lines: bool = False) -> DataFrame:
    """Reports with the file that each came from: a document or an array of them to a file, or one to a line; such
    files can be large, since they are read in parts."""
    return spark.read.schema(schemas.REPORT).option("multiLine", not in_lines).json(path).withColumn("file", F.col("_metadata.file_path"))


def _first_player() -> Column:
    return F.get(F.col("sim.players"), 0)


def _mean(node: str) -> Column:
    return _first_player()["collected_data"][node]["mean"]


def is_valid() -> Column:
    """A report with a player and a dps above 0."""
    return F.coalesce(F.size("sim.players") > 0, F.lit(False)) & F.coalesce(_mean("dps") > 0, F.lit(False))


def cells(reports: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dps, error, std, priority, share, concentration, iterations, length). keys must hold targets.

    error is in percent. Without a priority value all that derives from it is null. Invalid reports are left out;
    `reports.where(~is_valid())` has them.
    """
    data = _first_player()["collected_data"]
    dps, priority = _mean("dps"), _mean("prioritydps")
    share = priority / dps
    return reports.where(is_valid()).select(
        *keys, dps.alias("dps"), (F.coalesce(data["dps"]["mean_std_dev"], F.lit(0.0)) / dps * 100).alias("error"), F.coalesce(data["dps"]["std_dev"], F.lit(0.0)).alias("std"),
        priority.alias("priority"), share.alias("share"), F.when(F.col("targets") > 1, share * F.col("targets")).alias("concentration"),
        F.coalesce(data["dps"]["count"], F.lit(0)).alias("iterations"), F.coalesce(_mean("fight_length"), F.lit(0.0)).alias("length"),
    )


def timelines(reports: DataFrame, keys: list[str], bin_width: int = 1) -> DataFrame:
    """(keys, second, value): the damage series, cut at the shortest fight, in means of bin_width seconds."""
    data = _first_player()["collected_data"]
    series = data["timeline_dmg"]["data"]
    cut = F.floor(data["fight_length"]["min"]).cast("int")
    kept = F.when(cut > 0, F.slice(series, F.lit(1), F.least(cut, F.size(series)))).otherwise(series)
    rows = reports.where(is_valid()).select(*keys, F.posexplode(kept).alias("at", "v"))
    return rows.groupBy(*keys, (F.floor(F.col("at") / bin_width) * bin_width).cast("long").alias("second")).agg(F.avg("v").alias("value"))


def _damage_rows(reports: DataFrame, keys: list[str]) -> DataFrame:
    stat = schemas.STAT
    player = _first_player()
    each = F.map_values(F.try_variant_get(F.try_parse_json(player["stats_pets"]), "$", "map<string, variant>"))
    lists = F.transform(each, lambda v: F.coalesce(F.try_variant_get(v, "$", f"array<{stat}>"), F.try_variant_get(v, "$.stats", f"array<{stat}>")))
    pets = F.flatten(F.filter(lists, lambda x: x.isNotNull()))
    every = F.concat(F.coalesce(player["stats"], F.array()), F.coalesce(pets, F.array()))
    return reports.where(is_valid()).select(*keys, F.posexplode(every).alias("at", "s"))


def abilities(reports: DataFrame, keys: list[str], k: int = 20, least_other: float = 0.001) -> DataFrame:
    """(keys, rank, name, id, amount, executes, share): damage by name over own and pets' entries; the k largest,
    and the rest as Other where it is over `least_other` of all."""
    rows = _damage_rows(reports, keys).where("s.type = 'damage' AND s.actual_amount.mean > 0")
    name = F.coalesce(F.nullif(F.col("s.spell_name"), F.lit("")), F.col("s.name"))
    truthy = F.when(F.col("s.id") != 0, F.col("s.id"))
    summed = rows.groupBy(*keys, name.alias("name")).agg(
        F.sum("s.actual_amount.mean").alias("amount"), F.sum(F.coalesce("s.num_executes.mean", F.lit(0.0))).alias("executes"), F.min_by(truthy, F.when(truthy.isNotNull(), F.col("at"))).alias("id"), F.min("at").alias("at")
    )
    per = W.partitionBy(*keys)
    ranked = summed.withColumn("rank", F.row_number().over(per.orderBy(F.desc("amount"), "at"))).withColumn("all", F.sum("amount").over(per))
    rest = F.col("rank") > k
    out = ranked.groupBy(*keys, F.least("rank", F.lit(k + 1)).alias("rank"), F.when(rest, "Other").otherwise(F.col("name")).alias("name")).agg(
        F.first(F.when(~rest, F.col("id"))).alias("id"), F.sum("amount").alias("amount"), F.sum("executes").alias("executes"), F.first("all").alias("all")
    )
    out = out.withColumn("share", F.col("amount") / F.col("all")).drop("all")
    return out.where((F.col("rank") <= k) | (F.col("share") > least_other))


def variants(reports: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, variant, dps, error, iterations, priority): results of variant batches with a mean above 0; the
    priority is the last metric whose name speaks of one."""
    rows = reports.select(*keys, F.explode("sim.profilesets.results").alias("r")).where("r.mean > 0")
    metric = F.try_element_at(F.filter(F.col("r.additional_metrics"), lambda m: F.contains(F.lower(m["metric"]), F.lit("priority"))), F.lit(-1))
    return rows.select(
        *keys, F.col("r.name").alias("variant"), F.col("r.mean").alias("dps"), (F.coalesce("r.mean_stddev", F.lit(0.0)) / F.col("r.mean") * 100).alias("error"),
        "r.iterations", metric["mean"].alias("priority"),
    )


def caveats(reports: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, caveats): the log messages, trimmed, without empty ones and repeats, in order."""
    texts = F.transform("logs", lambda m: F.trim(m["message"]))
    return reports.select(*keys, F.coalesce(F.array_distinct(F.filter(texts, lambda t: t.isNotNull() & (t != ""))), F.array()).alias("caveats"))


def metadata(reports: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, version, git_revision, game_version, game_build): the test realm's block where that ran and is there."""
    blocks = _first_player()["dbc"]
    block = F.when(F.coalesce("ptr_enabled", F.lit(False)) & blocks["PTR"].isNotNull(), blocks["PTR"]).otherwise(blocks["Live"])
    return reports.select(*keys, "version", "git_revision", block["wow_version"].alias("game_version"), block["build_level"].alias("game_build"))
