"""What is to be run: requests of a sweep, toggles, scenario selection, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.operators.catalog import numbered


def requests(profiles: DataFrame, scenarios: DataFrame) -> DataFrame:
    """A row for each profile, scenario and number of targets. scenarios (name, target_counts array) is a short
    list, so its product with the profiles is the size that was asked for."""
    return profiles.join(F.broadcast(scenarios)).withColumn("targets", F.explode("target_counts")).drop("target_counts")


def toggles(profiles: DataFrame, options: dict[str, list[str]]) -> DataFrame:
    """Each profile under each named list of options, in the order given."""
    states = F.array(*[F.struct(F.lit(k).cast("int").alias("state"), F.lit(n).alias("variant"), F.array(*map(F.lit, o)).cast("array<string>").alias("options")) for k, (n, o) in enumerate(options.items())])
    return profiles.withColumn("_s", F.explode(states)).select(*profiles.columns, "_s.*")


def selected(scenarios: DataFrame, names: list[str], spark: SparkSession) -> DataFrame:
    """Scenarios by name, by group or all of them, once each in the order first asked for; an unknown name is an
    error. scenarios: name, group."""
    asked = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "at int, asked string")
    met = asked.join(F.broadcast(scenarios), (F.col("asked") == F.col("name")) | (F.col("asked") == F.col("group")) | (F.col("asked") == "all"), "left")
    met = met.withColumn("name", F.when(F.col("name").isNull(), F.raise_error(F.concat(F.lit("unknown scenario "), F.col("asked")))).otherwise(F.col("name")))
    return met.groupBy("name").agg(F.min("at").alias("at"), F.first("group").alias("group"))


def chosen(profiles: DataFrame, classes: list[str], ids: list[str], shard: tuple[int, int] | None, limit: int | None) -> DataFrame:
    """Profiles (id, class) by class (in any case and spelling), then by id, then a shard, then a limit, in the
    order of class and id. This order of steps is part of the meaning."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    out = profiles
    if classes:
        out = out.where(plain(F.col("class")).isin(["".join(x for x in c.lower() if x.isalpha()) for c in classes]))
    if ids:
        out = out.where(F.col("id").isin(ids))
    out = numbered(out, ["class", "id"]).withColumn("_n", F.col("position") - 1).drop("position")
    if shard:
        if not 0 <= shard[0] < shard[1]:
            raise ValueError(f"shard {shard[0]} of {shard[1]}")
        out = out.where(F.col("_n") % shard[1] == shard[0])
    out = out.orderBy("_n")
    return (out.limit(limit) if limit is not None else out).drop("_n")


def counted(df: DataFrame, expected: int, what: str) -> DataFrame:
    """df, whose rows raise an error unless there are as many as expected."""
    n = F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))  # for fixed lists of a dozen rows
    ok = F.when(n == expected, True).otherwise(F.raise_error(F.concat(F.lit(f"{what}: expected {expected} rows, found "), n)))
    return df.withColumn("_ok", ok).where("_ok").drop("_ok")


def restates(options: Column, max_time: Column, static_time: Column) -> Column:
    """A planned scenario that is only the static sweep again."""
    return (F.size(options) == 0) & (max_time == static_time)
