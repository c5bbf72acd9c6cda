"""Journals of places and drops, and rankings, as normalised rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.text import href_id


def linked_id(node: Column, kind: str) -> Column:
    """A node's stated id, else that in its link."""
    return F.coalesce(node["id"].cast("long"), href_id(node["href"], kind))


def placements(expansions: DataFrame) -> DataFrame:
    """(instance, kind, expansion): dungeons and raids of expansions (name, dungeons, raids: arrays of {id, href})."""
    each = expansions.select(
        "name", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(c), F.array().cast("array<struct<id: bigint, href: string>>")).alias("nodes")) for k, c in (("dungeon", "dungeons"), ("raid", "raids"))])).alias("p")
    )
    rows = each.select(F.col("name").alias("expansion"), "p.kind", F.explode("p.nodes").alias("node"))
    return rows.select(linked_id(F.col("node"), "journal-instance").alias("instance"), "kind", "expansion").where("instance IS NOT NULL")


def in_scope(places: DataFrame, expansions: list[str], instances: list[int]) -> DataFrame:
    """Places of the named expansions, in any case, or among the extra instances."""
    return places.where(F.lower("expansion").isin([e.lower() for e in expansions]) | F.col("instance").isin(instances))


def drops(encounters: DataFrame, places: DataFrame) -> DataFrame:
    """(item, encounter, instance, kind, walk): encounters (id, instance, category, walk, items) with the kind of
    their placement, else their own category. An item keeps all its drops."""
    own = F.lower(F.trim("category"))
    met = encounters.join(F.broadcast(places.select("instance", F.col("kind").alias("_kind")).distinct()), "instance", "left")
    return met.select(F.explode("items").alias("item"), F.col("id").alias("encounter"), "instance", F.coalesce("_kind", own).alias("kind"), "walk")


def rotation(realms: DataFrame) -> DataFrame:
    """(instance): the dungeons that the realm with the lowest id lists; realms: realm, dungeons (array of ids)."""
    return realms.agg(F.min_by("dungeons", "realm").alias("d")).select(F.explode("d").alias("instance"))


def keystones(listed: DataFrame, places: DataFrame) -> DataFrame:
    """Keystone dungeons (id, name, href) with their journal instance; unmatched ones stay, with a warning."""
    met = listed.withColumn("instance", F.coalesce(href_id(F.col("href"), "journal-instance"), F.col("id")))
    met = met.join(places.where("kind = 'dungeon'").select("instance", F.lit(True).alias("_known")).distinct(), "instance", "left")
    return met.withColumn("warning", F.when(F.col("_known").isNull(), F.concat(F.lit("no journal instance for "), F.col("name")))).drop("_known")


def ranked_values(builds: DataFrame, rankings: DataFrame) -> DataFrame:
    """builds (id, class, spec, sim) with the rankings (class, spec, encounter, value, sample) of their spec; builds
    without a simulated value are left out, rows whose numbers don't parse too."""
    number = lambda c: F.try_variant_get(F.try_parse_json(F.col(c).cast("string")), "$", "double")
    clean = rankings.select("class", "spec", "encounter", number("value").alias("value"), number("sample").alias("sample")).where("value IS NOT NULL")
    return builds.where("sim IS NOT NULL").join(clean, ["class", "spec"])


def compared_facts(asserted: DataFrame, measured: DataFrame, keys: list[str]) -> DataFrame:
    """Asserted facts (keys, value) beside measured ones, with their difference where both are numbers."""
    met = asserted.select(*keys, F.col("value").alias("asserted")).join(measured.select(*keys, F.col("value").alias("measured")), keys, "left")
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    return met.withColumn("delta", number("measured") - number("asserted")).withColumn("differs", F.when(F.col("measured").isNotNull(), ~F.col("asserted").eqNullSafe(F.col("measured"))))


def first_known(preferred: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of preferred, and those of fallback whose key preferred has nothing for."""
    return preferred.unionByName(fallback.join(preferred.select(*keys).distinct(), keys, "left_anti"))
