"""Scans of text: profiles, generated tables, delimited logs, paged JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks import schemas


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def _field(text: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(text, rf'(?m)^{name}\s*=\s*"?([^"\r\n]*?)"?\s*$', 1), F.lit(""))


def profiles(texts: DataFrame, classes: list[str]) -> DataFrame:
    """(file, class, name, spec, role, talents, item_levels): profiles of the listed classes; other files are
    left out. The role is attack where none is stated."""
    head = rf'(?m)^({"|".join(classes)})\s*=\s*"?([^"\r\n]*?)"?\s*$'
    text = F.col("text")
    out = texts.select(
        "file", F.regexp_extract(text, head, 1).alias("class"), F.regexp_extract(text, head, 2).alias("name"), _field(text, "spec").alias("spec"),
        F.coalesce(_field(text, "role"), F.lit("attack")).alias("role"), _field(text, "talents").alias("talents"),
        F.transform(F.regexp_extract_all(text, F.lit(r"(?m)\bilevel=([0-9]+)"), F.lit(1)), lambda x: x.cast("int")).alias("item_levels"),
    )
    return out.where((F.col("class") != "") & F.col("spec").isNotNull())


def damage_roles(found: DataFrame) -> DataFrame:
    return found.where(F.lower("role").isin("spell", "attack", "hybrid", "dps"))


def table_rows(texts: DataFrame, columns: list[str], name: str | None = None) -> DataFrame:
    """(file, columns): the rows { a, b, ... } of a generated table, quotes taken off; of the array `name` alone
    if given. Rows of fewer fields are left out. Commas inside quotes don't part fields."""
    body = F.regexp_extract("text", rf"(?s)\b{name}\b[^=]*=\s*\{{(.*?)\}};", 1) if name else F.col("text")
    rows = texts.select("file", F.explode(F.regexp_extract_all(body, F.lit(r"\{\s*([^{}]+?)\s*,?\s*\}"), F.lit(1))).alias("row"))
    fields = F.transform(F.regexp_extract_all("row", F.lit(r'\s*("(?:[^"\\]|\\.)*"|[^,\s][^,]*)'), F.lit(1)), lambda x: F.regexp_replace(F.trim(x), '^"|"$', ""))
    cut = rows.select("file", fields.alias("f")).where(F.size("f") >= len(columns))
    return cut.select("file", *[F.get("f", k).alias(c) for k, c in enumerate(columns)])


def enum_ids(texts: DataFrame) -> DataFrame:
    """(name, id) of NAME = number entries."""
    pair = F.explode(F.arrays_zip(*[F.regexp_extract_all("text", F.lit(r"\b([A-Z][A-Z0-9_]*)\s*=\s*([0-9]+)"), F.lit(k)).alias(n) for k, n in ((1, "name"), (2, "id"))]))
    return texts.select(pair.alias("p")).select("p.name", F.col("p.id").cast("long").alias("id"))


def stat_slice(stats: Column, offset: Column, count: Column) -> Column:
    """The item's part of a positional list of stats."""
    return F.when(count > 0, F.slice(stats, offset + 1, count)).otherwise(F.slice(stats, 1, 0))


def delimited_log(lines: DataFrame) -> DataFrame:
    """(revision, date, subject) of lines hash|date|subject; the subject keeps further bars. Others are left out."""
    parts = F.split(F.col("value"), r"\|", 3)
    ok = lines.select(parts.alias("p")).where("size(p) = 3")
    return ok.select(F.get("p", 0).alias("revision"), F.try_to_date(F.get("p", 1)).alias("date"), F.get("p", 2).alias("subject"))


def without_automated(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes by people, one row that counts the automated ones)."""
    # Fixed value: how automated changes begin
    robot = F.col("subject").rlike(r"(?i)^Update Generated Files\b")
    return log.where(~robot), log.where(robot).agg(F.count(F.lit(1)).alias("automated"))


def commented_blocks(texts: DataFrame, head: str = "profile=", save: str = "save=") -> DataFrame:
    """(file, block): runs of commented-out lines from a head line to a save line; blank lines may stand between,
    any other line ends the run. A run without a save line is none."""
    lines = rf"(?m)^#\s*{head}[^\n]*\n(?:(?:#(?!\s*{head})[^\n]*|[ \t]*)\n)*?#\s*{save}[^\n]*$"
    found = texts.select("file", F.explode(F.regexp_extract_all("text", F.lit(f"({lines})"), F.lit(1))).alias("raw"))
    return found.select("file", F.regexp_replace("raw", r"(?m)^#\s?", "").alias("block"))


def zones(documents: DataFrame, column: str) -> DataFrame:
    """(zone, name, frozen, encounter, encounter_name) in the service's order; zones without encounters stay, rows
    without an id go."""
    z = documents.select(F.posexplode(F.from_json(column, schemas.ZONES)).alias("at", "z")).where("z.id IS NOT NULL")
    e = z.select("at", "z.id", "z.name", F.coalesce("z.frozen", F.lit(False)).alias("frozen"), F.explode_outer("z.encounters").alias("e"))
    return e.select("at", F.col("id").alias("zone"), "name", "frozen", F.col("e.id").alias("encounter"), F.col("e.name").alias("encounter_name"))


def event_pages(spark: SparkSession, path: str) -> DataFrame:
    """Events of paged responses, with truncated: whether the last page that was read names a next one."""
    schema = f"fight BIGINT, page INT, nextPageTimestamp BIGINT, data ARRAY<STRUCT<{', '.join(f'{n}: {k}' for n, k in (x.split(' ') for x in schemas.EVENT.split(', ')))}>>"
    pages = spark.read.schema(schema).json(path)
    last = pages.groupBy("fight").agg(F.max_by(F.struct(F.col("nextPageTimestamp").isNotNull().alias("truncated")), "page").alias("l")).select("fight", "l.truncated")
    return pages.select("fight", "page", F.explode("data").alias("e")).select("fight", "page", "e.*").join(last, "fight")


def unwrapped(payload: Column) -> Column:
    """The list inside a payload that may be a list, {data: list} or {data: {entries | series | targets: list}},
    and may be text of one; an array of variants, null for none of these."""
    value = F.try_parse_json(payload)
    value = F.coalesce(F.when(F.schema_of_variant(value) == "STRING", F.try_parse_json(F.try_variant_get(value, "$", "string"))), value)
    at = lambda path: F.try_variant_get(value, path, "array<variant>")
    return F.coalesce(at("$.data.entries"), at("$.data.series"), at("$.data.targets"), at("$.data"), at("$"))


#: What a program's output says when a profile doesn't load, in the order in which it is looked for, and
#: the two texts of a line that tell a stale talent string.
FAILURES = ("Error:", "Setup failure", "Unable to generate")
STALE_TEXTS = ("Initialization error", "Hash '")
#: Fixed value: a row of the generated table of set bonuses.
SET_ROW = r'\{\s*"([^"]*)"\s*,\s*"([^"]*)"\s*,\s*"([^"]*)"\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*,'


def loads(output: Column) -> Column:
    """struct(loads, reason, stale): whether a profile loaded, by its process's output. The reason is the first line
    with the first of FAILURES that occurs, trimmed, 200 characters at most; stale tells that the talent string is
    to blame. No output is no failure."""
    lines = F.split(F.coalesce(output, F.lit("")), r"\r\n|[\n\r]")
    first_with = lambda mark: F.get(F.filter(lines, lambda x: F.contains(x, F.lit(mark))), 0)
    line = F.coalesce(*map(first_with, FAILURES))
    whole = F.trim(line)
    stale = F.coalesce(F.contains(whole, F.lit(STALE_TEXTS[0])) & F.contains(whole, F.lit(STALE_TEXTS[1])), F.lit(False))
    return F.struct(line.isNull().alias("loads"), F.left(whole, F.lit(200)).alias("reason"), stale.alias("stale"))


def set_bonuses(lines: DataFrame, at: str = "line", text: str = "text") -> DataFrame:
    """(name, option, tier, class) of a generated table: of the rows of one (option, tier, class) the first names it."""
    part = lambda k: F.regexp_extract(text, SET_ROW, k)
    rows = lines.where(F.col(text).rlike(SET_ROW)).select(at, part(1).alias("name"), part(2).alias("option"), part(3).alias("tier"), part(7).cast("int").alias("class"))
    return rows.groupBy("option", "tier", "class").agg(F.min_by("name", at).alias("name")).select("name", "option", "tier", "class")


def pool_of_tier(pools: DataFrame, tier: str) -> DataFrame:
    """The rows of one tier of curated pools; a tier without any is an error that names those there are."""
    own = pools.where(F.col("tier") == tier)
    if own.isEmpty():
        known = [r.tier for r in pools.select("tier").distinct().orderBy("tier").collect()]
        raise KeyError(f"no pools for tier {tier!r} (there are: {', '.join(known) or 'none'})")
    return own


def facts_of_tier(facts: DataFrame, tier: str) -> DataFrame:
    """The rows of one tier of curated facts; a tier that the file hasn't caught up with has none."""
    return facts.where(F.col("tier") == tier)
