"""Text functions as columns. Patterns are restricted to ASCII classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(*parts: Column) -> Column:
    """The non-empty parts joined by _, lower-cased, every other run of signs one _, none at the ends."""
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))
    return F.btrim(F.regexp_replace(F.lower(F.array_join(kept, "_")), "[^a-z0-9]+", "_"), F.lit("_"))


def normal_name(name: Column) -> Column:
    """Lower-cased, & as and, without anything but letters and digits."""
    return F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit("and")), "[^a-z0-9]", "")


def titled(token: Column) -> Column:
    """Each part between _ with its first letter raised; the rest keeps its case."""
    return F.array_join(F.transform(F.split(token, "_"), lambda p: F.concat(F.upper(F.substr(p, F.lit(1), F.lit(1))), F.substr(p, F.lit(2)))), " ")


def all_numbers(text: Column) -> Column:
    """Every run of digits, in order."""
    return F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1))


def href_id(href: Column, kind: str) -> Column:
    """The number after /kind/ in a link; null for links of another kind."""
    found = F.regexp_extract(href, f"/{kind}/([0-9]+)", 1)
    return F.when(found != "", F.try_to_number(found, F.lit("9999999999999999999")).cast("long"))


def commit_subject(subject: Column) -> Column:
    """struct(tag, title, pull_request): a leading [tag], and a trailing (#number) as a field of its own."""
    request = F.regexp_extract(subject, r"\(#([0-9]+)\)\s*$", 1)
    bare = F.regexp_replace(subject, r"\s*\(#[0-9]+\)\s*$", "")
    tag = F.regexp_extract(bare, r"^\s*\[([^\]]+)\]", 1)
    title = F.trim(F.regexp_replace(bare, r"^\s*\[[^\]]+\]\s*", ""))
    return F.struct(F.nullif(tag, F.lit("")).alias("tag"), title.alias("title"), F.try_to_number(F.nullif(request, F.lit("")), F.lit("9999999999")).cast("long").alias("pull_request"))


def tier_order(tier: Column) -> Column:
    """struct(prefix, number) by which tiers like AB2 and AB10 sort."""
    return F.struct(F.regexp_extract(tier, "^([A-Za-z]+)", 1).alias("prefix"), F.try_to_number(F.nullif(F.regexp_extract(tier, "([0-9]+)$", 1), F.lit("")), F.lit("99999999")).cast("long").alias("number"))


def names_overlap(a: Column, b: Column) -> Column:
    """Whether one name contains the other, in any case."""
    return F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a))


def endpoint(path: Column) -> Column:
    """The third part of a request path, or the whole."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.coalesce(F.get(parts, F.lit(2)), path)


def initials(name: Column, most: int = 2) -> Column:
    return F.upper(F.array_join(F.slice(F.transform(F.regexp_extract_all(name, F.lit("([A-Za-z0-9]+)"), F.lit(1)), lambda w: F.substr(w, F.lit(1), F.lit(1))), 1, most), ""))


def short_label(name: Column, most: int) -> Column:
    return F.when(F.length(name) > most, F.concat(F.rtrim(F.substr(name, F.lit(1), F.lit(most - 1))), F.lit("…"))).otherwise(name)


def bracketed(value: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    """The label of the first step that the value reaches, steps from high to low; null for null."""
    out = F
    for least, label in steps:
        out = out.when(value >= least, label)
    return F.when(value.isNotNull(), out.otherwise(rest))
