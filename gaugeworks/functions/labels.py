"""Labels and option texts derived from values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Texts of how damage is spread over targets, and their bounds. Shares are of the number of targets.
EVEN_AT_MOST, ALL_MAIN_SHARE, VERY_SHARE, CONCENTRATED_AT_LEAST = 1.08, 0.92, 0.6, 1.6
SPREAD_TEXTS = {
    "even": "Spread evenly",
    "all": "Almost all on main target",
    "very": "Very concentrated",
    "concentrated": "Concentrated",
    "slight": "Slightly favours main target",
}


def concentration_label(value: Column, targets: Column) -> Column:
    """The text of the first bound that an index meets; null for a null index."""
    met = {
        "even": value <= EVEN_AT_MOST,
        "all": value >= targets * ALL_MAIN_SHARE,
        "very": value >= targets * VERY_SHARE,
        "concentrated": value >= CONCENTRATED_AT_LEAST,
        "slight": value.isNotNull(),
    }
    return F.coalesce(*[F.when(holds, SPREAD_TEXTS[k]) for k, holds in met.items()])


def signed_percent(ratio: Column, places: int = 1) -> Column:
    text = F.format_string(f"%.{places}f%%", F.abs(ratio) * 100)
    return F.when(ratio.isNull(), F.lit(None).cast("string")).otherwise(F.concat(F.when(ratio < 0, "-").otherwise("+"), text))


def compact_number(value: Column) -> Column:
    """1234567 as 1.23M, 12345 as 12.3k."""
    size = F.abs(value)
    return F.when(size >= 1e6, F.format_string("%.2fM", value / 1e6)).when(size >= 1e3, F.format_string("%.1fk", value / 1e3)).otherwise(F.format_string("%.0f", value.cast("double")))


def level_gap(level: Column, low: Column, high: Column, shipped: Column) -> Column:
    """How an item level lies outside its band; null inside it, and for a shipped profile without a level."""
    unknown = F.when(shipped, F.lit(None).cast("string")).otherwise("no item level stated")
    return (
        F.when(level.isNull(), unknown)
        .when(level < low, F.format_string("%d below the band %d-%d", low - level, low, high))
        .when(level > high, F.format_string("%d above the band %d-%d", level - high, low, high))
    )


def item_option(slot: Column, item: Column, bonuses: Column, level: Column, gems: Column, enchant: Column) -> Column:
    """slot=,id=..,bonus_id=a/b,ilevel=..,gem_id=a/b,enchant_id=..; parts without a value are left out."""
    listed = lambda name, a: F.when(F.size(a) > 0, F.concat(F.lit(f"{name}="), F.array_join(a.cast("array<string>"), "/")))
    one = lambda name, v: F.when(v.isNotNull(), F.concat(F.lit(f"{name}="), v.cast("string")))
    return F.concat_ws(",", F.concat(slot, F.lit("=")), one("id", item), listed("bonus_id", bonuses), one("ilevel", level), listed("gem_id", gems), one("enchant_id", enchant))


def variant_options(name: Column, options: Column) -> Column:
    """Lines of a variant: the first assigns, the others add."""
    return F.transform(options, lambda o, k: F.concat(F.lit('profileset."'), name, F.when(k == 0, '"=').otherwise('"+='), o))


def cast_times(length: Column, every: float = 120.0, lasts: float = 20.0) -> Column:
    """0, every, 2 * every ... while a cast that lasts so long ends in time; at least (0)."""
    last = F.floor((length - lasts) / every).cast("int")
    return F.when(length >= lasts, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: k * every)).otherwise(F.array(F.lit(0.0)))


def pattern_label(peak: Column, visits: Column, mean: Column, constant: Column) -> Column:
    steady = F.format_string("%d targets throughout", peak)
    times = F.when(visits == 1, "once").when(visits == 2, "twice").otherwise(F.format_string("%d times", visits))
    return F.when(constant & (peak == 1), "1 target throughout").when(constant, steady).otherwise(F.format_string("peaks at %d %s, mean %.1f", peak, times, mean))


def spread_text(spread: Column, unit: str = "") -> Column:
    """median (low-high, n); the range only where there is one."""
    whole = F.format_string(f"%.1f{unit} (%.1f-%.1f, n=%d)", spread["median"], spread["low"], spread["high"], spread["n"])
    return F.when(spread.isNull(), "not measured").when(spread["low"] == spread["high"], F.format_string(f"%.1f{unit} (n=%d)", spread["median"], spread["n"])).otherwise(whole)


def first_and_more(names: Column, most: int = 3) -> Column:
    """The first few names, and how many more there are."""
    head = F.array_join(F.slice(names, 1, most), ", ")
    return F.when(F.size(names) > most, F.concat(head, F.format_string(" +%d more", F.size(names) - most))).otherwise(head)


def relative_age(then: Column, now: Column) -> Column:
    days = F.datediff(now, then)
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days < 60, F.format_string("%d days ago", days)).otherwise(F.format_string("%d months ago", F.floor(days / 30).cast("int")))


def lead_over(first: Column, second: Column) -> Column:
    """Ratio to the runner-up; without bounds where that did nothing."""
    return F.when(second.isNull() | (second <= 0), F.lit(float("inf"))).otherwise(first / second)
