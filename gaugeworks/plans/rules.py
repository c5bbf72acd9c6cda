"""Decision rules as ordered cases: what may be promoted from measurement to fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least sample, the least share of a fight that was read, and the share that makes a peak constant.
MIN_SAMPLE, LEAST_COVERAGE, CONSTANT_SHARE = 3, 0.95, 0.95


def target_count(coverage_low: Column, peak_low: Column, peak_median: Column, peak_high: Column, share: Column) -> Column:
    """struct(value, constant, withheld): the peak as a number of targets; withheld names why there is none."""
    withheld = (
        F.when(coverage_low.isNull(), "coverage unknown").when(coverage_low < LEAST_COVERAGE, "coverage too low").when(peak_low != peak_high, "peaks differ")
    )
    return F.struct(peak_median.alias("value"), (share >= CONSTANT_SHARE).alias("constant"), withheld.alias("withheld"))


def gate(stored: Column, by_hand: Column, fills_blanks: Column, value: Column, sample: Column, withheld: Column) -> Column:
    """struct(state, disagrees). In this order: a fact stated by hand is blocked unless only its blanks are
    filled; a sample under MIN_SAMPLE holds; so does a withheld value; the rest is eligible."""
    state = (
        F.when(stored.isNotNull() & by_hand & ~fills_blanks, "blocked")
        .when(sample < MIN_SAMPLE, "hold")
        .when(withheld.isNotNull(), "hold")
        .when(fills_blanks, "eligible")
        .when(stored.isNotNull(), "supersedes")
        .otherwise("new")
    )
    disagrees = stored.isNotNull() & ~fills_blanks & withheld.isNull() & ~stored.eqNullSafe(value)
    return F.struct(state.alias("state"), disagrees.alias("disagrees"))


def promoted(facts: DataFrame, proposals: DataFrame, keys: list[str]) -> DataFrame:
    """facts (keys, value, by_hand) with the eligible values of proposals (keys, value, state); hand-stated facts
    never change."""
    new = proposals.where(F.col("state").isin("eligible", "supersedes", "new")).select(*keys, F.col("value").alias("_new"))
    met = facts.join(new, keys, "full")
    hand = F.coalesce("by_hand", F.lit(False))
    return met.select(*keys, F.when(hand & F.col("value").isNotNull(), F.col("value")).otherwise(F.coalesce("_new", "value")).alias("value"), hand.alias("by_hand"))


def fight_length(median: Column) -> Column:
    """Seconds of a fight as a fact: the median, rounded (halves to even). Lengths of kills differ rightly, and come from
    the report's own times, so neither their spread nor how far events were read withholds it."""
    return F.bround(median).cast("long")


def raid_size(low: Column, median: Column, high: Column) -> Column:
    """struct(value, withheld): the size of a group; withheld where the sampled fights logged different ones."""
    text = F.format_string("the sampled fights logged different group sizes (%s-%s)", _plain(low), _plain(high))
    return F.struct(F.bround(median).cast("long").alias("value"), F.when(low != high, text).alias("withheld"))


def _plain(number: Column) -> Column:
    """A number without needless decimals."""
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))


def filled(asserted_id: Column, asserted_role: Column, matched_id: Column, matched_role: Column, unknown: str = "unknown") -> Column:
    """struct(id, role, changed): blanks of an asserted fact that a matched measurement fills: an id that is missing,
    and a role that isn't known. What was asserted never changes; a measured role that is mixed or unknown fills none."""
    role_known = F.when(~matched_role.isin("mixed", unknown), matched_role)
    fills_id, fills_role = asserted_id.isNull() & matched_id.isNotNull(), (asserted_role == unknown) & role_known.isNotNull()
    return F.struct(
        F.when(fills_id, matched_id).otherwise(asserted_id).alias("id"), F.when(fills_role, role_known).otherwise(asserted_role).alias("role"),
        F.coalesce(fills_id | fills_role, F.lit(False)).alias("changed"),
    )


def season_note(label: Column, season_id: Column, season_name: Column) -> Column:
    """struct(agrees, state): whether a service's season is the one that a tier's label means; null, with the reason,
    where the service reports or names none. Case and outer white space aside."""
    low = lambda c: F.lower(F.trim(c))
    is_named = F.length(F.coalesce(season_name, F.lit(""))) > 0
    agrees = F.when(season_id.isNotNull() & is_named, low(season_name) == low(label))
    state = F.when(season_id.isNull(), "not reported").when(~is_named, "not named").when(agrees, "agrees").otherwise("differs")
    return F.struct(agrees.alias("agrees"), state.alias("state"))
