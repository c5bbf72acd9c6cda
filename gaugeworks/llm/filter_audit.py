"""How five quality filters overlap, document by document, and what each order of them removes.

The words of every text are exploded and aggregated by (document, word) and then by document, which gives totals
and distinct words. The other flags come from the text itself and from an aggregation by digest, and are
outer-joined by document, as are the labels. A document's five flags are a number below 32; each part of the
corpus is reduced to 32 conditional counts (and as many of good and of toxic documents), from which the effect of
every order of the filters follows without another look at the documents.

All work is in Spark's own expressions. Texts are shuffled once, by document; the words of a document are
aggregated where its text lies and don't move.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import SPACE_RUN, pick
from gaugeworks.session import checkpointed

FILTERS = "ABCDE"
#: Bounds of the five filters, as the contract names them: words, percent distinct, percent capitals, signs.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 50, 65, 5, r"[#$%&*|]"
MASKS = 1 << len(FILTERS)


def _digest(text: Column) -> Column:
    """The first 16 bytes of SHA-256: equal for equal texts only, for all that matters at any size of corpus."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _row_key(doc_id: Column, digest: Column) -> Column:
    """One name for an id, null included, with a text."""
    return _digest(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.hex(digest)))


def word_counts(texts: DataFrame) -> DataFrame:
    """(row_key, words, distinct) of texts (row_key, text), one row each; texts without words have no row.

    Grouped by row_key alone the rows are where the grouping by (row_key, word) needs them already, so the exploded
    words are counted in place.
    """
    words = texts.select("row_key", F.explode(F.split("text", SPACE_RUN)).alias("word")).where("word <> ''")
    each = words.groupBy("row_key", "word").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("row_key").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("distinct"))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, rows, mask): mask has bit k set if the document fails the filter FILTERS[k]; rows that repeat
    id, text and part are one row here, with their number in rows."""
    read = pick(docs, doc_id=id_col, text=text_col, part=part_col)
    read = read.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"))
    keyed = read.withColumn("digest", _digest(F.col("text"))).withColumn("row_key", _row_key(F.col("doc_id"), F.col("digest")))
    capitals = 100 * F.regexp_count("text", F.lit("[A-Z]")) > MOST_CAPITALS * F.length("text")
    flags = keyed.select("row_key", "doc_id", "part", "digest", capitals.alias("c"), F.col("text").rlike(SIGNS).alias("d"))
    flags = checkpointed(flags.groupBy("row_key", "doc_id", "part", "digest", "c", "d").agg(F.count(F.lit(1)).alias("rows")))
    counts = word_counts(keyed.select("row_key", "text").dropDuplicates(["row_key"]))
    # the first row of each text: one for each digest, so no group of copies meets in one task
    first = flags.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = first.select(_row_key(F.col("doc_id"), F.col("digest")).alias("row_key"), F.lit(True).alias("is_first"))
    met = flags.join(counts, "row_key", "left").join(first, "row_key", "left")
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct", F.lit(0))
    fails = [words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, F.col("c"), F.col("d"), F.col("is_first").isNull()]
    mask = sum((F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)), F.lit(0))
    return met.select("doc_id", "part", "rows", mask.alias("mask"))


def pattern_counts(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """A row for each part: arrays n, good and toxic of 32 counts each, by mask. A document is good (toxic) if a
    label of its id says 1; a null id has no label."""
    named = pick(labels, doc_id=id_col, good=good_col, bad=toxic_col)
    named = named.groupBy("doc_id").agg(F.max(F.col("good") == 1).alias("good"), F.max(F.col("bad") == 1).alias("bad"))
    met = failed.join(named, "doc_id", "left")
    kinds = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("bad")}
    columns = [
        F.sum(F.when((F.col("mask") == m) & is_kind, F.col("rows")).otherwise(0)).alias(f"{kind}{m}") for kind, is_kind in kinds.items() for m in range(MASKS)
    ]
    wide = met.groupBy("part").agg(*columns)
    return wide.select("part", *(F.array(*(f"{kind}{m}" for m in range(MASKS))).alias(kind) for kind in kinds))


def _steps() -> Column:
    """(filter_order, step, earlier, own) of every step of every order: the bits of the filters before, and its own."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        name, earlier = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            rows.append({"filter_order": name, "step": step, "earlier": earlier, "own": 1 << k})
            earlier |= 1 << k
    # one literal instead of thousands of them
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, earlier: int, own: int>>")


def order_effects(patterns: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step: what the step keeps and removes, from the 32 counts alone.

    A filter that fails a document together with k - 1 others removes it in one of k of all orders, so its sum over
    the orders is 120 / k for each such document.
    """
    bits = F.sequence(F.lit(0), F.lit(MASKS - 1))

    def total(counts: str, is_in) -> Column:
        held = F.transform(F.filter(bits, is_in), lambda m: F.get(F.col(counts), m))
        return F.aggregate(held, F.lit(0).cast("long"), lambda a, b: a + b)

    earlier, own = F.col("earlier"), F.col("own")
    has, clear = lambda m, b: m.bitwiseAND(b) != 0, lambda m, b: m.bitwiseAND(b) == 0
    removed_here = lambda m: has(m, own) & clear(m, earlier)
    n_orders = factorial(len(FILTERS))
    share = F.transform(bits, lambda m: F.when(has(m, own), F.get(F.col("n"), m) * F.floor(F.lit(n_orders) / F.bit_count(m))).otherwise(F.lit(0)))
    rows = patterns.select("part", "n", "good", "toxic", F.explode(_steps()).alias("s")).select("part", "n", "good", "toxic", "s.*")
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: clear(m, earlier.bitwiseOR(own))).alias("kept"),
        total("n", removed_here).alias("removed"),
        total("n", lambda m: has(m, own) & has(m, earlier)).alias("redundant"),
        F.get(F.col("n"), own).alias("unique_fails"),
        total("good", removed_here).alias("good_lost"),
        total("toxic", removed_here).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, b: a + b).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): for each
    part of docs 600 rows, one for each step of each order of the five filters.

    Defined results: a null text is empty (no word, so it fails A and, after the first such id, E); a null part is the
    empty string; a null id counts as larger than any other, and among rows without an id none is a copy of another.
    Rows that repeat an id are documents of their own, and copies only of texts with a smaller id. Whole texts are
    read, however long. Other columns of either table aren't read, whatever their names. An empty table gives no rows.
    """
    return order_effects(pattern_counts(failures(docs, id_col, text_col, part_col), labels))
