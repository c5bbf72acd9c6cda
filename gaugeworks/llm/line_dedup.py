"""Removal of lines that many sites share.

The distinct sites of each line are counted by HyperLogLog sketches that merge in the aggregation, so a line on
billions of pages costs one small sketch for each task. Lines on fewer rows than the threshold can't reach it
and get no sketch. Where the estimate is within BAND relative standard errors of the threshold (one site at
least), the distinct sites are counted exactly. Lines that reach the threshold go from every document; all else
keeps its order. All work is in Spark's own expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import pick, semi_join
from gaugeworks.session import checkpointed, scratch_path

MIN_SITES, LG_K, BAND = 10, 12, 4.0


def _line_key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line)))


def _row_key(*columns: str) -> Column:
    return F.unhex(F.md5(F.to_json(F.struct(*columns))))


def _lines(rows: DataFrame) -> DataFrame:
    """(doc_key, site, at, line_key) of every line that isn't blank."""
    out = rows.select("doc_key", "site", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return out.where(F.trim("line") != "").select("doc_key", "site", "at", _line_key(F.col("line")).alias("line_key"))


def shared_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line_key, sites, exact) of the lines on at least min_sites distinct sites. A null site is none."""
    often = lines.groupBy("line_key").agg(F.count("site").alias("n")).where(F.col("n") >= min_sites).select("line_key")
    often = checkpointed(often)
    spread = semi_join(lines, often, "line_key")
    # the sketch sees each site of a line once for each task at most
    sketched = spread.groupBy("line_key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("guess"))
    margin = max(1.0, BAND * 1.04 / 2 ** (LG_K / 2) * min_sites)
    sketched = checkpointed(sketched.where(F.col("guess") >= min_sites - margin))
    near = sketched.where(F.abs(F.col("guess") - min_sites) <= margin).select("line_key")
    sure = sketched.where(F.col("guess") - min_sites > margin).select("line_key", F.col("guess").alias("sites"), F.lit(False).alias("exact"))
    counted = semi_join(lines, near, "line_key").select("line_key", "site").distinct().groupBy("line_key").agg(F.count("site").alias("sites"))
    return sure.union(counted.where(F.col("sites") >= min_sites).select("line_key", "sites", F.lit(True)))


def remove_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of every row, its shared lines removed.

    Lines are parted by line feeds and compared without spaces around them; blank lines always stay. A null text
    stays null, with no lines. A text of shared lines only becomes empty. Rows that repeat are treated alike and
    returned each. An empty table gives no rows.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, site=site_col).withColumn("doc_key", _row_key("doc_id", "text"))
    path = scratch_path(docs.sparkSession, "lines")
    _lines(rows).write.parquet(path)
    lines = docs.sparkSession.read.parquet(path)
    shared = checkpointed(shared_lines(lines, min_sites)).select("line_key")
    gone = semi_join(lines, shared, "line_key").groupBy("doc_key").agg(F.collect_set("at").alias("gone"))
    met = rows.select("doc_id", "text", "doc_key").join(gone, "doc_key", "left")
    part = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(part) - 1), F.col("gone"))
    clean = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(part, i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(part)).cast("long")
    return met.select("doc_id", clean.alias("text"), n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
