"""Paged scans, report search and run ledgers."""

import pytest
from pyspark.sql import functions as F

from gaugeworks.sources import paged
from gaugeworks.sources.ledger import RunLedger

EVENTS = "fight long, timestamp long, type string, actor long, amount double"


@pytest.fixture
def pages(spark, tmp_path):
    rows = [(f, t * 10, "hit", t % 3, float(t)) for f in range(12) for t in range(3 * f)] + [(5, 20, "again", None, None), (None, 1, "x", 1, 1.0)]
    frame = spark.createDataFrame(rows, EVENTS)
    path = f"{tmp_path}/pages"
    paged.write_pages(frame, path, stamps=4, buckets=3)
    return frame.where("fight IS NOT NULL"), path


def as_rows(df):
    return sorted(repr(tuple(r)) for r in df.select("fight", "timestamp", "type", "actor", "amount").collect())


def test_batch_reads_follow_cursors(spark, pages):
    frame, path = pages
    assert as_rows(paged.read_pages(spark, path, 1000)) == as_rows(frame)
    two = paged.read_pages(spark, path, 2)
    assert as_rows(two) == as_rows(frame.where("timestamp < 80"))
    lengths = frame.groupBy("fight").agg(F.min("timestamp").alias("begin"), (F.max("timestamp") - F.min("timestamp")).alias("length"))
    lengths = lengths.union(spark.createDataFrame([(99, 0, 50)], "fight long, begin long, length long"))
    seen = {r.fight: r for r in paged.observed(two, lengths).collect()}
    assert (seen[11].pages, seen[11].events, seen[11].reached, seen[11].truncated, seen[11].coverage, seen[11].complete) == (2, 8, 70, True, 0.2188, False)
    assert (seen[2].pages, seen[2].reached, seen[2].truncated, seen[2].coverage, seen[2].complete) == (2, 50, False, 1.0, True)
    assert (seen[99].pages, seen[99].truncated, seen[99].coverage) == (0, True, 0.0)


def test_a_missing_page_ends_a_fight(spark, pages, tmp_path):
    frame, path = pages
    cut = f"{tmp_path}/cut"
    held = spark.read.parquet(path).where("NOT (fight = 11 AND cursor = 80)")
    held.repartition("bucket").sortWithinPartitions("bucket", "fight", "cursor").write.partitionBy("bucket").parquet(cut)
    wanted = frame.where("NOT (fight = 11 AND timestamp >= 80)")
    assert as_rows(paged.read_pages(spark, cut, 1000)) == as_rows(wanted)
    out = f"{tmp_path}/out"
    paged.admitted(paged.stream_pages(spark, cut, budget=1000, per_batch=3), out)
    assert as_rows(spark.read.parquet(f"{out}/rows")) == as_rows(wanted)
    assert paged.read_pages(spark, cut, 1000).where("fight = 11").select("next").distinct().orderBy(F.desc("next")).first().next == 80


def test_a_budget_ends_a_run_and_the_next_goes_on(spark, pages, tmp_path):
    frame, path = pages
    every = spark.read.parquet(path).count()
    out, read = f"{tmp_path}/out", []
    for _ in range(7):
        paged.admitted(paged.stream_pages(spark, path, budget=10, per_batch=4), out)
        read.append(spark.read.parquet(f"{out}/rows").select("fight", "page").distinct().count())
    assert read[0] == 9 and read[1] == 18 and read[-1] == every  # of ten, more than eight are spent with the ninth
    assert as_rows(spark.read.parquet(f"{out}/rows")) == as_rows(frame)  # each page once


def test_a_search_ends_at_empty_or_short_pages(spark):
    rows = [
        ("short", 1, 2, ["a", "b"]), ("short", 2, 2, ["c"]), ("short", 3, 2, ["d", "e"]), ("empty", 1, 1, ["a"]), ("empty", 2, 1, []), ("empty", 3, 1, ["z"]),
        ("gap", 1, 1, ["a"]), ("gap", 3, 1, ["z"]), ("full", 1, 1, ["a"]), ("full", 2, 1, ["a"]), ("full", 3, 1, ["b"]), ("full", 4, 1, ["z"]), ("none", 1, 3, None), ("late", 2, 1, ["z"]),
        ("ends", 1, 1, ["a", "b"]),
    ]
    frame = spark.createDataFrame(rows, "zone string, page int, limit int, found array<string>")
    codes, ends = paged.searched(frame, "zone", "limit", 3)
    assert {r.zone: (r.pages, r.truncated) for r in ends.collect()} == {
        "short": (2, False), "empty": (2, False), "gap": (2, False), "full": (3, True), "none": (1, False), "late": (1, False), "ends": (2, False)
    }
    found = {}
    for r in codes.collect():
        found.setdefault(r.zone, set()).add((r.code, r.page))
    assert found == {"short": {("a", 1), ("b", 1), ("c", 2)}, "empty": {("a", 1)}, "gap": {("a", 1)}, "full": {("a", 1), ("b", 3)}, "ends": {("a", 1), ("b", 1)}}


def test_ledger_counts_while_rows_are_written(spark, tmp_path):
    rows = [(1, "a", False, None), (2, "a", True, 10.0), (3, "b", False, 12.5), (4, "c", False, 40.0), (5, None, None, None)]
    calls = spark.createDataFrame(rows, "at int, endpoint string, cached boolean, reading double").repartition(3)
    ledger = RunLedger(["a", "b", "unused"], limit_per_hour=100)
    ledger.observed(calls, F.col("endpoint"), F.col("cached"), F.col("reading"), F.col("at")).write.parquet(f"{tmp_path}/calls")
    assert ledger.entries() == [("a", 1, 1), ("b", 1, 0), ("other", 2, 0)]
    assert ledger.spent() == 30.0 and ledger.share() == 0.04
    silent = RunLedger(["a"])
    silent.observed(calls.where("reading IS NULL"), F.col("endpoint"), F.col("cached"), F.col("reading"), F.col("at")).write.parquet(f"{tmp_path}/more")
    assert silent.spent() is None and silent.share() is None
