"""Rules of curated facts, by hand-made rows."""

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import merge
from gaugeworks.plans import rules
from gaugeworks.sources import scans


def test_lengths_and_sizes(spark):
    frame = spark.createDataFrame([(20.0, 20.5, 20.0), (14.0, 17.5, 20.0), (10.5, 12.0, 20.0)], "low double, mid double, high double")
    got = frame.select(rules.fight_length(F.col("mid")).alias("s"), rules.raid_size(F.col("low"), F.col("mid"), F.col("high")).alias("z")).collect()
    assert [(r.s, r.z.value) for r in got] == [(20, 20), (18, 18), (12, 12)]  # halves go to the even number
    assert [r.z.withheld for r in got] == [None, "the sampled fights logged different group sizes (14-20)", "the sampled fights logged different group sizes (10.5-20)"]


def test_only_blanks_are_filled(spark):
    rows = [(None, "unknown", 7, "boss"), (3, "unknown", 7, "mixed"), (3, "add", 7, "boss"), (None, "unknown", None, None), (3, "unknown", None, "add")]
    frame = spark.createDataFrame(rows, "a long, b string, c long, d string")
    got = [tuple(r.f) for r in frame.select(rules.filled(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("f")).collect()]
    assert got == [(7, "boss", True), (3, "unknown", False), (3, "add", False), (None, "unknown", False), (3, "add", True)]


def test_notes_of_seasons(spark):
    rows = [("Season 2", 14, " season 2 "), ("Season 2", 14, "Season 3"), ("Season 2", 14, None), ("Season 2", 14, ""), ("Season 2", None, "Season 2")]
    got = [tuple(r.n) for r in spark.createDataFrame(rows, "l string, i int, n string").select(rules.season_note(F.col("l"), F.col("i"), F.col("n")).alias("n")).collect()]
    assert got == [(True, "agrees"), (False, "differs"), (None, "not named"), (None, "not named"), (None, "not reported")]


def test_items_keep_how_they_were_worn(spark):
    derived = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "item int, slot string")
    old = spark.createDataFrame([(1, 5, None, "x"), (1, 4, 9, "y"), (9, 1, 1, "z")], "item int, gem int, enchant int, note string")
    kept = merge.rebuilt(derived, old, ["item"], ["gem", "enchant"])
    assert sorted(map(tuple, kept.collect())) == [(1, "a", 5, None), (2, "b", None, None), (3, "c", None, None)]
    worn = merge.adorned(kept, spark.createDataFrame([("a", None, 8), ("b", None, None)], "slot string, gem int, enchant int"), ["slot"], ["gem", "enchant"])
    assert sorted(map(tuple, worn.collect())) == [(1, "a", None, 8), (2, "b", None, None), (3, "c", None, None)]


def test_outputs_tell_why_a_profile_fails(spark):
    rows = [("fine",), ("x\nSetup failure: y\r\n Error: Initialization error, Hash 'q'  \n",), ("Error: Hash 'q'",), ("Unable to generate " + "z" * 400,), (None,), ("Initialization error Hash '",)]
    got = [tuple(r.v) for r in spark.createDataFrame(rows, "o string").select(scans.loads(F.col("o")).alias("v")).collect()]
    assert got[:3] == [(True, None, False), (False, "Error: Initialization error, Hash 'q'", True), (False, "Error: Hash 'q'", False)]
    assert got[3][0] is False and len(got[3][1]) == 200 and got[4:] == [(True, None, False), (True, None, False)]


def test_tables_of_sets_and_tiers(spark):
    lines = ['{ "Late", "o", "T2", 1, 2, 2, 5, 0, 3 },', "// none", '  {"First" , "o" ,"T2",1,2, 4,5,0,3},', '{ "Other", "o", "T2", 1, 2, 2, -1, 0, 3 },']
    rows = spark.createDataFrame([(k if k else 9, x) for k, x in enumerate(lines)], "line int, text string")
    assert sorted(map(tuple, scans.set_bonuses(rows).collect())) == [("First", "o", "T2", 5), ("Other", "o", "T2", -1)]
    pools = spark.createDataFrame([("T1", 1), ("T2", 2)], "tier string, item int")
    assert scans.pool_of_tier(pools, "T2").first().item == 2 and scans.facts_of_tier(pools, "T9").count() == 0
    with pytest.raises(KeyError, match="T1, T2"):
        scans.pool_of_tier(pools, "T9")
