import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gaugeworks.functions import labels
from gaugeworks.operators import documents, gear, kills, talents
from gaugeworks.plans import grid
from gaugeworks.sources import journal, sinks


def test_grid(spark):
    profiles = spark.createDataFrame([("a", "Death Knight"), ("b", "Mage"), ("c", "Mage")], "id string, class string")
    scenarios = spark.createDataFrame([("patch", "base", [1, 5]), ("cleave", "base", [2]), ("dungeon", "extra", [3])], "name string, `group` string, target_counts array<int>")
    assert grid.requests(profiles, scenarios.drop("group")).count() == 12
    got = grid.selected(scenarios, ["dungeon", "base", "dungeon"], spark).orderBy("at", "name").collect()
    assert [r.name for r in got] == ["dungeon", "cleave", "patch"]
    with pytest.raises(PySparkException, match="unknown scenario nope"):
        grid.selected(scenarios, ["nope"], spark).collect()
    ids = lambda **k: [r.id for r in grid.chosen(profiles, **({"classes": [], "ids": [], "shard": None, "limit": None} | k)).collect()]
    assert ids(classes=["death_knight"]) == ["a"] and ids(shard=(0, 2)) == ["a", "c"] and ids(shard=(0, 2), limit=1) == ["a"]
    assert ids(classes=["MAGE"], shard=(1, 2)) == ["c"]
    assert [(r.variant, r.options) for r in grid.toggles(profiles.limit(1), {"none": [], "two": ["x=1"]}).orderBy("state").collect()] == [("none", []), ("two", ["x=1"])]
    assert grid.counted(profiles, 3, "profiles").count() == 3
    with pytest.raises(PySparkException, match="expected 13"):
        grid.counted(profiles, 13, "profiles").collect()


def test_journal(spark):
    node = "array<struct<id: bigint, href: string>>"
    exp = spark.createDataFrame([("New", [(1, None), (None, "/data/journal-instance/7?x")], [(2, None)]), ("Old", None, [(3, None)])], f"name string, dungeons {node}, raids {node}")
    places = journal.placements(exp)
    assert {(r.instance, r.kind) for r in places.collect()} == {(1, "dungeon"), (7, "dungeon"), (2, "raid"), (3, "raid")}
    assert journal.in_scope(places, ["NEW"], [3]).count() == 4
    enc = spark.createDataFrame([(10, 1, " Raid ", 1, [100, 101]), (11, 99, " World ", 2, [100])], "id long, instance long, category string, walk int, items array<long>")
    assert {(r.item, r.kind) for r in journal.drops(enc, places).collect()} == {(100, "dungeon"), (101, "dungeon"), (100, "world")}
    assert [r.instance for r in journal.rotation(spark.createDataFrame([(9, [1]), (3, [7])], "realm int, dungeons array<long>")).collect()] == [7]
    keys = journal.keystones(spark.createDataFrame([(1, "A", None), (5, "B", None)], "id long, name string, href string"), places).collect()
    assert {(r.name, r.warning is None) for r in keys} == {("A", True), ("B", False)}
    builds = spark.createDataFrame([("a", "m", "f", 1.0), ("b", "m", "f", None)], "id string, class string, spec string, sim double")
    ranks = spark.createDataFrame([("m", "f", 1, "5", "9"), ("m", "f", 2, "x", "9")], "class string, spec string, encounter int, value string, sample string")
    assert [(r.id, r.encounter, r.value) for r in journal.ranked_values(builds, ranks).collect()] == [("a", 1, 5.0)]
    facts = journal.compared_facts(spark.createDataFrame([("t", "5"), ("u", "x"), ("v", "1")], "k string, value string"), spark.createDataFrame([("t", "7"), ("u", "x")], "k string, value string"), ["k"])
    assert {(r.k, r.delta, r.differs) for r in facts.collect()} == {("t", 2.0, True), ("u", None, False), ("v", None, None)}
    one = spark.createDataFrame([("a", 1)], "k string, v int")
    assert journal.first_known(one, spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int"), ["k"]).count() == 2


def test_tiers_and_schemas(spark, tmp_path):
    rows = spark.createDataFrame([("AB2",), ("AB10",), ("AB9",)], "tier string")
    assert [sinks.tier_at(rows, k).first() and sinks.tier_at(rows, k).first().tier for k in range(4)] == ["AB10", "AB9", "AB2", None]
    assert sinks.read_optional(spark, str(tmp_path / "none.json"), "a INT") is None
    (tmp_path / "x.json").write_text('{"a": 1}')
    assert sinks.read_optional(spark, str(tmp_path / "x.json"), "a INT").first().a == 1
    frame = spark.createDataFrame([], "a int, b struct<startTime: bigint, c: array<struct<d: string>>>, e date")
    assert sinks.schema_text(frame) == ["a: int", "b.startTime: bigint*", "b.c[].d: string", "e: date*"]


def test_labels(spark):
    frame = spark.createDataFrame([(1.0, 5), (4.8, 5), (3.5, 5), (2.0, 5), (1.2, 5), (None, 5)], "v double, t int")
    assert [r.l for r in frame.select(labels.concentration_label(F.col("v"), F.col("t")).alias("l")).collect()] == [
        "Spread evenly", "Almost all on main target", "Very concentrated", "Concentrated", "Slightly favours main target", None
    ]
    one = spark.range(1).select(
        labels.signed_percent(F.lit(-0.0123)).alias("a"), labels.compact_number(F.lit(1234567)).alias("b"), labels.compact_number(F.lit(12345)).alias("c"), labels.level_gap(F.lit(10), F.lit(12), F.lit(20), F.lit(False)).alias("d"),
        labels.level_gap(F.lit(None).cast("int"), F.lit(1), F.lit(2), F.lit(True)).alias("e"), labels.variant_options(F.lit("v"), F.array(F.lit("x=1"), F.lit("y=2"))).alias("f"), labels.cast_times(F.lit(10.0)).alias("g"),
        labels.cast_times(F.lit(260.0)).alias("h"), labels.pattern_label(F.lit(3), F.lit(2), F.lit(1.25), F.lit(False)).alias("i"), labels.first_and_more(F.array(*map(F.lit, "abcde"))).alias("j"), labels.lead_over(F.lit(3.0), F.lit(0.0)).alias("k"),
    ).first()
    assert one[:5] == ("-1.2%", "1.23M", "12.3k", "2 below the band 12-20", None)
    assert one.f == ['profileset."v"=x=1', 'profileset."v"+=y=2'] and one.g == [0.0] and one.h == [0.0, 120.0, 240.0]
    assert one.i.startswith("peaks at 3 twice") and one.j == "a, b, c +2 more" and one.k == float("inf")


def test_kills(spark):
    rows = [(1, "a", 5, 100), (1, "a", 6, 50), (1, "b", 7, 60), (1, "c", 8, 40)]
    frame = spark.createDataFrame(rows, "encounter int, code string, fight long, at long")
    assert [(r.code, r.fight) for r in kills.earliest_kills(frame, 2).collect()] == [("c", 8), ("a", 6)]
    times = spark.createDataFrame([("1700000000000", "5"), ("0", "5"), ("x", "5")], "a string, b string").select(kills.kill_time(F.col("a"), F.col("b")).alias("t")).collect()
    assert [r.t for r in times] == [1700000000005, None, None]
    w = spark.range(1).select(kills.search_window(F.lit(0), F.lit(9)).alias("x"), kills.search_window(F.lit(86400000), F.lit(9)).alias("y")).first()
    assert w.x[:] == (0, 9) and w.y[:] == (0, 15 * 86400000)


def test_gear_and_talents(spark):
    assert [gear.method(*x) for x in ((82, 28), (351, 28), (1371, 351))] == ["exhaustive", "baseline", "additive"]
    sets = spark.createDataFrame([("s", [1, 2], 110.0, 100.0), ("s", [1, 3], 108.0, 100.0)], "k string, items array<long>, dps double, base double")
    solo = spark.createDataFrame([("s", 1, 6.0), ("s", 2, 4.0)], "k string, item long, gain double")
    assert gear.drift(sets.limit(1), solo, ["k"]).first().drift == 0.0
    matrix = gear.candidate_matrix(spark.createDataFrame([(1, "a", 2.0), (1, "b", 4.0)], "item long, build string, gain double"), "item", "build", "gain").first()
    assert matrix.gains == {"a": 2.0, "b": 4.0} and (matrix["mean"], matrix.best) == (3.0, 4.0)
    heroes = talents.hero_names(spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "id string, sub_tree int"), spark.createDataFrame([(1, "One")], "sub_tree int, name string"), spark.createDataFrame([("x", "Uno")], "id string, name string"))
    assert {(r.id, r.hero, r.unresolved) for r in heroes.collect()} == {("x", "Uno", None), ("y", None, "unnamed hero tree"), ("z", None, "no hero tree")}
    assert [r.t for r in spark.createDataFrame([("frost-12",), ("frost",)], "k string").select(talents.tree_of_key(F.col("k")).alias("t")).collect()] == [12, None]
    texts = spark.range(1).select(documents.caveats(F.lit(0.5), F.lit(2), F.lit(1), F.lit("top")).alias("c")).first().c
    assert texts == ["read to 50% of the fight", "2 windows cut by the start or end", "only 1 pulls", "ranked pulls only"]
