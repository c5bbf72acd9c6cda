import random
from decimal import Decimal
import json

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import bits, stats, text
from gaugeworks.operators import catalog, cells, compare, gear, kills, merge
from gaugeworks.plans import rules
from gaugeworks.sources import reports, scans, sinks


def report(dps=500000.0, priority=141500.0, stats_=(), pets=None, data=None, length=3.0):
    collected = {"dps": {"mean": dps, "mean_std_dev": 250.0, "std_dev": 9.0, "count": 3000}, "fight_length": {"mean": 300.0, "min": length, "max": 360.0}}
    if priority is not None:
        collected["prioritydps"] = {"mean": priority}
    if data:
        collected["timeline_dmg"] = {"mean": 1.0, "data": data}
    player = {"stats": list(stats_), "collected_data": collected, "dbc": {"Live": {"wow_version": "1.0", "build_level": 5}}}
    if pets is not None:
        player["stats_pets"] = pets
    return {"version": "v", "logs": [{"message": " slow "}, {"message": ""}, {"message": "slow"}], "sim": {"players": [player]}}


def stat(name, amount, kind="damage", spell=None, id_=0):
    return {"id": id_, "name": name, "spell_name": spell, "type": kind, "actual_amount": {"mean": amount}, "num_executes": {"mean": 1.0}}


@pytest.fixture()
def read(spark, tmp_path):
    def go(*docs):
        for k, d in enumerate(docs):
            (tmp_path / f"{k}.json").write_text(json.dumps(d, indent=1))
        return reports.read_reports(spark, str(tmp_path)).withColumn("run", F.regexp_extract("file", r"(\d+)\.json", 1).cast("int")).withColumn("targets", F.when(F.col("run") == 1, 1).otherwise(5))

    return go


def test_report_to_cell(read):
    got = {r.run: r for r in reports.cells(read(report(), report(priority=None), report(dps=0.0), {"sim": {"players": []}}), ["run", "targets"]).collect()}
    assert set(got) == {0, 1}
    assert (round(got[0].share, 6), round(got[0].concentration, 6), got[0].error) == (0.283, 1.415, 0.05)
    assert got[1].priority is None and got[1].share is None and got[1].concentration is None


def test_abilities_merge_own_and_pets_of_either_form(read):
    own = [stat("a", 60.0, spell="Alpha", id_=7), stat("b", 30.0), stat("heal", 50.0, kind="heal"), stat("z", 0.0)]
    frame = read(report(stats_=own, pets={"wolf": [stat("a", 40.0, spell="Alpha")], "imp": {"stats": [stat("c", 0.05)]}}))
    got = [(r.rank, r.name, r.id, r.amount) for r in reports.abilities(frame, ["run"], k=1).orderBy("rank").collect()]
    assert got[0] == (1, "Alpha", 7, 100.0) and got[1][1] == "Other" and round(got[1][3], 2) == 30.05
    assert [r.name for r in reports.abilities(frame, ["run"], k=2).orderBy("rank").collect()] == ["Alpha", "b"]


def test_timeline_is_cut_and_binned(read):
    got = [(r.second, r.value) for r in reports.timelines(read(report(data=[1.0, 3.0, 5.0, 7.0], length=3.9)), ["run"], 2).orderBy("second").collect()]
    assert got == [(0, 2.0), (2, 5.0)]


def test_caveats_and_variants(read):
    doc = report()
    metrics = [{"metric": "Priority dps", "mean": 1.0}, {"metric": "prioritydps", "mean": 2.0}, {"metric": "x", "mean": 3.0}]
    doc["sim"]["profilesets"] = {"results": [{"name": "a", "mean": 200.0, "mean_stddev": 1.0, "iterations": 10, "additional_metrics": metrics}, {"name": "b", "mean": 0.0}]}
    frame = read(doc)
    assert frame.transform(lambda d: reports.caveats(d, ["run"])).first().caveats == ["slow"]
    got = reports.variants(frame, ["run"]).collect()
    assert [(r.variant, r.error, r.priority) for r in got] == [("a", 0.5, 2.0)]
    assert reports.metadata(frame, ["run"]).first().game_version == "1.0"


def test_gain_needs_a_baseline_above_zero(spark):
    rows = [("x", "s", 1, 100.0, 80.0), ("x", "s", 5, 400.0, 150.0), ("y", "s", 5, 1.0, 1.0), ("z", "s", 1, 0.0, 1.0)]
    got = {(r.build, r.targets): r.funnel_gain for r in cells.with_baseline_gain(spark.createDataFrame(rows, "build string, scenario string, targets int, dps double, priority double")).collect()}
    assert got == {("x", 1): 0.8, ("x", 5): 1.5, ("y", 5): None, ("z", 1): None}


def test_burst_needs_a_full_window(spark):
    rows = [("a", k, 1.0 if k < 30 else 4.0) for k in range(40)] + [("c", k, 0.0) for k in range(20)]
    frame = spark.createDataFrame(rows, "k string, at int, v double")
    got = {r.k: r.burst for r in cells.rolling_burst(frame, ["k"], "at", "v", 40).collect()}
    assert got["c"] is None and abs(got["a"] - 2.5 / 1.75) < 1e-12
    short = cells.rolling_burst(frame.where("at < 19"), ["k"], "at", "v", 19).collect()
    assert {r.burst for r in short} == {None} and {r.n for r in short} == {19}


def test_bursts_and_bins_of_sparse_series_equal_dense_ones(spark):
    draw = random.Random(3)
    rows = {k: {at: draw.randint(-3, 9) for at in draw.sample(range(100), draw.choice([1, 2, 8, 40]))} for k in range(40)}
    rows |= {40: {5: 7}, 41: {99: 7}, 42: {0: -4, 50: 9}, 43: {19: 1, 39: 1}}
    frame = spark.createDataFrame([(k, at, Decimal(v)) for k, series in rows.items() for at, v in series.items()] + [(0, 300, Decimal(50))], "k int, at int, v decimal(10,2)")
    burst = {r.k: r.burst for r in cells.rolling_burst(frame, ["k"], "at", "v", 100).collect()}
    bins = {(r.k, r.bin): r["mean"] for r in cells.binned(frame, ["k"], "at", "v", 100, 24).collect()}
    for k, series in rows.items():
        dense = [series.get(at, 0) for at in range(100)]
        most, mean = max(sum(dense[e - 19 : e + 1]) for e in range(19, 100)), sum(dense) / 100
        assert (burst[k] is None) == (mean <= 0) and (mean <= 0 or abs(burst[k] - most / 20 / mean) < 1e-9), k
        assert [bins[k, b] for b in range(5)] == [sum(dense[24 * b : 24 * b + 24]) / len(dense[24 * b : 24 * b + 24]) for b in range(5)]


def test_the_first_of_a_group_are_cut_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("string").alias("name"), F.col("id").cast("double").alias("v"), F.lit(1.0).alias("e"))
    for out in (
        compare.winner_and_runner_up(rows, ["k"], "name", "v", "e"), cells.top_with_other(rows, ["k"], "name", "v", 3), gear.best_sets(rows.select("k", F.array("name").alias("items"), F.col("v").alias("dps"), F.col("e").alias("error")), ["k"]),
        kills.earliest_kills(rows.select("k", F.col("name").alias("code"), F.col("v").alias("at"), F.col("v").alias("fight")), 2, ("k",)), compare.best_by(rows, ["k"], "v", ["name"], ["name"]),
    ):
        assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_an_equal_gap_is_a_tie_and_not_decisive(spark):
    rows = [("t", "a", 110.0, 10.0), ("t", "b", 99.0, 0.0), ("u", "a", 5.0, 0.0)]
    got = {r.k: r for r in compare.winner_and_runner_up(spark.createDataFrame(rows, "k string, name string, v double, e double"), ["k"], "name", "v", "e").collect()}
    assert got["t"].margin == 11.0 and got["t"].noise == 11.0 and not got["t"].decisive and got["u"].runner_up is None


def test_statistics_are_null_where_undefined(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 6.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0), ("c", 1.0, 2.0)]
    frame = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r.rho for r in stats.rank_agreement(frame, ["g"], "x", "y").collect()}
    assert got == {"a": 1.0, "b": None, "c": None}
    p, u = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double").agg(stats.interpolated("x", 0.95), stats.upper_median("x")).first()
    assert round(p, 9) == 8.95 and u == 3.0
    assert stats.mode_high(spark.createDataFrame([("g", 3), ("g", 3), ("g", 9), ("g", 9), ("g", 1)], "k string, v int"), ["k"], "v").first().mode == 9
    assert stats.variance_explained(frame.where("g = 'b'"), "g", "x").first().explained is None


def test_text_functions(spark):
    one = spark.range(1)
    got = one.select(
        text.slugify(F.lit("Frost & Fire"), F.lit(None).cast("string"), F.lit(""), F.lit("X-2")).alias("a"), text.normal_name(F.lit("Salt & 'Iron'")).alias("b"), text.titled(F.lit("one_tWO")).alias("c"),
        text.href_id(F.lit("https://h/data/item/123?x"), "item").alias("d"), text.href_id(F.lit("https://h/data/spell/1"), "item").alias("e"), text.commit_subject(F.lit("[Core] Fix it (#42)")).alias("f"),
        (text.tier_order(F.lit("AB10")) > text.tier_order(F.lit("AB9"))).alias("g"), text.initials(F.lit("big bad wolf")).alias("h"), text.short_label(F.lit("abcdef"), 4).alias("i"), text.endpoint(F.lit("/a/b/c/d")).alias("j"),
    ).first()
    assert (got.a, got.b, got.c, got.d, got.e) == ("frost_fire_x_2", "saltandiron", "One TWO", 123, None)
    assert got.f[:] == ("Core", "Fix it", 42) and got.g and (got.h, got.i, got.j) == ("BB", "abc…", "c")


def test_bit_streams(spark):
    nodes = [(9, 2, 1), (1, 1, 1), (4, 3, 4)]
    word = bits.encode_one(2, 300, {1: (1, 0), 4: (2, 3)}, nodes)
    assert bits.decode_one(word, nodes) == {"version": 2, "spec": 300, "picks": [{"node": 1, "rank": 1, "entry": 0}, {"node": 4, "rank": 2, "entry": 3}], "error": None}
    frame = spark.createDataFrame([(word,), ("?",), (None,), ("C",)], "w string")
    got = [r.d for r in frame.select(bits.decoded(F.col("w"), nodes).alias("d")).collect()]
    assert got[0].spec == 300 and got[1].error == "unknown letter ?" and got[2].error == "missing" and got[3].picks == []


def hand_written(spec, *fields):
    """A stream from its fields' bits, by the format alone: version 2, the spec, an arbitrary hash, then the fields."""
    low_first = lambda x, n: format(x, f"0{n}b")[::-1]
    all_bits = low_first(2, 8) + low_first(spec, 16) + "10" * 64 + "".join(fields)
    letters = [all_bits[k : k + 6].ljust(6, "0") for k in range(0, len(all_bits), 6)]
    return "".join(bits.ALPHABET[int(x[::-1], 2)] for x in letters)


def test_bit_streams_by_hand():
    read = lambda nodes, *fields: bits.decode_one(hand_written(62, *fields), nodes)
    picks = lambda *x: [(p["node"], p["rank"], p["entry"]) for p in read(*x)["picks"]]
    assert read([(10, 2, 1)], "1100")["spec"] == 62 and picks([(10, 2, 1)], "1100") == [(10, 2, 0)]
    assert picks([(10, 3, 1)], "10") == [(10, 1, 0)]  # granted, so not at its highest rank
    assert picks([(10, 3, 1)], "111", "010000", "0") == [(10, 2, 0)]
    assert picks([(10, 1, 2)], "1101", "10") == [(10, 1, 1)]
    assert read([(10, 1, 1)], "1101", "11")["error"] == "node 10 has no entry 3"
    assert picks([(30, 1, 1), (10, 1, 1), (20, 1, 1)], "1100", "0", "1100") == [(10, 1, 0), (30, 1, 0)]
    assert bits.decode_one("D" + "A" * 24, [])["error"] == "version 3"
    assert picks([(10, 1, 1), (11, 1, 1)], "10") == [(10, 1, 0)]  # zeros past the end


def test_merging_keeps_what_is_newest_and_measured(spark):
    rows = [("a", "2024-02", 1), ("a", "2024-10", 2), ("b", None, 3), ("b", "2024-01", 4)]
    got = {r.k: r.v for r in merge.last_write_wins(spark.createDataFrame(rows, "k string, s string, v int"), ["k"], "s", ["v"]).collect()}
    assert got == {"a": 2, "b": 4}
    new, old = spark.createDataFrame([("a", 1, "n"), ("b", 2, "n")], "k string, v int, at string"), spark.createDataFrame([("a", 1, "o"), ("b", 1, "o")], "k string, v int, at string")
    once = merge.settled(new, old, ["k"], ["at"])
    assert {(r.k, r["at"]) for r in once.collect()} == {("a", "o"), ("b", "n")}
    assert {(r.k, r["at"]) for r in merge.settled(new.withColumn("at", F.lit("later")), once, ["k"], ["at"]).collect()} == {("a", "o"), ("b", "n")}
    target, stay = merge.moved(old.where("k = 'a'"), new, ["k"])
    assert target.count() == 2 and [r.k for r in stay.collect()] == ["a"]
    both = merge.resumed(old, new.where("k = 'b'"), ["k"])
    assert {(r.k, r["at"]) for r in both.collect()} == {("a", "o"), ("b", "n")}


@pytest.mark.parametrize("n", [1, 2, 3, 6, 7, 20])
def test_shards_part_rows_exactly_once(spark, n):
    rows = spark.range(57).withColumn("k", F.col("id") * 7 % 57)
    parts = [[r.id for r in catalog.shard(rows, ["k"], i, n).collect()] for i in range(n)]
    assert sorted(sum(parts, [])) == list(range(57)) and max(map(len, parts)) - min(map(len, parts)) <= 1
    with pytest.raises(ValueError):
        catalog.shard(rows, ["k"], n, n)


def test_owners_survive_cycles_and_stars(spark):
    edges = [(k, k - 1 if k else None) for k in range(40)] + [(100, 101), (101, 100), (102, 100), (103, 102), (200, None), (300, 999)]
    edges += [(1000 + k, 5) for k in range(3000)] + [(5000 + k, 200) for k in range(3000)] + [(9000 + k, 5000 + k % 7) for k in range(300)]
    got = {r.node: (r.root, r.depth) for r in catalog.owners(spark.createDataFrame(edges, "node long, parent long"), "node", "parent").collect()}
    want = {k: (0, k) for k in range(40)} | {200: (200, 0), 300: (999, 1)} | {1000 + k: (0, 6) for k in range(3000)}
    assert got == want | {5000 + k: (200, 1) for k in range(3000)} | {9000 + k: (200, 2) for k in range(300)}
    assert catalog.owners(spark.createDataFrame([], "node long, parent long"), "node", "parent").count() == 0


def test_gate_order(spark):
    rows = [(1.0, True, False, 2.0, 9, None), (None, True, False, 2.0, 2, None), (None, False, False, 2.0, 9, "low"), (1.0, True, True, 2.0, 9, None), (1.0, False, False, 1.0, 9, None), (None, False, False, 1.0, 9, None)]
    frame = spark.createDataFrame(rows, "stored double, hand boolean, fills boolean, value double, n int, withheld string")
    got = [tuple(r.g) for r in frame.select(rules.gate(*(F.col(c) for c in frame.columns)).alias("g")).collect()]
    assert got == [("blocked", True), ("hold", False), ("hold", False), ("eligible", False), ("supersedes", False), ("new", False)]
    facts = spark.createDataFrame([("a", 1.0, True), ("b", 1.0, False), ("c", None, True)], "k string, value double, by_hand boolean")
    news = spark.createDataFrame([("a", 5.0, "eligible"), ("b", 5.0, "supersedes"), ("c", 5.0, "new"), ("d", 5.0, "new"), ("e", 1.0, "hold")], "k string, value double, state string")
    assert {r.k: r.value for r in rules.promoted(facts, news, ["k"]).collect()} == {"a": 1.0, "b": 5.0, "c": 5.0, "d": 5.0}


def test_text_scans(spark):
    texts = spark.createDataFrame(
        [("p", 'mage="Some One"\nspec=frost\nrole=spell\nhead=,id=1,ilevel=700\nneck=,id=2,level=12\n'), ("q", "# nothing"),
         ("t", 'static x items[] = {\n { 1, "a, b", 0x10 },\n { 2, "c" },\n};\nenum { FOO_BAR = 12, BAZ = 3, };'),
         ("u", "#profile=a\n#spec=x\n\n#save=a\nreal=1\n#profile=b\n#spec=y\nreal=2\n")], "file string, text string")
    got = scans.profiles(texts, ["mage", "druid"]).collect()
    assert [(r["class"], r.name, r.spec, r.role, r.item_levels) for r in got] == [("mage", "Some One", "frost", "spell", [700])]
    assert scans.damage_roles(scans.profiles(texts, ["mage"])).count() == 1
    assert [(r.a, r.b) for r in scans.table_rows(texts.where("file = 't'"), ["a", "b", "c"]).collect()] == [("1", "a, b")]
    assert {(r.name, r.id) for r in scans.enum_ids(texts.where("file = 't'")).collect()} >= {("FOO_BAR", 12), ("BAZ", 3)}
    assert [r.block for r in scans.commented_blocks(texts).collect()] == ["profile=a\nspec=x\n\nsave=a"]
    log = scans.delimited_log(spark.createDataFrame([("h|2024-01-02|a | b",), ("bad",), ("i|2024-01-03|update generated files x",)], "value string"))
    people, robots = scans.without_automated(log)
    assert [r.subject for r in people.collect()] == ["a | b"] and robots.first().automated == 1


def test_payloads_of_every_wrapping(spark):
    rows = ["[1,2]", '{"data": [1,2]}', '{"data": {"entries": [1,2]}}', '{"data": {"series": [1,2]}}', '"[1,2]"', "no", None, '{"x": 1}']
    frame = spark.createDataFrame([(r,) for r in rows], "p string").select(F.size(scans.unwrapped(F.col("p"))).alias("n"))
    assert [r.n for r in frame.collect()] == [2, 2, 2, 2, 2, None, None, None]


def test_tiers_on_disk(spark, tmp_path):
    rows = spark.createDataFrame([("AB2", "x", 1), ("AB10", "y", 2), ("AB10", "z", 3)], "tier string, build string, v int")
    path = str(tmp_path / "d")
    sinks.write_documents(rows, path)
    sinks.write_documents(rows.where("build = 'y'").withColumn("v", F.lit(9)), path)
    got = sinks.read_tiers(spark, path, "build STRING, v INT")
    assert {(r.tier, r.build, r.v) for r in got.collect()} == {("AB2", "x", 1), ("AB10", "y", 9)}
    assert {(r.tier, r.current) for r in sinks.tier_index(rows).collect()} == {("AB2", False), ("AB10", True)}
    assert len(sinks.manifest(rows, ["build"], ["v"], {"mode": "m"}).where("tier = 'AB10'").first().builds) == 2
