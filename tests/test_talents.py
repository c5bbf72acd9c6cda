"""Talent streams against a trait table, by hand-made trees."""

from pyspark.sql import functions as F

from gaugeworks.functions import bits
from gaugeworks.operators import talents as T
from tests.test_cells import hand_written

ROWS = "line int, class int, node int, entry int, rank int, tree int, sub_tree int, tiered boolean, specs array<int>, name string"


def table(spark, *rows):
    """(node, entry) with what differs from a plain class node; the order given is the file's."""
    plain = {"class": 1, "rank": 1, "tree": 1, "sub_tree": 0, "tiered": False, "specs": [0, 0], "name": "n"}
    names = [f.split(" ")[0] for f in ROWS.replace("array<int>", "a").split(", ")]
    full = [plain | {"line": k, "node": n, "entry": e} | more for k, (n, e, more) in enumerate(rows)]
    return T.placed_traits(spark.createDataFrame([tuple(r[c] for c in names) for r in full], ROWS), "line")


def read(spark, traits, spec, *fields, of_class=1):
    streams = spark.createDataFrame([("b", of_class, hand_written(spec, *fields))], "id string, class int, stream string")
    got = T.read_streams(streams, traits)
    return got, T.selections(got, traits)


def test_entries_keep_the_order_of_the_file(spark):
    traits = table(spark, (10, 7, {"rank": 1}), (10, 3, {"rank": 2}), (20, 9, {"rank": 2, "tiered": True}), (20, 4, {"rank": 3, "tiered": True}), (30, 1, {"tree": 6}))
    assert {(r.node, r.top, r.entries) for r in T.nodes(traits).collect()} == {(10, 1, 2), (20, 5, 2)}
    wanted = spark.createDataFrame([(1, 62, None)], "class int, spec int, sub_tree int")
    assert {(r.node, r.max_rank, tuple(r.entries)) for r in T.layout(traits, wanted).collect()} == {(10, 1, (7, 3)), (20, 5, (9, 4))}


def test_a_stream_names_an_entry_by_its_place(spark):
    traits = table(spark, (10, 7, {"name": "First"}), (10, 3, {"name": "Second"}), (20, 5, {}))
    _, picks = read(spark, traits, 62, "1101", "10", "1100")
    assert {(r.node, r.entry, r.name) for r in picks.collect()} == {(10, 3, "Second"), (20, 5, "n")}
    got, picks = read(spark, traits, 62, "1101", "01")
    assert [r.error for r in got.where("node IS NULL").collect()] == ["node 10 has no entry 2"] and picks.count() == 0


def test_nodes_come_by_ascending_id_and_other_trees_hold_no_bits(spark):
    traits = table(spark, (30, 300, {"name": "Third"}), (10, 100, {"name": "First"}), (15, 1, {"tree": 6}), (20, 200, {"name": "Second"}), (12, 1, {"class": 2}))
    _, picks = read(spark, traits, 62, "1100", "0", "1100")
    assert [r.name for r in picks.orderBy("node").collect()] == ["First", "Third"]


def test_hero_nodes_are_narrowed_to_the_chosen_sub_tree(spark):
    hero = {"tree": 3}
    traits = table(spark, (10, 100, hero | {"sub_tree": 33}), (20, 200, hero | {"sub_tree": 32}), (30, 300, {"tree": 4, "sub_tree": 33}), (40, 1, {"rank": 2}))
    _, picks = read(spark, traits, 251, "1100", "1100", "1100", "1100")
    assert T.chosen_sub_trees(picks, ["id"]).first().chosen == 33
    assert tuple(T.points(picks, ["id"]).first()) == ("b", 2, 0, 1, True)
    _, undecided = read(spark, traits, 251, "1100", "1100", "0", "0")
    assert tuple(T.points(undecided, ["id"]).first()) == ("b", 0, 0, 2, True)


def test_layouts_hold_what_a_spec_can_take(spark):
    traits = table(
        spark, (10, 100, {"tree": 2, "specs": [62, 0]}), (20, 200, {"tree": 2, "specs": [63, 0]}), (30, 300, {"tree": 3, "sub_tree": 33, "specs": [62]}), (30, 301, {"tree": 3, "sub_tree": 32, "rank": 3}),
        (40, 400, {"tree": 4, "sub_tree": 33}), (50, 500, {}), (60, 600, {"specs": [63]}), (60, 601, {"rank": 2}),
    )
    wanted = spark.createDataFrame([(1, 62, 33), (1, 63, 32), (1, 64, None)], "class int, spec int, sub_tree int")
    seen = {}
    for r in T.layout(traits, wanted).collect():
        seen.setdefault(r.spec, {})[r.node] = (r.max_rank, r.entries)
    assert seen[62] == {10: (1, [100]), 30: (1, [300]), 50: (1, [500]), 60: (2, [601])}
    assert seen[63] == {20: (1, [200]), 30: (3, [301]), 50: (1, [500]), 60: (1, [600, 601])}
    assert seen[64] == {50: (1, [500]), 60: (2, [601])}


def test_builds_are_refused_for_what_they_hold(spark):
    traits = table(spark, (10, 100, {"specs": [71]}), (20, 200, {"specs": [72]}), (30, 300, {"tree": 3, "sub_tree": 33, "specs": [250]}), (40, 400, {"tree": 4, "sub_tree": 33, "name": "0"}))
    word = lambda spec, *fields: hand_written(spec, *fields)
    streams = [("bad", 1, word(71, "1100", "1100")), ("fine", 1, word(71, "1100", "0", "1100", "1100")), ("old", 1, "D" + "A" * 24), ("none", 1, None), ("sign", 1, "?"), ("other", 9, word(1))]
    frame = spark.createDataFrame(streams, "id string, class int, stream string")
    got = T.read_streams(frame, traits)
    picks = T.selections(got, traits)
    assert {r.id: r.reason for r in T.refused(got, picks, ["id"]).collect()} == {
        "bad": "Selected node 20 entry 200 is not available to player's spec", "old": "version 3", "none": "missing", "sign": "unknown letter ?"
    }
    index = T.spec_index(picks, spark.createDataFrame([(33, "Tree")], "sub_tree int, name string"), T.refused(got, picks, ["id"]))
    assert [r.builds for r in index.collect()] == ["""[{"id":"bad","refused":"Selected node 20 entry 200 is not available to player's spec"},{"id":"fine","subTree":33,"hero":"Tree"}]"""]


def test_headers_by_columns_alone(spark):
    frame = spark.createDataFrame([(hand_written(300),), ("?AAA",), ("A?",), ("C",)], "w string")
    got = [tuple(r.h) for r in frame.select(bits.header(F.col("w")).alias("h")).collect()]
    assert got == [(2, 300), (None, None), (None, None), (2, 0)]
