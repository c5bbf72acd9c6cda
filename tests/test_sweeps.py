"""The gear sweep by hand-made pools."""

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import sweeps

VALUE = {1: 50, 2: 40, 3: 30, 11: 60, 12: 45}
TOGETHER = {(2, 3): 35, (1, 11): -100}  # what two items are worth beyond their sum


def run_of(spark, asked, lost=()):
    """A measure that keeps what it was asked, and has no result for some (group, variant)."""

    def run(variants):
        rows = variants.collect()
        asked.extend((r.g, r["round"], r.variant) for r in rows)
        out = []
        for r in rows:
            items = tuple(sorted(r["items"]))
            level = 0 if r.level is None or not any(i > 10 for i in items) else r.level - 330
            if (r.g, r.variant) not in lost:
                out.append((r.g, r.variant, 1000.0 + sum(VALUE[i] for i in items) + TOGETHER.get(items, 0) + level, 1.0))
        return spark.createDataFrame(out, "g string, variant string, dps double, error double")

    return run


def pools(spark, *groups):
    farmed = spark.createDataFrame([(g, i, i) for g in groups for i in (1, 2, 3)], "g string, item long, place long")
    drops = spark.createDataFrame([(g, i, level, 100 + i) for g in groups for i in (11, 12) for level in (331, 340)], "g string, item long, level int, place long")
    return farmed, drops


@pytest.mark.parametrize("budget,method,sets", [(17, "full", 3 + 2 * 7), (16, "baseline", 3), (2, "additive", 0)])
def test_branches(spark, budget, method, sets):
    asked = []
    out = sweeps.gear_sweep(*pools(spark, "a"), ["g"], run_of(spark, asked), budget)
    base = out.baseline.first()
    assert base.method == method and sum(v.startswith("set:") for _, _, v in asked) == sets
    worn, weaker = ([1, 2], 2) if method == "additive" else ([2, 3], 3)  # together 2 and 3 are worth more than 1 and 2
    assert (base["items"], base.replaced, base.reason) == (worn, weaker, None)
    assert base.dps == (1090.0 if method == "additive" else 1105.0) and (base.drift is None) == (method == "additive")
    gains = {(r.item, r.level): r.dps for r in out.candidates.collect()}
    kept = next(i for i in worn if i != weaker)
    assert gains == {(i, level): 1000.0 + VALUE[kept] + VALUE[i] + TOGETHER.get(tuple(sorted((kept, i))), 0) + level - 330 for i in (11, 12) for level in (331, 340)}
    tops = {r.level: (r["items"], r.dps, r.runner_up, r.is_baseline) for r in out.ceilings.collect()}
    want = {331: ([11, 12], 1106.0, 1105.0, False), 340: ([11, 12], 1115.0, 1110.0, False)}
    assert tops == (want if method == "full" else {})
    pool = {r.item: (r.gain, r.best_combination, r.chosen) for r in out.pool.collect()}
    assert pool[1] == (50.0, None if method == "additive" else 1090.0, 1 in worn)


def test_a_group_that_fails_leaves_the_others(spark):
    farmed, drops = pools(spark, "fine", "no empty", "no standard", "one left")
    farmed = farmed.union(spark.createDataFrame([("small", 1, 1)], farmed.schema))
    lost = {("no empty", "empty"), ("no standard", "standard"), ("one left", "solo:1"), ("one left", "solo:3")}
    out = sweeps.gear_sweep(farmed, drops, ["g"], run_of(spark, [], lost), 17)
    assert {r.g: r.reason for r in out.baseline.collect()} == {
        "fine": None, "no empty": "no result for the empty reference", "no standard": "no result for the baseline", "one left": "only 1 of 3 pool items returned a result",
        "small": "only 1 eligible items; need 2 to form a baseline",
    }
    assert {r.g for r in out.candidates.select("g").collect()} == {"fine"}


def test_counts_pair_no_item_with_itself(spark):
    farmed = spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], "g string, item long, place long")
    drops = spark.createDataFrame([("a", 2, 1), ("a", 5, 1), ("b", 9, 1)], "g string, item long, level int")
    assert [tuple(r) for r in sweeps.combination_counts(farmed, drops, ["g"]).collect()] == [("a", 2, 1, 1 + 3 + 1)]
    assert sweeps.combination_counts(farmed, drops.limit(0), ["g"]).select(F.col("full")).first()[0] == 1
