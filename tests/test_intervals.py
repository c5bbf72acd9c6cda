import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import intervals as I
from gaugeworks.operators import shapes as H

HIT = "fight long, t double, actor long, instance long, amount double, duration double"
DEATH = "fight long, t double, actor long, instance long, source_actor long, source_instance long"


def test_a_death_ends_a_life_even_after_the_fight(spark):
    hits = spark.createDataFrame([(1, 1.0, 5, None, 2.0, 10.0), (1, 12.0, 5, 0, 2.0, 10.0), (1, 3.0, 6, 0, 1.0, 10.0), (1, 4.0, 7, 1, 1.0, 10.0)], HIT)
    deaths = spark.createDataFrame([(1, 11.0, 6, 0, None, None), (1, 12.5, 6, 0, None, None), (1, 2.0, None, None, 7, 1), (1, 5.0, 9, 0, None, None)], DEATH)
    got = {r.actor: (r.first, r.last, r.died, r.total) for r in I.lives(hits, deaths).collect()}
    assert got == {5: (1.0, 10.0, False, 4.0), 6: (3.0, 11.0, True, 1.0), 7: (4.0, 4.0, True, 1.0)}


def plain_steps(spans):
    moves = defaultdict(int)
    for a, b in spans:
        moves[a] += 1
        moves[b] -= 1
    out, n = [], 0
    for t in sorted(moves):
        n += moves[t]
        if not out or out[-1][1] != n:
            out.append((t, n))
    return ([(0.0, 0)] if out and out[0][0] > 0 else []) + out


def test_concurrency_equals_a_sweep(spark):
    rng = random.Random(3)
    spans = [(f, a := rng.randint(0, 40) / 2, a + rng.choice([0, 0.5, 3, 9])) for f in range(12) for _ in range(rng.randint(1, 9))]
    got = defaultdict(list)
    for r in I.concurrency(spark.createDataFrame(spans, "fight long, first double, last double")).collect():
        got[r.fight].append((r.t, r.n))
    for f in range(12):
        assert sorted(got[f]) == sorted(plain_steps([(a, b) for g, a, b in spans if g == f]))


def plain_pairs(rows, duration):
    open_, out = None, []
    for t, kind in rows:
        if kind == "start":
            open_ = t if open_ is None else open_
        elif kind == "end":
            out.append((0.0 if open_ is None else open_, t, open_ is None))
            open_ = None
    return out + ([(open_, duration, True)] if open_ is not None else [])


@pytest.mark.parametrize("seed", range(3))
def test_pairing_equals_a_state_machine_in_any_input_order(spark, seed):
    rng = random.Random(seed)
    rows = [(k, n, float(n // 2), rng.choice(["start", "end", "refresh"]), rng.randint(0, 3)) for k in range(15) for n in range(rng.randint(1, 12))]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k long, seq long, t double, kind string, source long").withColumn("duration", F.lit(50.0)).repartition(3)
    got = defaultdict(list)
    for r in I.paired(frame, ["k"], ["t", "seq"]).collect():
        got[r.k].append((r.start, r.end, r.truncated))
    for k in range(15):
        own = sorted((n, t, kind) for j, n, t, kind, _ in rows if j == k)
        assert sorted(got[k]) == sorted(plain_pairs([(t, kind) for _, t, kind in own], 50.0))


def test_touching_windows_merge(spark):
    rows = [(1, 0.0, 2.0, False), (1, 2.0, 3.0, True), (1, 2.5, 2.6, False), (1, 3.5, 4.0, False)]
    got = I.merged(spark.createDataFrame(rows, "k long, start double, end double, truncated boolean"), ["k"]).orderBy("start").collect()
    assert [(r.start, r.end, r.windows, r.truncated) for r in got] == [(0.0, 3.0, 3, True), (3.5, 4.0, 1, False)]


def test_waves_come_again_until_the_length(spark):
    rows = [(1, 10.0, 50.0, 20.0, 100.0), (2, 10.0, None, 200.0, 100.0), (3, 0.0, 10000.0, 5.0, 100.0), (4, 200.0, 5.0, 5.0, 100.0)]
    got = I.planned_waves(spark.createDataFrame(rows, "plan long, first double, cadence double, lasts double, length double")).collect()
    assert sorted((r.plan, r.first, r["last"]) for r in got) == [(1, 10.0, 30.0), (1, 60.0, 80.0), (2, 10.0, 100.0), (3, 0.0, 5.0)]


def test_nomination_order(spark):
    rows = [(1, 1, 10.0), (1, 2, 8.0), (2, 1, 10.0), (2, 2, 9.0), (3, 4, 0.0), (4, 1, 1.0), (4, 2, 0.0)]
    got = {r.fight: (r.actor, r.reason) for r in I.nominated(spark.createDataFrame(rows, "fight long, actor long, total double"), "fight", "actor", "total").collect()}
    assert got == {1: (1, "margin"), 2: (None, "none"), 3: (4, "only"), 4: (1, "margin")}
    named = [
        (1, 2, 1.0, "Big Boss ", "big boss"), (1, 1, 90.0, "Add", "big boss"), (2, 3, 1.0, "The big boss lord", "Big Boss"), (2, 2, 1.0, "boss", "Big Boss"), (2, 1, 9.0, "", "Big Boss"),
        (3, 1, 9.0, None, "Big Boss"), (3, 2, 1.0, "Add", "Big Boss"), (4, 1, 9.0, "x", ""), (4, 2, 8.9, "y", None), (5, 1, 0.0, "x", "z"), (5, 2, 0.0, "y", "z"),
    ]
    frame = spark.createDataFrame(named, "fight long, actor long, total double, name string, encounter string")
    got = {r.fight: (r.actor, r.reason) for r in I.nominated(frame, "fight", "actor", "total", "name", "encounter").collect()}
    assert got == {1: (2, "name"), 2: (2, "name"), 3: (1, "margin"), 4: (None, "none"), 5: (None, "none")}


def test_roles_fold(spark):
    rows = [(["boss"],), (["boss", "add"],), (["unknown", "boss"],), (["unknown", "boss", "add"],), ([],)]
    got = [r.r for r in spark.createDataFrame(rows, "x array<string>").select(I.role_fold(F.col("x")).alias("r")).collect()]
    assert got == ["boss", "mixed", "unknown", "mixed", "unknown"]


def single_link(shapes):
    """Brute force: (cluster, medoid, total, diameter, size) by cluster, and the cluster of each member."""
    apart = lambda x, y: sum(p != q for p, q in zip(x, y, strict=True)) / len(x) if x and y else 1.0
    first = {k: k for k in shapes}
    changed = True
    while changed:
        changed = False
        for j in shapes:
            for k in shapes:
                if j != k and first[j] != first[k] and apart(shapes[j], shapes[k]) < 0.2:
                    first[j] = first[k] = min(first[j], first[k])
                    changed = True
    out = {}
    for c in set(first.values()):
        own = [k for k in shapes if first[k] == c]
        total = {k: round(sum(apart(shapes[k], shapes[j]) for j in own if j != k), 6) for k in own}
        best = min(own, key=lambda k: (total[k], k))
        wide = max([apart(shapes[j], shapes[k]) for j in own for k in own if j != k], default=0.0)
        out[c] = (best, total[best], round(wide, 9), len(own))
    return first, out


def test_clusters_and_medoids_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK", 7)  # many chunks of a bucket meet in pairs
    rng = random.Random(4)
    shapes = {}
    for e in range(3):
        base = [[rng.randint(0, 3) for _ in range(60)] for _ in range(4)]
        for k in range(40):
            shape = list(rng.choice(base))
            for at in rng.sample(range(60), rng.choice([0, 3, 9, 14, 30])):
                shape[at] = rng.randint(0, 3)
            shapes[e, 100 * e + k] = shape
    shapes[9, 900], shapes[9, 901], shapes[9, 902] = [], [], [1] * 60
    frame = spark.createDataFrame([(e, k, s) for (e, k), s in shapes.items()], "encounter long, fight long, shape array<long>")
    found = H.clusters(frame, "encounter", "fight")
    got = {(r.encounter, r.fight): r.cluster for r in found.collect()}
    middle = {(r.encounter, r.cluster): (r.medoid, r.total, round(r.diameter, 9), r["size"]) for r in H.medoids(frame, found, "encounter", "fight").collect()}
    for e in (0, 1, 2, 9):
        first, want = single_link({k: s for (x, k), s in shapes.items() if x == e})
        assert {k: c for (x, k), c in got.items() if x == e} == first
        assert {c: v for (x, c), v in middle.items() if x == e} == want


def test_a_large_group_of_like_shapes_needs_few_links(spark):
    rng = random.Random(6)
    rows = [(1, k, [0] * 50 + [rng.randint(0, 9) for _ in range(10)]) for k in range(2500)]  # all within 10 samples
    frame = spark.createDataFrame(rows, "encounter long, fight long, shape array<long>")
    assert {r.cluster for r in H.clusters(frame, "encounter", "fight").collect()} == {0}


def test_distance_of_empty_shapes_is_one(spark):
    rows = [([1, 2, 3, 4], [1, 3, 3, 6]), ([], [])]
    got = [r.d for r in spark.createDataFrame(rows, "a array<long>, b array<long>").select(H.shape_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [0.5, 1.0]
