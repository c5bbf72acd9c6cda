"""Queries against plain loops over whole tables."""

from collections import defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from gaugeworks import queries as base
from gaugeworks.queries import fights

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def test_best_pairs_are_those_of_all_items_of_a_brand(spark):
    pools = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/part.parquet").collect():
        pools[r.p_brand].append((r.p_partkey, r.p_size, round(float(r.p_retailprice) * 100)))
    best, gap, most, beyond = {}, {}, {}, {}
    for brand, pool in pools.items():
        pairs = [(-(g + h + 1000 * abs(x - y)), i, j) for (i, x, g), (j, y, h) in combinations(sorted(pool), 2)]
        first, second = sorted(pairs)[:2]
        best[brand], gap[brand] = (first[1], first[2], -first[0] / 100), (second[0] - first[0]) / 100
        for t, i, j in pairs:
            for item in (i, j):
                most[brand, item] = max(most.get((brand, item), 0), -t / 100)
        top = {i for i, _, _ in sorted(pool, key=lambda p: (-p[2], p[0]))[:2]}
        if not top & {first[1], first[2]}:
            beyond[brand] = f"{first[1]}/{first[2]}"
    got = lambda name: base.queries()[name](spark, SF).collect()
    assert {r.brand: (r.item_a, r.item_b, r.total) for r in got("best_set")} == best
    assert {r.brand: (r.dps, r.gap) for r in got("best_sets")} == {b: (best[b][2], round(gap[b], 2)) for b in best}
    assert {(r.brand, r.item): r.dps for r in got("best_with_item")} == most
    assert {r.brand: r.best_key for r in got("beyond_one_swap")} == beyond


def test_fights_are_sampled_at_sixty_points(spark):
    steps = defaultdict(list)
    for r in base.queries()["concurrency_steps"](spark, SMALL).collect():
        steps[r.fight].append((r.t, r.n))
    until = {r.fight: r.window for r in fights.windows_of(fights.fight_lives(spark, SMALL)).collect()}
    want = {}
    for fight, window in until.items():
        for b in range(60):
            past = [s for s in steps[fight] if s[0] <= window * (b + 0.5) / 60]
            want[fight, b] = max(past)[1] if past else 0
    samples = fights._samples(spark, SMALL).collect()
    assert {(r.fight, r.bucket): r.n for r in samples} == want
    shapes, owner = defaultdict(list), {}
    for r in samples:
        owner[r.fight] = r.encounter
        shapes[r.fight].append((r.bucket, r.n))
    apart = lambda a, b: sum(abs(x[1] - y[1]) >= 1 for x, y in zip(sorted(a), sorted(b), strict=True)) / 60
    pairs = {(a, b): round(apart(shapes[a], shapes[b]), 9) for a, b in combinations(sorted(owner), 2) if owner[a] == owner[b]}
    found = base.queries()["shape_distance"](spark, SMALL)
    assert {(r.fight_a, r.fight_b): round(r.distance, 9) for r in found.collect()} == pairs


def test_patterns_have_the_label_of_their_medoid_and_a_row_for_each_encounter(spark, tmp_path):
    rows = base.queries()["shape_patterns"](spark, SMALL).collect()
    get = lambda name: base.queries()[name](spark, SMALL).collect()
    stats = {r.fight: r for r in get("concurrency_stats")}
    chosen = {r.encounter: r.fight for r in get("representative")}
    sizes = defaultdict(list)
    for r in get("medoid"):
        sizes[r.encounter].append((r.medoid, r["size"]))
    want = set()
    for encounter, found in sizes.items():
        large = [f for f in found if f[1] >= 2]
        want |= {(encounter, *f) for f in large or found if large or f[0] == chosen[encounter]}
    assert {(r.encounter, r.pattern, r.pulls) for r in rows} == want
    assert {r.encounter for r in rows} == set(chosen)
    assert any(not stats[r.pattern].constant for r in rows)
    assert all(stats[r.pattern].constant for r in rows if r.label.endswith("throughout"))
    # one fight of each cluster: all pulls differ, so each encounter has its representative alone
    ev = fights.events(spark, SMALL).where(F.col("fight").isin([f for found in sizes.values() for f, _ in found]))
    spark.read.parquet(f"{SMALL}/events.parquet").join(ev.select("event_id"), "event_id", "left_semi").write.parquet(f"{tmp_path}/events.parquet")
    alone = base.queries()["shape_patterns"](spark, str(tmp_path)).collect()
    lone = {r.encounter: r.fight for r in base.queries()["representative"](spark, str(tmp_path)).collect()}
    assert {r.encounter: r.pattern for r in alone} == lone and {r.pulls for r in alone} == {1} and set(lone) == set(sizes)
