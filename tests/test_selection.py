"""Order statistics by selection against plain sorting."""

import random
from math import ceil, floor

import pytest

from gaugeworks.operators import selection as S

SHARES = {"median": 0.5, "p25": 0.25, "p95": 0.95, "least": 0.0, "most": 1.0, "upper": S.UPPER_MEDIAN}


def quantile(values, share):
    values = sorted(values)
    if share == S.UPPER_MEDIAN:
        return values[len(values) // 2]
    at = share * (len(values) - 1)
    return values[floor(at)] * (1 - at + floor(at)) + values[ceil(at)] * (at - floor(at))


@pytest.mark.parametrize("large", [2, 40, 10_000])
def test_selection_equals_sorting(spark, large):
    draw = random.Random(2)
    groups = {
        "even": [draw.random() for _ in range(3000)],
        "ties": [float(draw.randint(0, 3)) for _ in range(2000)],
        "one": [7.5] * 500,
        "two": [1.0] * 300 + [2.0] * 300,
        "far": [draw.random() * 10 ** draw.randint(-200, 200) for _ in range(700)],
        "few": [3.0, 1.0, 2.0, 9.0],
        "single": [4.0],
        None: [float(k) for k in range(101)],
    }
    rows = [(g, k % 2, v) for g, values in groups.items() for k, v in enumerate(values)] + [("none", 0, None), ("few", 0, None)]
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, "grp string, part int, x double")
    got = {r.grp: r for r in S.order_statistics(frame, ["grp"], "x", SHARES, large).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert (got[g].n, got[g].low, got[g].high) == (len(values), min(values), max(values))
        for name, share in SHARES.items():
            assert got[g][name] == pytest.approx(quantile(values, share), rel=1e-12), (g, name)


def test_no_keys_several_keys_and_no_rows(spark):
    frame = spark.createDataFrame([(k % 3, k % 2, k) for k in range(1000)], "n int, share int, v long")
    whole = S.order_statistics(frame, [], "v", {"median": 0.5}, 10).collect()
    assert [tuple(r) for r in whole] == [(1000, 0, 999, 499.5)]
    both = {(r[0], r[1]): r.q for r in S.order_statistics(frame, ["share", "n"], "v", {"q": 0.5}, 10).toDF("share", "m", "n", "low", "high", "q").collect()}
    assert both == {(s, n): quantile([k for k in range(1000) if k % 3 == n and k % 2 == s], 0.5) for s in range(2) for n in range(3)}
    assert S.order_statistics(frame.where("v < 0"), ["n"], "v", {"q": 0.5}).count() == 0
    spread = S.spreads(frame, ["share"], "v").orderBy("share").collect()
    assert [tuple(r) for r in spread] == [(0, 499.0, 0, 998, 500), (1, 500.0, 1, 999, 500)]
