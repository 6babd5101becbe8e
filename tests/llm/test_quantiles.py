import random

import numpy as np
import pytest

from bagmeter.llm import quantiles

PROBS = [0.0, 0.1, 0.5, 0.9, 1.0]


def _got(spark, rows, **more):
    df = spark.createDataFrame(rows, "g string, x double, n int, lo string")
    return {(r["g"], r["prob"]): r["value"] for r in quantiles.percentiles(df, ["g"], "x", PROBS, **more).collect()}


@pytest.mark.parametrize("limit", [200_000, 0])
@pytest.mark.parametrize("ways", [3, 7])
def test_equals_numpy(spark, monkeypatch, limit, ways):
    monkeypatch.setattr(quantiles, "BROADCAST_INTERVALS", limit)
    rnd = random.Random(1)
    data = {"a": [rnd.random() for _ in range(101)], "b": [rnd.choice([0.1, 0.1 + 1e-16, 0.2, -3.0, 1e9]) for _ in range(40)], None: [7.5], "c": [1.0, 2.0]}
    got = _got(spark, [(g, x, 1, "z") for g, xs in data.items() for x in xs], ways=ways)
    for g, xs in data.items():
        assert np.allclose([got[g, p] for p in PROBS], np.quantile(xs, PROBS), rtol=0, atol=1e-12 * max(map(abs, xs)))


def test_values_that_do_not_count(spark):
    bad = [None, float("nan"), float("inf"), float("-inf")]
    assert _got(spark, [("a", x, 1, "") for x in bad]) == {}
    assert _got(spark, []) == {}
    assert _got(spark, [("a", x, 1, "") for x in [*bad, 3.0, 3.0]]) == {("a", p): 3.0 for p in PROBS}


def test_summaries_of_days_add_up(spark):
    rnd = random.Random(2)
    rows = [("a", day, rnd.random()) for day in range(5) for _ in range(50)]
    df = spark.createDataFrame([*rows, ("a", 1, None), ("a", 1, 2.0)], "g string, day int, x double")
    days = quantiles.summarise(df, ["g"], "day", "x", 0.0, 1.0, 256)
    merged = {r["prob"]: r for r in quantiles.merged_percentiles(days, ["g"], [0.25, 0.5], 0.0, 1.0, 256).collect()}
    exact = sorted(x for *_, x in rows)
    for p, r in merged.items():
        assert r["n"] == 250 and abs(r["value"] - exact[int(p * 249)]) <= r["error"]


def test_wide_ranges_end(spark, monkeypatch):
    passes = []
    narrow = quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda *a: passes.append(1) or narrow(*a))
    far = [-1.7e308, 0.0, 1.7e308]
    got = _got(spark, [("a", x, 1, "") for x in far])
    assert got["a", 0.5] == 0.0 and got["a", 0.0] == far[0] and got["a", 1.0] == far[2]
    assert got["a", 0.1] == pytest.approx(far[0] * 0.8) and len(passes) <= 11
    passes.clear()
    decades = [s * 10.0**e for e in range(-323, 309) for s in (-1, 1)] + [5e-324, 1.0, np.nextafter(1.0, 2), np.nextafter(1.0, 0)]
    got = _got(spark, [("a", float(x), 1, "") for x in decades])
    want = np.quantile(decades, PROBS)
    assert all(got["a", p] == pytest.approx(w, rel=1e-12, abs=5e-324) for p, w in zip(PROBS, want)) and len(passes) <= 11
