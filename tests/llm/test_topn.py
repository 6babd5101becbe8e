import random

import pytest

from bagmeter.llm.topn import limits, top_n
from pyspark.sql import functions as F

SCHEMA = "g string, s double, t string, place string, n int"


def _got(spark, rows, n):
    out = top_n(spark.createDataFrame(rows, SCHEMA), ["g"], "s", ["t"], n)
    return sorted(((r["g"], r["place"], r["s"], r["t"]) for r in out.collect()), key=repr)


def _brute(rows, n):
    groups = {}
    for r in set(rows):
        if r[1] is not None and r[1] == r[1]:
            groups.setdefault(r[0], []).append(r)
    out = []
    for g, rs in groups.items():
        rs.sort(key=lambda r: (r[1], r[2] is not None, r[2] or ""))
        out += [(g, i + 1, r[1] + 0.0, r[2]) for i, r in enumerate(rs[:n])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("part", [10_000, 20])
def test_equals_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr("bagmeter.llm.topn.BROADCAST_GROUPS", part - 20)
    monkeypatch.setattr("bagmeter.llm.topn.RANK_ROWS", part)
    rnd = random.Random(4)
    rows = [("hot", rnd.choice([0.1, 0.1, 0.2, rnd.random(), -1e6, 3e300]), f"t{i}", "p", 1) for i in range(400)]
    rows += [("hot", 0.05, f"u{i:03d}", "p", 1) for i in range(150)]
    rows += [(f"g{i % 30}", rnd.random(), f"t{i}", "p", 1) for i in range(100)] + rows[:20]
    rows += [(None, 1.0, None, None, None), (None, 1.0, "a", None, None), ("x", None, "a", "", 1), ("x", float("nan"), "a", "", 1), ("y", float("inf"), "a", "", 1)]
    for n in (1, 5, 200):
        assert _got(spark, rows, n) == _brute(rows, n)


def test_empty(spark):
    assert _got(spark, [], 3) == []


def test_limits_drop_most_rows_and_none_of_the_first(spark):
    rnd = random.Random(5)
    rows = [(f"g{i % 3}", rnd.random() * 10.0 ** (i % 7), f"t{i}", "p", 1) for i in range(3000)]
    rows += [("copies", 0.5, "t", "p", 1)] * 100 + [("copies", 0.7, f"t{i}", "p", 1) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r["g"]: r for r in limits(df, ["g"], "s", F.xxhash64(*df.columns), 3).collect()}
    assert all(3 <= found[f"g{i}"]["kept"] <= 60 for i in range(3))
    assert found["copies"]["kept"] == 103  # a hundred equal rows are one
