import random

import pytest

from bagmeter.operators.skew import balanced_key_stats, dominant_keys

SCHEMA = "split string, y string, unit long, rec string, member string, pid int, n_rows int"


def _got(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    out = balanced_key_stats(df, ["split", "y"], "unit", "rec", "member", **more)
    return {(r["split"], r["y"]): tuple(r)[2:] for r in out.collect()}


def _brute(rows):
    groups = {}
    for s, y, u, r, m, *_ in rows:
        if u is not None:
            groups.setdefault((s, y), []).append((u, r, m))
    return {
        k: (len(v), len({u for u, *_ in v}), len({r for _, r, _ in v if r is not None}), len({m for *_, m in v if m is not None}))
        for k, v in groups.items()
    }


@pytest.mark.parametrize("partitions", [1, 3, 16])
@pytest.mark.parametrize("batch", [10_000, 7])
def test_equals_brute_force(spark, partitions, batch):
    rnd = random.Random(partitions)
    rows = []
    for u in range(900):
        key = ("a", "N") if u < 500 else (rnd.choice(["a", "b", None]), rnd.choice(["N", "V", "v", None]))
        rec = None if u % 50 == 0 else "one" if u < 300 else f"r{rnd.randint(0, 20)}"
        rows.append((*key, u, rec, rnd.choice(["s", "t", None]), 1, 2))
    rows += rows[:200] + [("a", "N", None, "x", "y", 0, 0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert _got(spark, rows, partitions=partitions) == _brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    assert _got(spark, []) == {}


def test_dominant_keys_count_null_in_the_total(spark):
    rows = [("a", y, i, "r", "m", 0, 0) for i, y in enumerate(["N"] * 6 + ["V"] * 2 + [None] * 12)]
    stats = balanced_key_stats(spark.createDataFrame(rows, SCHEMA), ["split", "y"], "unit", "rec", "member")
    assert [r["y"] for r in dominant_keys(stats, "split", "y", 0.1).collect()] == ["N"]
