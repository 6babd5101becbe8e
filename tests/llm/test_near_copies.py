import random

import pytest

from bagmeter.llm import near_copies

SCHEMA = "unit long, split string, features array<double>, key long, id string"


def _rows(seed=0):
    rnd = random.Random(seed)
    rows, unit = [], 0
    for _ in range(60):
        base = [round(rnd.gauss(0, 1), 3) for _ in range(20)]
        rows.append((unit, "train", base, 1, "x"))
        for k in range(6):
            other = [round(v + rnd.choice([-0.02, -0.011, 0, 0.013, 0.02]), 3) for v in base]
            for i in rnd.sample(range(20), k):
                other[i] = rnd.choice([other[i] + 1.5, None, float("nan")])
            unit += 1
            rows.append((unit, rnd.choice(["valid", "test", "train", None]), other, 2, "y"))
        unit += 1
    return rows


def _brute(rows):
    def whole(f):
        return f is not None and len(f) == 20 and not (None not in f and len(set(f)) == 1)

    def near(a, b):
        return a is not None and b is not None and abs(a - b) <= 0.02 + 1e-9

    train = [(u, f) for u, s, f, *_ in rows if s == "train" and whole(f)]
    rest = [(u, f) for u, s, f, *_ in rows if s in ("valid", "test") and whole(f)]
    return {(a, b) for a, f in train for b, g in rest if sum(map(near, f, g)) >= 17}


def _found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r["train_id"], r["other_id"]) for r in near_copies.near_copies(df, "unit", "split", "features", "train", ["valid", "test"]).collect()}


@pytest.mark.parametrize("hot", [4096, 6, 0])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(near_copies, "HOT", hot)
    monkeypatch.setattr(near_copies, "SLOTS", 1 << 10)
    rows = _rows()
    want = _brute(rows)
    assert len(want) > 50 and _found(spark, rows) == want


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BROADCAST_PAIRS", 0)
    rows = _rows(1)
    assert _found(spark, rows) == _brute(rows)


def test_flat_short_null_and_repeated_rows(spark):
    a, flat = [i / 10 for i in range(20)], [0.5] * 20
    rows = [(1, "train", a, 0, ""), (1, "train", a, 0, ""), (2, "test", a, 0, ""), (2, "test", a, 0, ""), (3, "train", flat, 0, ""), (4, "test", flat, 0, "")]
    rows += [(5, "test", a[:19], 0, ""), (6, "test", None, 0, ""), (7, "test", [], 0, ""), (None, "test", a, 0, ""), (8, "test", [None] * 20, 0, "")]
    assert _found(spark, rows) == {(1, 2)}
    assert _found(spark, []) == set()


def test_many_copies_of_one_vector(spark):
    a = [i / 7 for i in range(20)]
    b = [v + 0.01 for v in a]
    rows = [(i, "train", a, 0, "") for i in range(400)] + [(1000 + i, "test", b, 0, "") for i in range(3)] + [(2000 + i, "train", b, 0, "") for i in range(5)]
    assert _found(spark, rows) == {(t, o) for t in [*range(400), *range(2000, 2005)] for o in range(1000, 1003)}


def test_minima_are_shared_within_the_tolerance():
    import numpy as np

    rnd = np.random.default_rng(1)
    for scale in (1.0, 1e-3, 1e6, 1e14, 1e15, 1e300):
        x = rnd.normal(0, scale, 3000)
        y = np.clip(x + rnd.choice([-0.02, 0.02, 0.011, 0.0], 3000), x - 0.02, x + 0.02)
        agree = np.abs(x - y) <= 0.02 + 1e-9
        (_, own), *_ = near_copies.signature(y, 3, False)
        shared = np.zeros(3000, bool)
        for mask, minimum in near_copies.signature(x, 3, True):
            shared |= mask & (minimum == own)
        assert shared[agree].all() and agree.sum() > 500
    far = near_copies.signature(np.arange(1000.0), 3, False)[0][1]
    assert len(set(far.tolist())) > 900  # values that are apart have other minima
    assert near_copies._minima(np.array([0, 10**15]), 3).tolist() == [near_copies._minima(np.array([i]), 3)[0] for i in (0, 10**15)]


def test_report_counts_pairs_by_class(spark):
    rows = _rows(3) + [(5000 + i, "train", _rows(3)[0][2], 0, "") for i in range(50)]
    rows = [r for r in rows] + rows[:10]
    where = {r[0]: r[1] for r in rows}
    want = {}
    for _, o in _brute(rows):
        pairs, units = want.setdefault(where[o], [0, set()])
        want[where[o]][0] += 1
        units.add(o)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["split"]: (r["pairs"], r["units"]) for r in near_copies.copy_report(df, "unit", "split", "features", "train", ["valid", "test"], ["split"]).collect()}
    assert got == {k: (n, len(u)) for k, (n, u) in want.items()}


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e6, 1e14, 1e15, 1e300])
def test_sketches_of_near_vectors_may_agree(spark, scale):
    import numpy as np

    rnd = np.random.default_rng(2)
    x = rnd.normal(0, scale, (2000, 20))
    y = np.clip(x + rnd.choice([-0.02, 0.02, 0.011, 0.0], x.shape), x - 0.02, x + 0.02)
    far = rnd.normal(0, 1, x.shape)
    for i in range(2000):  # up to three other positions
        y[i, rnd.choice(20, i % 4, replace=False)] = rnd.choice([5.5, np.nan])
    agree = (np.abs(x - y) <= 0.02 + 1e-9).sum(axis=1)
    a, b, c = (near_copies.sketches(v) for v in (x, y, far))
    df = spark.createDataFrame([(int(p), int(q), int(r), int(n)) for p, q, r, n in zip(a, b, c, agree)], "a long, b long, c long, n int")
    got = df.select("n", near_copies.may_agree("a", "b").alias("near"), near_copies.may_agree("a", "c").alias("chance")).collect()
    assert all(r["near"] for r in got if r["n"] >= 17) and sum(r["n"] >= 17 for r in got) > 300
    assert sum(r["chance"] for r in got) < 20


def test_chance_pairs_and_bucket_rows_of_all_bands_are_not_kept(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["train", "test"]), [rnd.choice([0.1, 0.9]) + round(rnd.random() / 100, 3) for _ in range(20)], 0, "") for i in range(1500)]
    vectors = near_copies.comparable(spark.createDataFrame(rows, SCHEMA), "unit", "split", "features", "train", ["test"])
    most = []
    real = near_copies._buckets
    monkeypatch.setattr(near_copies, "_buckets", lambda v, p, some, hot: most.append(len(some)) or real(v, p, some, hot))
    pairs = near_copies._candidates(vectors).count()
    assert pairs <= 2 * len(_brute(rows)) + 50
    assert max(most[2:]) == 2
