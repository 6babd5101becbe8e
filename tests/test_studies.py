import numpy as np
import pytest
from pyspark.sql import functions as F

from bagmeter.functions import filters
from bagmeter.functions.text import duration_text
from bagmeter.operators import calibration, metrics, scoring, split


def test_filter_chain_keeps_the_band_only(spark):
    fs, n = 360.0, 3600
    t = np.arange(n) / fs
    wave = lambda f: np.sin(2 * np.pi * f * t)
    inner = slice(720, -720)
    power = lambda x: float(np.sqrt((x[:, inner] ** 2).mean()))
    kept, mains, drift, high = (filters.both_ways(*filters.band_pass(fs), filters.both_ways(*filters.notch(fs), wave(f)[None])) for f in (10, 50, 0.1, 120))
    assert power(kept) == pytest.approx(np.sqrt(0.5), rel=0.02) and max(map(power, (mains, drift, high))) < 0.03
    assert np.abs(kept[0, inner] - wave(10)[inner]).max() < 0.05  # no delay
    with pytest.raises(ValueError):
        filters.both_ways(*filters.band_pass(fs), np.zeros((1, 20)))
    base = filters.without_baseline(np.full((2, 500), 3.0), fs)
    assert np.allclose(base[:, 100:-100], 0)
    rows = [(1, fs, wave(10).tolist()), (2, fs, [1.0] * 10), (3, None, wave(10).tolist()), (4, fs, None), (5, 90.0, wave(10).tolist())]
    df = spark.createDataFrame(rows, "id int, fs double, s array<double>")
    got = {r["id"]: r["y"] for r in df.select("id", filters.filtered(F.col("s"), F.col("fs")).alias("y")).collect()}
    assert np.allclose(got[1], filters.filter_chain(wave(10)[None], fs)[0]) and [got[i] for i in (2, 3, 4, 5)] == [None] * 4


def test_duration_text(spark):
    want = {5.25: "5.2s", 59.94: "59.9s", 60.0: "0:01:00", 3725.4: "1:02:05", 90_000.0: "1 day, 1:00:00", 172_800.0: "2 days, 0:00:00", None: None}
    df = spark.createDataFrame([(k,) for k in want], "s double")
    assert {r["s"]: r["t"] for r in df.select("s", duration_text(F.col("s")).alias("t")).collect()} == want


def test_scores_are_checked(spark):
    good = [("N", [0.5, 0.5]), ("V", [1.0, -1e-10])]
    check = lambda rows: metrics.check_scores(spark.createDataFrame(rows, "y string, p array<double>"), "y", "p", ["N", "V"])
    check(good)
    for bad in ([], [*good, ("N", [1.0])], [*good, ("x", [0.5, 0.5])], [*good, (None, [0.5, 0.5])], [*good, ("N", [1.1, 0.0])], [*good, ("N", [None, 0.0])], [*good, ("N", None)]):
        with pytest.raises(ValueError):
            check(bad)


def _long(spark, n=3000, power=3.0, seed=4):
    """Overconfident scores of three labels, in five folds."""
    rng = np.random.default_rng(seed)
    p = rng.dirichlet(np.ones(3), n)
    y = np.array([rng.choice(3, p=v) for v in p])
    sharp = p**power / (p**power).sum(axis=1, keepdims=True)
    rows = [(i, i % 5, "ANV"[k], float(sharp[i, k]), int(y[i] == k)) for i in range(n) for k in range(3)]
    return spark.createDataFrame(rows, "unit int, fold int, label string, p double, is_true int")


@pytest.mark.parametrize("method", calibration.METHODS)
def test_cross_fitted_maps_lower_the_error(spark, method):
    df = _long(spark)
    fitted = calibration.cross_fitted(df, list(range(5)), method, ["A", "N", "V"], "unit").toPandas()
    loss = lambda q: float(((q - fitted["is_true"]) ** 2).mean())
    assert len(fitted) == 9000 and loss(fitted["q"]) < loss(fitted["p"]) - 0.01


def test_folds_are_calibrated_before_the_mean(spark):
    held = _long(spark)
    apply = held.where("fold < 3").withColumn("fold", F.explode(F.array(*map(F.lit, range(5))))).select("unit", "fold", "label", "p")
    out = calibration.calibrated_folds(held, apply, list(range(5)), ["A", "N", "V"], "unit").toPandas()
    assert len(out) == 1800 * 3 and np.allclose(out.groupby("unit")["q"].sum(), 1)
    rare = held.where("not (label = 'V' and is_true = 1 and fold <> 2)")
    assert calibration.missing_labels(rare, [0, 1, 2], ["A", "N", "V"]) == {0: [], 1: [], 2: ["V"]}


def _beats(spark, n=240):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(n):
        k = i % 3
        rows.append((i, "train" if i % 4 else "test", i % 2 if i % 4 else None, "NVA"[k], [float(v) for v in rng.normal(0, 1, 4) + 3 * np.eye(4)[k]]))
    return spark.createDataFrame(rows, "instance_id long, split string, fold int, y string, features array<double>")


@pytest.mark.parametrize("kind", ["LR", "SVM"])
def test_trained_score_vectors(spark, kind):
    out = scoring.trained_scores(_beats(spark), kind, 2, ["instance_id", "split", "y"], ("N", "V", "A"), maxIter=20).toPandas()
    assert len(out) == 240 and (out["pred"] == out["y"]).mean() > 0.9 and np.allclose(np.vstack(out["p"]).sum(axis=1), 1)


def test_grid_puts_the_best_first(spark):
    grid = scoring.parameter_grid(regParam=[1e-3, 10.0], maxIter=[20])
    assert len(grid) == 2
    best = scoring.grid_scores(_beats(spark), "LR", "N", 2, grid)
    assert best[0][0]["regParam"] == 1e-3 and best[0][1] < best[1][1]


def test_calibration_splits(spark):
    df = spark.createDataFrame([(i, "NV"[i % 3 == 0], f"g{i % 12}") for i in range(300)] + [(999, None, "g0")], "id long, y string, g string")
    plain = split.make_splits(df, "y", "id", 5, seed=3)
    counts = {(r["fold"], r["y"]): r["count"] for r in plain.groupBy("fold", "y").count().collect()}
    assert counts == {(f, y): n for f in range(5) for y, n in (("N", 40), ("V", 20))}
    grouped = split.make_splits(df.where("y is not null"), "y", "id", 4, "g")
    assert grouped.count() == 300 and grouped.select("g", "fold").distinct().count() == 12


def test_groups_beyond_the_head_are_dealt_by_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(split, "HEAD", 20)
    rng = np.random.default_rng(9)
    rows = [(g, "NVA"[int(c)]) for g in range(400) for c in rng.choice(3, rng.integers(1, 30), p=[0.7, 0.2, 0.1])]
    df = spark.createDataFrame(rows, "g int, y string")
    folds = split.stratified_folds(df, "g", "y", 4, 1)
    assert folds.count() == 400 == folds.select("g").distinct().count()
    by = df.join(folds, "g").groupBy("y").pivot("fold").count().toPandas().set_index("y")
    share = by.div(by.sum(axis=1), axis=0)
    assert (share - 0.25).abs().max().max() < 0.06


def test_public_names():
    import bagmeter
    from bagmeter import pipeline

    assert all(getattr(bagmeter, n) is not None for n in bagmeter.__all__)
    with pytest.raises(AttributeError):
        bagmeter.nothing
    every = pipeline.methods()
    assert len(every) == 8 * 16 + 3 and "RF-ACC" in every and "HDx" in every and len(set(every)) == len(every)
