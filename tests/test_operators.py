import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bagmeter.config import CLINICAL, CLINICAL_RANGES, LABELS, BagConfig
from bagmeter.functions.arrays import uniform_edges
from bagmeter.operators import bags, calibration, estimators, labels, metrics, scoring, segment, split, stats, timeline


def _bags(spark, n=200, size=500):
    return spark.range(n).selectExpr(f"{size} as bag_size", "cast(id as int) as bag_index")


def test_clinical_bags_keep_their_bands(spark):
    rows = bags.capp_truth(_bags(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["bag_index"], {})[r["label"]] = r
    raw = {(r["bag_index"], r["label"]): r["p_raw"] for r in bags.zone_picks(_bags(spark)).collect()}
    assert len(by) == 200
    for b, ls in by.items():
        assert set(ls) == set(LABELS) and sum(r["n"] for r in ls.values()) == 500
        total = sum(raw[b, x] for x in CLINICAL_RANGES)
        for x, bands in CLINICAL_RANGES.items():
            lo, hi = bands[ls[x]["zone"]]
            assert lo <= raw[b, x] <= hi
            assert abs(ls[x]["n"] / 500 - raw[b, x] / max(1, total)) < 1 / 500 + 1e-9


def test_base_label_that_is_absent(spark):
    config = BagConfig({"V": [(0.0, 0.2)]}, {"V": [1.0]})
    rows = bags.capp_truth(_bags(spark, 5, 100), config, ("A", "L", "V")).collect()
    assert {r["label"] for r in rows} == {"A", "L", "V"} and sum(r["n"] for r in rows) == 500
    with pytest.raises(ValueError):
        BagConfig({"V": [(0.0, 0.2)]}, {"V": [1.0, 2.0]})


def test_app_counts_are_cut(spark):
    rows = bags.app_truth(_bags(spark, 300, 100)).collect()
    positive = {r["bag_index"]: r["n"] for r in rows if r["label"] == 1}
    assert sum(r["n"] for r in rows) == 300 * 100 and abs(np.mean(list(positive.values())) / 100 - 0.5) < 0.06


def test_remainders_go_to_the_later_label_on_ties(spark):
    df = spark.createDataFrame([(1, x, 0.25, 10) for x in "ABCD"], "k int, label string, share double, size int")
    got = {r["label"]: r["n"] for r in bags.largest_remainder(df, ["k"], "label", "share", "size").collect()}
    assert got == {"A": 2, "B": 2, "C": 3, "D": 3}


def test_members_come_from_their_class_and_repeat_by_seed(spark):
    pool = spark.range(100).selectExpr("case when id % 4 = 0 then 'V' else 'N' end as label", "id as unit")
    truth = spark.createDataFrame([(10, 0, "N", 7), (10, 0, "V", 3), (10, 1, "V", 10), (10, 1, "N", 0)], "bag_size int, bag_index int, label string, n int")
    draw = lambda: sorted(tuple(r) for r in bags.members(truth, pool, "unit").collect())
    got = draw()
    assert got == draw() and len(got) == 20
    assert all((u % 4 == 0) == (x == "V") for _, _, x, _, u in got)
    with pytest.raises(ValueError):
        bags.members(truth, pool.where("label = 'N'"), "unit")


def test_zone_crossing_error_by_hand(spark):
    true = {"A": 0.005, "L": 0.0, "N": 0.9, "R": 0.0, "V": 0.06}
    pred = {"A": 0.03, "L": 0.0, "N": 0.8, "R": 0.1, "V": 0.12}
    df = spark.createDataFrame([(1, x, true[x], pred[x]) for x in LABELS], "k int, label string, p_true double, p_pred double")
    assert metrics.zone_crossing_error(df, ["k"]).first()["zce"] == pytest.approx((1 + 0 + 0.5) / 3)
    assert metrics.absolute_error(df, ["k"]).first()["ae"] == pytest.approx(np.mean([abs(true[x] - pred[x]) for x in LABELS]))
    only_n = df.where("label = 'N'")
    assert metrics.zone_crossing_error(only_n, ["k"]).first()["zce"] == 0.0


def test_calibration_error_by_hand(spark):
    rows = [(0, 0.9, 1), (0, 0.9, 0), (0, 0.6, 1), (0, 0.6, 0)]
    df = spark.createDataFrame(rows, "k int, p double, hit int")
    curve = metrics.reliability(df, ["k"], F.col("p"), F.col("hit"), uniform_edges(5))
    assert metrics.calibration_error(curve, ["k"]).first()["ece"] == pytest.approx(0.25)


def test_brier_and_f1(spark):
    df = spark.createDataFrame([(0, "a", [0.7, 0.3]), (0, "b", [0.4, 0.6])], "k int, y string, p array<double>")
    names = F.array(F.lit("a"), F.lit("b"))
    assert metrics.brier(df, ["k"], "y", "p", names).first()["brier"] == pytest.approx((0.18 + 0.32) / 2)
    none = spark.createDataFrame([(0, 0, 0)], "k int, t int, g int")
    r = metrics.f1_accuracy(none, ["k"], F.col("t"), F.col("g")).first()
    assert (r["f1"], r["accuracy"]) == (0.0, 1.0)


def _scored(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    p = np.round(1 / (1 + np.exp(-(rng.normal(y * 2.0 - 1, 1)))), 6)
    return y, p, spark.createDataFrame([("x", float(a), int(a >= 0.5), int(b)) for a, b in zip(p, y)], "label string, p double, is_pred int, is_true int")


def test_estimators_recover_the_share_of_a_shifted_bag(spark):
    _, _, oof = _scored(spark)
    y, p, _ = _scored(spark, 6000, 1)
    keep = np.concatenate([np.flatnonzero(y == 1)[:300], np.flatnonzero(y == 0)[:1200]])
    bag = spark.createDataFrame([(1, "x", float(p[i]), int(p[i] >= 0.5)) for i in keep], "k int, label string, p double, is_pred int")
    plain = estimators.cc(bag, ["k"]).first()["p_pred"]
    assert plain == pytest.approx(float(np.mean(p[keep] >= 0.5)))
    found = {
        "acc": estimators.acc(bag, oof, ["k"]), "pacc": estimators.pacc(bag, oof, ["k"]), "x": estimators.threshold(bag, oof, ["k"], "x"),
        "max": estimators.threshold(bag, oof, ["k"], "max"), "t50": estimators.threshold(bag, oof, ["k"], "t50"),
        "ms": estimators.median_sweep(bag, oof, ["k"]), "hdy": estimators.hdy(bag, oof, ["k"]),
        "dys": estimators.matched(bag, oof, ["k"], "topsoe", 10), "mm": estimators.matched(bag, oof, ["k"], "cdf", 20),
    }
    for name, df in found.items():
        assert abs(df.first()["p_pred"] - 0.2) < 0.05, name


def test_adjusting_without_a_gap_falls_back(spark):
    oof = spark.createDataFrame([("x", 0.5, 1, 1), ("x", 0.5, 1, 0)], "label string, p double, is_pred int, is_true int")
    bag = spark.createDataFrame([(1, "x", 0.4, 0), (1, "x", 0.8, 1)], "k int, label string, p double, is_pred int")
    assert estimators.acc(bag, oof, ["k"]).first()["p_pred"] == 0.5
    assert estimators.median_sweep(bag, oof, ["k"]).first()["p_pred"] == 0.0


def test_normalized_estimates(spark):
    df = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.6), (2, "a", 0.0), (2, "b", -1.0)], "k int, label string, p_pred double")
    got = {(r["k"], r["label"]): r["p_pred"] for r in estimators.normalized(df, ["k"]).collect()}
    assert got[1, "b"] == pytest.approx(0.75) and got[2, "a"] == 0.5


def test_platt_and_temperature(spark):
    rng = np.random.default_rng(3)
    f = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(1.5 * f - 0.5)))).astype(float)
    a, b = calibration.platt(f, y, 1 - y)
    assert (a, b) == (pytest.approx(-1.5, abs=0.1), pytest.approx(0.5, abs=0.1))
    p = 1 / (1 + np.exp(-f))
    hot = spark.createDataFrame([([float(1 - q), float(q)], 2 if rng.random() < r else 1) for q, r in zip(p[:4000], (1 / (1 + np.exp(-f / 3)))[:4000])], "p array<double>, at int")
    assert calibration.fit_temperature(hot, "p", F.col("at")) == pytest.approx(3, abs=0.4)


def test_group_splits(spark):
    rng = np.random.default_rng(0)
    rows = [(f"g{i % 20}", LABELS[int(rng.integers(0, 5))]) for i in range(1000)] + [(None, "N"), ("g1", None)]
    df = spark.createDataFrame(rows, "g string, y string")
    sides = split.stratified_split(df, "g", "y", 0.3, 0).collect()
    assert len(sides) == 20 and 4 <= sum(r["side"] == "test" for r in sides) <= 9
    folds = split.stratified_folds(df, "g", "y", 5, 0).collect()
    assert {r["fold"] for r in folds} == {0, 1, 2, 3, 4}
    assert [split.fold_count(x) for x in (0.4, 0.3, 0.5, 0.9)] == [2, 3, 2, 2]
    hashed = split.hash_split(df, "g", 0.25).collect()
    assert sum(r["side"] == "test" for r in hashed) == 5
    assert split.hash_split(df, "g", 0.0).where("side = 'test'").count() == 0
    joined = df.join(split.stratified_split(df, "g", "y", 0.3, 0), "g")
    assert split.leaking_groups(joined, "g", "side").count() == 0


def test_guaranteed_split(spark):
    rows = [(f"p{i}", x) for i in range(6) for x in "NV" for _ in range(5)] + [("p6", "R")] * 5
    df = spark.createDataFrame(rows, "g string, y string")
    with pytest.raises(RuntimeError):
        split.guaranteed_split(df, "g", "y", 0.3, 0)
    sides, seed = split.guaranteed_split(df, "g", "y", 0.3, 0, ["N", "V"])
    assert sides.count() == 7 and seed >= 0


def test_windows_of_signals(spark):
    df = spark.createDataFrame([("a", [float(i) for i in range(10)], [1, 5, 9]), ("b", None, [1])], "r string, s array<double>, at array<int>")
    got = {r["ann_idx"]: r["segment"] for r in segment.windows(df, ["r"], "s", "at", 4).collect()}
    assert got == {0: [0.0, 1.0, 2.0, 3.0], 1: [3.0, 4.0, 5.0, 6.0], 2: [7.0, 8.0, 9.0, 0.0]}
    with pytest.raises(ValueError):
        segment.windows(df, ["r"], "s", "at", 4, "stretch")


def _diverse(xs, size, classes):
    best = None
    for i in range(len(xs) - size + 1):
        w = [x for x in xs[i : i + size] if x in classes]
        if not w:
            continue
        ps = [w.count(c) / len(w) for c in set(w)]
        s = round(len(ps) - sum(p * math.log(p + 1e-12) for p in ps) / math.log(size), 9)
        if best is None or s > best[1]:
            best = (i, s)
    return best or (0, -1.0)


@pytest.mark.parametrize("chunk", [10_000, 12])
def test_most_diverse_window(spark, monkeypatch, chunk):
    monkeypatch.setattr(timeline, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    seqs = {"a": list(rng.choice(list("NNNNVALRx"), 100)), "b": ["x"] * 15, "c": ["N"] * 4}
    rows = [(k, i, str(x)) for k, xs in seqs.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "k string, t long, y string")
    got = {r["k"]: (r["first_at"], r["score"]) for r in timeline.most_diverse_window(df, "k", F.col("t"), [], "y", list(LABELS), 10).collect()}
    assert got == {k: _diverse(xs, 10, LABELS) for k, xs in seqs.items() if len(xs) >= 10}


def test_wilcoxon_and_spearman(spark):
    df = spark.createDataFrame([(0, v) for v in (3, -1, 2, 2, 0, -4)], "g int, v int")
    r = stats.wilcoxon(df, ["g"], "v").first()
    assert (r["n"], r["w_plus"], r["w_minus"], r["statistic"]) == (5, 2.5 + 2.5 + 4, 1 + 5, 6.0)
    pairs = spark.createDataFrame([(0, 1, 1), (0, 2, 3), (0, 3, 2), (0, 4, 4)], "g int, a int, b int")
    assert stats.spearman(pairs, ["g"], "a", "b").first()["rho"] == pytest.approx(0.8)


def test_label_helpers(spark):
    df = spark.createDataFrame([("N",), ("/",), ("V",), (None,)], "y string")
    assert labels.keep_symbols(df, "y").count() == 2 and labels.keep_symbols(df, "y", "binary").count() == 4
    with pytest.raises(ValueError):
        labels.keep_symbols(df, "y", "other")
    assert [r["b"] for r in df.select(labels.binary_label(F.col("y")).alias("b")).collect()] == [1, 0, 0, 0]
    truth = spark.createDataFrame([(1, "N", 0.7), (1, "V", 0.3), (2, "V", 1.0)], "k int, label string, p double")
    assert [(r["k"], round(r["burden"], 9)) for r in labels.burden(truth, ["k"], "label", "p").collect()] == [(1, 0.3)]


def test_centroids_leave_their_fold_out(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "train", i % 3, "NV"[i % 2], (rng.normal(0, 1, 20) + (i % 2) * 3).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "unit int, split string, fold int, y string, features array<double>")
    models = {r["fold"]: {m["label"]: np.array(m["c"]) for m in r["model"]} for r in scoring.centroids(df.select("fold", "y", "features")).collect()}
    x = np.array([r[4] for r in rows])
    for fold in (-1, 0, 1, 2):
        for label in "NV":
            mine = [i for i, r in enumerate(rows) if r[3] == label and r[2] != fold]
            assert np.allclose(models[fold][label], x[mine].mean(axis=0))
    scored = scoring.centroid_scores(df, scoring.centroids(df.select("fold", "y", "features")))
    hits = [r["pred"] == r["y"] for r in scored.collect()]
    assert np.mean(hits) > 0.95 and CLINICAL.base_label == "N"


def test_aligned_scores(spark):
    df = spark.createDataFrame([([0.2, 0.8],)], "p array<double>")
    assert df.select(scoring.align_scores(F.col("p"), ["A", "N"], ("A", "F", "N")).alias("p")).first()["p"] == [0.2, 0.0, 0.8]


def test_p_values():
    assert stats.wilcoxon_p(0, 0) == 1.0 and stats.wilcoxon_p(10, 27.5) == pytest.approx(1.0)
    assert stats.wilcoxon_p(20, 190) == pytest.approx(0.0017, abs=2e-4)
    assert stats.spearman_p(0.0, 10) == pytest.approx(1.0) and stats.spearman_p(0.6319, 10) == pytest.approx(0.05, abs=5e-4)


def test_nearest_neighbours_leave_their_fold_out(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "train" if i < 80 else "test", i % 4 if i < 80 else None, "NV"[i % 2], (rng.normal(0, 1, 20) + (i % 2) * 4).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "instance_id int, split string, fold int, y string, features array<double>")
    got = {r["instance_id"]: r["p"] for r in scoring.knn_scores(df, ["instance_id"], 3, 80, ("N", "V")).collect()}
    x = np.array([r[4] for r in rows])
    for i, _, fold, *_ in rows:
        others = [j for j in range(80) if rows[j][2] != fold]
        near = sorted(others, key=lambda j: ((x[i] - x[j]) ** 2).sum())[:3]
        assert got[i] == pytest.approx([np.mean([rows[j][3] == c for j in near]) for c in "NV"])
