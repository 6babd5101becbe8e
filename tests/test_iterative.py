import numpy as np
import pytest

from bagmeter.config import LABELS
from bagmeter.operators import iterative, solvers


@pytest.mark.parametrize("pass_bytes", [10**9, 4000])
def test_energy_distance_over_all_training_rows(spark, monkeypatch, pass_bytes):
    monkeypatch.setattr(iterative, "PASS_BYTES", pass_bytes, raising=False)
    rng = np.random.default_rng(8)
    x = {"N": np.vstack([rng.normal(0, 1, (500, 3)), np.zeros((5, 3))]), "V": rng.normal(1, 2, (300, 3)), "A": rng.normal(-2, 1, (30, 3))}
    train = spark.createDataFrame([(1000 * j + i, y, v.tolist()) for j, y in enumerate(x) for i, v in enumerate(x[y])], "instance_id long, y string, f array<double>")
    test = np.vstack([rng.normal(0, 1, (20, 3)), rng.normal(1, 2, (20, 3))])
    rows = [(k, test[i].tolist()) for k in range(3) for i in rng.choice(40, 30)]
    got = {(r["k"], r["label"]): r["p_pred"] for r in iterative.energy_distance(train, spark.createDataFrame(rows, "k int, f array<double>"), ["k"], "f").collect()}
    far = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    names = list(x)
    between = np.array([[far(x[a], x[b]).sum() / (len(x[a]) * (len(x[b]) - (a == b))) for b in names] for a in names])
    for k in range(3):
        bag = np.array([v for at, v in rows if at == k])
        p = solvers.energy_shares(between, np.array([far(bag, x[y]).mean() for y in names]))
        assert [got[k, y] for y in names] == pytest.approx(list(p), abs=1e-6)
        assert all(got[k, y] == 0 for y in LABELS if y not in names)


def test_solvers_take_many_bags_at_once():
    rng = np.random.default_rng(2)
    c = rng.dirichlet(np.ones(6), 4).T
    q = rng.dirichlet(np.ones(4), 50) @ c.T + rng.normal(0, 0.01, (50, 6))
    q[3] = np.nan
    one = np.array([solvers.least_squares(c, v) for v in q])
    assert np.allclose(solvers.least_squares(c, q), one, atol=1e-9) and np.allclose(one.sum(axis=1), 1)
    q = np.abs(np.nan_to_num(q))
    start = np.full(4, 0.25)
    assert np.allclose(solvers.hellinger_mixture(c, q, start), [solvers.hellinger_mixture(c, v, start) for v in q], atol=1e-12)
    v = rng.normal(0, 2, (40, 5))
    assert np.allclose(solvers.to_simplex(v), [solvers.to_simplex(x) for x in v]) and np.allclose(solvers.to_simplex(v).sum(axis=1), 1)


def test_large_bags_take_rounds_over_all_tasks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.ones(3), 600).round(6)
    rows = [(i % 2, "NVA"[int(x.argmax())], [float(v) for v in x]) for i, x in enumerate(p)]
    df = spark.createDataFrame(rows, "k int, y string, p array<double>")
    labels = ("N", "V", "A")
    results = []
    for limit in (10**6, 100):
        monkeypatch.setattr(iterative, "WHOLE_BAG", limit)
        monkeypatch.setattr(solvers, "EM_TOLERANCE", 1e-5)
        results.append({(r["k"], r["label"]): r["p_pred"] for r in iterative.emq(df, df.where("k = 1 or y <> 'N'"), ["k"], labels).collect()})
    assert results[0].keys() == results[1].keys() and len(results[0]) == 6
    assert all(abs(results[0][k] - results[1][k]) < 1e-3 for k in results[0])


def test_squared_distances_are_one_product():
    rng = np.random.default_rng(4)
    a, b, w = rng.normal(0, 1, (700, 20)), rng.normal(0.5, 2, (515, 20)), rng.integers(1, 4, 515).astype(float)
    square = ((a[:, None] - b[None]) ** 2).sum(-1)
    left, right = iterative.folded(a, b)
    assert np.allclose(left @ right, square, atol=1e-10)
    got = iterative.distance_sums(a, [(b, w), (np.zeros((0, 20)), np.zeros(0)), (a, np.ones(700))])
    assert np.allclose(got[:, 0], np.sqrt(square) @ w, rtol=1e-12) and not got[:, 1].any()
    assert np.allclose(got[:, 2], np.sqrt(((a[:, None] - a[None]) ** 2).sum(-1)).sum(1), rtol=1e-8)


def test_energy_distance_by_series_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = {"N": rng.normal(0, 1, 20), "V": rng.normal(0, 1, 20)}
    x = {y: np.vstack([rng.normal(c, 0.8, (3000, 20)), rng.normal(centre["NV"[y == "N"]], 0.8, (15, 20)), np.tile(c + 0.1, (40, 1))]) for y, c in centre.items()}
    train = spark.createDataFrame([(y, v.tolist()) for y in x for v in x[y]], "y string, f array<double>")
    rows = [(k, rng.normal(centre["NV"[i % 4 == 0]], 0.8).tolist()) for k in range(4) for i in range(30)]
    bags = spark.createDataFrame(rows, "k int, f array<double>")
    blocks, results, stage = [], [], iterative.stage
    monkeypatch.setattr(iterative, "stage", lambda df, name: blocks.append(name) or stage(df, name))
    for limit, part in ((10**9, 1e-5), (1000, 1e-4), (1000, 0.0)):
        monkeypatch.setattr(iterative, "SERIES_ROWS", limit, raising=False)
        monkeypatch.setattr(iterative, "LAST_PART", part, raising=False)
        results.append({(r["k"], r["label"]): r["p_pred"] for r in iterative.energy_distance(train, bags, ["k"], "f").collect()})
    assert blocks.count("series-distances") == 2
    assert results[1].keys() == results[0].keys() == results[2].keys()
    assert max(abs(results[1][k] - results[0][k]) for k in results[0]) < 5e-5  # by series, 3,000 rows a class
    assert results[1] != results[0]
    assert max(abs(results[2][k] - results[0][k]) for k in results[0]) < 1e-9  # a series that isn't close enough isn't used
