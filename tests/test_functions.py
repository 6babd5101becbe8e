import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bagmeter.functions import arrays, ranks
from bagmeter.functions.rng import uniform
from bagmeter.functions.text import canonical_id, known_id, plain_name, strip_blanks
from bagmeter.functions.zones import find_zone
from bagmeter.operators import solvers


def _column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_ids(spark):
    values = ["rec-0000312", "Rec 312", "REC/00312", " rec_312\t", "rec0000312", "mon-0", "P-123456789", "", "unknown", None, "312"]
    want = ["rec-0000312"] * 5 + ["mon-0000000", "p-123456789", None, None, None, None]
    assert _column(spark, values, "string", canonical_id) == want
    assert _column(spark, ["P-0000000", "p 9999999", "P-9999", "N/A"], "string", known_id) == [None, None, "p-0009999", None]


def test_names(spark):
    assert _column(spark, [" hdy\t", "", None], "string", plain_name) == ["HDY", "", None]
    assert _column(spark, [" N \t", "n"], "string", strip_blanks) == ["N", "n"]


@pytest.mark.parametrize("label,value,zone", [("V", 0.0, 0), ("V", 0.049, 0), ("V", 0.05, 1), ("V", 0.35, 2), ("V", 1.0, 2), ("V", -0.05, 0), ("L", 0.01, 1), ("R", 0.0, 0), ("N", 0.5, None)])
def test_zones(spark, label, value, zone):
    assert spark.range(1).select(find_zone(F.lit(label), F.lit(value)).alias("z")).first()["z"] == zone


def test_row_normalizations(spark):
    rows = [[1.0, 2.0, 4.0], [5.0, 5.0], [3.0]]
    z = _column(spark, rows, "array<double>", arrays.zscore)
    m = _column(spark, rows, "array<double>", arrays.minmax)
    for a, x, y in zip(rows, z, m):
        a = np.array(a)
        assert np.allclose(x, (a - a.mean()) / (a.std() + 1e-8)) and np.allclose(y, (a - a.min()) / (a.max() - a.min() + 1e-8))


def test_pad_and_interpolate(spark):
    rows = [[1.0, 3.0], [2.0], [0.0, 1.0, 4.0, 9.0]]
    assert _column(spark, rows, "array<double>", lambda a: arrays.pad(a, 3)) == [[1.0, 3.0, 0.0], [2.0, 0.0, 0.0], [0.0, 1.0, 4.0, 9.0]]
    got = _column(spark, rows, "array<double>", lambda a: arrays.interpolate(a, 7))
    for a, g in zip(rows, got):
        assert np.allclose(g, np.interp(np.linspace(0, 1, 7), np.linspace(0, 1, len(a)), a))


def test_bins_at_their_edges(spark):
    edges = arrays.uniform_edges(10)
    values = [0.0, 0.3, 0.6, 0.7, 0.95, 1.0, -1.0, 2.0]
    want = np.clip(np.searchsorted([i / 10 for i in range(11)], values, side="right") - 1, 0, 9).tolist()
    assert _column(spark, values, "double", lambda v: arrays.bin_of(v, edges)) == want


def test_uniform_depends_on_keys_only(spark):
    df = spark.range(2000)
    a = {r["id"]: r["u"] for r in df.select("id", uniform(7, "x", F.col("id")).alias("u")).collect()}
    b = {r["id"]: r["u"] for r in df.repartition(7).select("id", uniform(7, "x", F.col("id")).alias("u")).collect()}
    assert a == b and abs(np.mean(list(a.values())) - 0.5) < 0.02 and 0 <= min(a.values()) and max(a.values()) < 1


def test_ranks_and_running_sums(spark):
    rows = [("a" if i % 3 else None, (i * 37) % 101, i, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v long, t long, x double")
    out = ranks.ranked(df, ["g"], F.col("v"), ["t"], "at", "size", buckets=5)
    total = ranks.running_sum(out, ["g"], "at", "x", "upto", chunk=7)
    for g in ("a", None):
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        got = sorted((r for r in total.collect() if r["g"] == g), key=lambda r: r["at"])
        assert [r["t"] for r in got] == [r[2] for r in want] and {r["size"] for r in got} == {len(want)}
        assert np.allclose([r["upto"] for r in got], np.cumsum([r[3] for r in want]))
    assert ranks.ranked(df.where("false"), ["g"], F.col("v"), ["t"]).collect() == []


vectors = st.lists(st.floats(-10, 10), min_size=1, max_size=8)


@given(vectors)
def test_simplex_point(v):
    p = solvers.to_simplex(np.array(v))
    assert (p >= 0).all() and math.isclose(p.sum(), 1, abs_tol=1e-9)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 5))
def test_least_squares_finds_the_mixture(seed, k):
    rng = np.random.default_rng(seed)
    c = rng.dirichlet(np.ones(k) * 0.5, k).T + np.eye(k)
    p = rng.dirichlet(np.ones(k))
    assert np.allclose(solvers.least_squares(c, c @ p), p, atol=1e-4)


@pytest.mark.parametrize("c", [np.zeros((3, 3)), np.ones((3, 3)), np.full((3, 3), np.nan)])
def test_degenerate_systems_give_a_point_of_the_simplex(c):
    p = solvers.least_squares(c, np.array([0.2, 0.3, 0.5]))
    assert (p >= 0).all() and p.sum() == pytest.approx(1)


def test_mixture_and_em_recover_shares():
    rng = np.random.default_rng(1)
    c = rng.dirichlet(np.ones(20), 3).T
    p = np.array([0.6, 0.3, 0.1])
    assert np.allclose(solvers.hellinger_mixture(c, c @ p, np.ones(3) / 3, rounds=20_000, tolerance=1e-14), p, atol=0.01)
    y = rng.choice(3, 4000, p=p)
    x = rng.normal(y, 0.7)
    like = np.exp(-0.5 * ((x[:, None] - np.arange(3)) / 0.7) ** 2)
    posterior = like / like.sum(axis=1, keepdims=True)
    assert np.allclose(solvers.expectation_maximization(posterior, np.ones(3) / 3), np.bincount(y) / 4000, atol=0.04)


def test_energy_shares():
    between = np.array([[0.0, 4.0], [4.0, 0.0]])
    assert np.allclose(solvers.energy_shares(between, between @ np.array([0.3, 0.7])), [0.3, 0.7], atol=1e-4)


def test_order_bits_equal_the_bits_of_a_double(spark):
    import math
    import random
    import struct

    rnd = random.Random(3)
    values = [0.0, -0.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), 1.0, math.nextafter(1.0, 0), 8.0, math.nextafter(8.0, 9)]
    values += [2.0**e for e in range(-1074, 1024)] + [math.nextafter(2.0**e, 0) for e in range(-1073, 1024)]
    values += [struct.unpack("d", struct.pack("q", rnd.randrange(0x7FF << 52)))[0] for _ in range(2000)]
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    for r in df.select("v", ranks.order_bits(F.col("v")).alias("b")).collect():
        if r["v"] is None or r["v"] != r["v"]:
            assert r["b"] is None
        else:
            bits = struct.unpack("q", struct.pack("d", abs(r["v"])))[0]
            assert r["b"] == (bits if r["v"] >= 0 else -bits), r["v"]


def test_percentiles_equal_numpy(spark):
    import random

    rnd = random.Random(5)
    data = {"a": [rnd.random() for _ in range(301)], None: [2.0] * 50 + [3.0], "b": [7.0]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("a", None), ("z", None), ("a", float("nan"))], "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.999, 1.0]
    got = {(r["g"], r["prob"]): r["value"] for r in ranks.percentiles(df, ["g"], F.col("v"), probs).collect()}
    assert len(got) == 15 and all(abs(got[k, p] - np.quantile(vs, p)) < 1e-12 for k, vs in data.items() for p in probs)
    assert ranks.percentiles(df.where("false"), [], F.col("v"), probs).collect() == []
    assert {r["prob"]: r["value"] for r in ranks.percentiles(df.where("g = 'b'"), [], F.col("v"), [0.5]).collect()} == {0.5: 7.0}
