import numpy as np
from pyspark.sql import functions as F

from bagmeter.operators import split


def test_more_groups_than_the_driver_took(spark):
    n = 200_001
    df = spark.range(n).select(F.col("id").alias("g"), F.when(F.col("id") % 10 == 0, "V").otherwise("N").alias("y"))
    sides, _ = split.guaranteed_split(df, "g", "y", 0.3, 0)
    by = {(r["side"], r["y"]): r["count"] for r in sides.join(df, "g").groupBy("side", "y").count().collect()}
    assert sum(by.values()) == n
    assert abs(by["test", "V"] - 20_001 / 3) <= 1 and abs(by["test", "N"] - 180_000 / 3) <= 1


def test_folds_are_those_of_the_greedy_rule(spark):
    rng = np.random.default_rng(4)
    matrix = rng.integers(0, 50, (60, 3))
    rows = [(g, "NVA"[c]) for g in range(60) for c in range(3) for _ in range(matrix[g, c])]
    got = {r["g"]: r["fold"] for r in split.stratified_folds(spark.createDataFrame(rows, "g int, y string"), "g", "y", 5).collect()}
    matrix = matrix[:, [2, 0, 1]]
    held, totals = np.zeros((5, 3)), matrix.sum(axis=0)
    for g in sorted(range(60), key=lambda g: (-(3 * (matrix[g] ** 2).sum() - matrix[g].sum() ** 2), g)):
        costs = []
        for k in range(5):
            held[k] += matrix[g]
            costs.append((round(float((held / totals).std(axis=0).mean()), 12), held[k].sum()))
            held[k] -= matrix[g]
        best = min(range(5), key=costs.__getitem__)
        held[best] += matrix[g]
        assert got[g] == best
