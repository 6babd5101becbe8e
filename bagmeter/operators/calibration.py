"""Maps from scores to probabilities, fitted on held-out scores.

All input is long: ``label``, ``p`` (a score of that label), ``is_true``, and ``fold`` for cross-fitting.
Fits are one small model per label (or one for all); applying them is a plain projection.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores are cut to this distance from 0 and 1 before logarithms.
EDGE = 1e-12
#: Equal bins of the log odds to which scores are reduced before a small fit.
FIT_BINS = 4000


def _logit(p: Column) -> Column:
    safe = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p))
    return F.log(safe / (1 - safe))


def _reduced(df: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives per small bin of the score: at most FIT_BINS rows per key, whatever the input."""
    return df.groupBy(*keys, (F.round(F.col("p") * FIT_BINS) / FIT_BINS).alias("p")).agg(
        F.sum("is_true").cast("double").alias("pos"), F.sum(1 - F.col("is_true")).cast("double").alias("neg")
    )


def platt(p: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(a f + b)) for scores f with smoothed targets, by Newton steps with halving."""
    n_pos, n_neg = pos.sum(), neg.sum()
    hi, lo = (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2)
    a, b = 0.0, math.log((n_neg + 1) / (n_pos + 1))

    def loss(a: float, b: float) -> float:
        z = a * p + b
        soft = np.logaddexp(0, z)  # -log of the probability; its complement is soft - z
        return float((pos * (hi * soft + (1 - hi) * (soft - z)) + neg * (lo * soft + (1 - lo) * (soft - z))).sum())

    now = loss(a, b)
    for _ in range(100):
        q = 1 / (1 + np.exp(np.clip(a * p + b, -500, 500)))
        n = pos + neg
        d1 = (pos * hi + neg * lo) - n * q
        d2 = n * q * (1 - q)
        g = np.array([(p * d1).sum(), d1.sum()])
        h = np.array([[(p * p * d2).sum() + 1e-12, (p * d2).sum()], [(p * d2).sum(), d2.sum() + 1e-12]])
        if np.abs(g).max() < 1e-6:
            break
        move, scale = -np.linalg.solve(h, g), 1.0
        while scale > 1e-10 and loss(a + scale * move[0], b + scale * move[1]) > now:
            scale /= 2
        if scale <= 1e-10:
            break
        a, b = a + scale * move[0], b + scale * move[1]
        now = loss(a, b)
    return a, b


def fit_platt(df: DataFrame, keys: list[str]) -> dict[tuple, tuple[float, float]]:
    """Platt's parameters for each key; scores come to the driver as at most FIT_BINS counts per key."""
    groups: dict[tuple, list] = {}
    for r in _reduced(df, keys).collect():
        groups.setdefault(tuple(r[k] for k in keys), []).append((r["p"], r["pos"], r["neg"]))
    return {k: platt(*(np.array(c) for c in zip(*v))) for k, v in groups.items()}


def apply_platt(df: DataFrame, keys: list[str], models: dict[tuple, tuple[float, float]]) -> DataFrame:
    """``df`` with ``q``; a key without a model keeps its score."""
    out = F.col("p")
    for key, (a, b) in sorted(models.items(), key=repr):
        mine = F.lit(True)
        for name, value in zip(keys, key):
            mine = mine & F.col(name).eqNullSafe(F.lit(value))
        out = F.when(mine, 1 / (1 + F.exp(F.lit(float(a)) * F.col("p") + F.lit(float(b))))).otherwise(out)
    return df.withColumn("q", out)


def isotonic(df: DataFrame, apply: DataFrame, label: str) -> DataFrame:
    """``apply`` rows of one label with ``q``: isotonic regression of the truth on the score.

    Rows of one score are one weighted point, which leaves the fit as it is; scores have six decimals, so there are a
    million points at most.
    """
    points = df.where(F.col("label") == label).groupBy(F.round("p", 6).alias("p")).agg(F.avg(F.col("is_true").cast("double")).alias("t"), F.count("*").cast("double").alias("w"))
    fit = points.select(array_to_vector(F.array("p")).alias("x"), "t", "w")
    model = IsotonicRegression(featuresCol="x", labelCol="t", predictionCol="q", weightCol="w").fit(fit)
    return model.transform(apply.where(F.col("label") == label).withColumn("x", array_to_vector(F.array("p")))).drop("x")


def fit_temperature(df: DataFrame, p: str, true_index: Column, grid: int = 15) -> float:
    """The temperature with least log loss of softmax(log p / t), by five rounds of a finer grid over 0.05 to 20.

    ``true_index`` is the 1-based place of the true label in the array ``p``. Each round is one aggregation.
    """
    lo, hi = math.log(0.05), math.log(20.0)
    best = 0.0
    for _ in range(5):
        tried = [float(t) for t in np.linspace(lo, hi, grid)]
        each = df.select(F.col(p).alias("_p"), true_index.alias("_i"), F.posexplode(F.array(*map(F.lit, tried))).alias("_at", "_t"))
        powers = F.transform("_p", lambda x: F.pow(F.greatest(x, F.lit(EDGE)), F.exp(-F.col("_t"))))
        each = each.select("_at", "_i", powers.alias("_w"))
        share = F.element_at("_w", F.col("_i")) / F.aggregate("_w", F.lit(0.0), lambda s, x: s + x)
        losses = {r["_at"]: r["l"] for r in each.groupBy("_at").agg(F.avg(-F.log(F.greatest(share, F.lit(1e-15)))).alias("l")).collect()}
        i = min(range(grid), key=lambda i: losses.get(i, math.inf))
        best, width = tried[i], (hi - lo) / (grid - 1)
        lo, hi = best - width, best + width
    return math.exp(best)


def tempered(p: Column, t: float) -> Column:
    """softmax(log p / t)."""
    powers = F.transform(p, lambda x: F.pow(F.greatest(x, F.lit(EDGE)), F.lit(1 / t)))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def normalized_scores(df: DataFrame, unit: str, value: str = "q") -> DataFrame:
    """Scores of a row divided by their sum; equal shares where it is 0."""
    row = Window.partitionBy(unit)
    total = F.sum(value).over(row)
    return df.withColumn(value, F.when(total > 0, F.col(value) / F.nullif(total, F.lit(0.0))).otherwise(F.lit(1.0) / F.count("*").over(row)))


#: Methods of :func:`mapped`.
METHODS = ("sigmoid", "isotonic", "temperature")


def mapped(fit: DataFrame, apply: DataFrame, labels: list[str], method: str, unit: str | None = None) -> DataFrame:
    """``apply`` with ``q``: its scores mapped as ``method`` learns from ``fit``.

    Both are long. ``temperature`` takes the scores of a row together and needs ``unit``, the column that names it. A label
    without positives in ``fit`` keeps its scores under ``sigmoid`` and gets 0 under ``isotonic``.
    """
    if method == "sigmoid":
        return apply_platt(apply, ["label"], fit_platt(fit, ["label"]))
    if method == "isotonic":
        parts = [isotonic(fit, apply, label) for label in labels]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    if method != "temperature" or unit is None:
        raise ValueError(f"unknown method: {method}" if unit else "temperature needs the column of a row's id")
    whole = fit.groupBy(unit).agg(  # one row per label
        F.array_sort(F.collect_list(F.struct("label", "p")))["p"].alias("_v"),
        F.array_position(F.array_sort(F.collect_list(F.struct("label", "is_true")))["is_true"], 1).cast("int").alias("_i"),
    )
    t = fit_temperature(whole.where("_i > 0"), "_v", F.col("_i"))
    power = F.pow(F.greatest(F.col("p"), F.lit(EDGE)), F.lit(1 / t))
    return apply.withColumn("q", power / F.sum(power).over(Window.partitionBy(unit)))


def missing_labels(df: DataFrame, folds: list[int], labels: list[str]) -> dict[int, list[str]]:
    """For each fold, the labels that the other folds have no positive row of, so that its map is learned without them."""
    has = {(r["fold"], r["label"]) for r in df.where("is_true = 1 and fold is not null").select("fold", "label").distinct().collect()}
    return {k: sorted(x for x in labels if not any(f != k and y == x for f, y in has)) for k in folds}


def cross_fitted(df: DataFrame, folds: list[int], method: str = "sigmoid", labels: list[str] | None = None, unit: str | None = None) -> DataFrame:
    """``df`` with ``q``: each fold's scores mapped by what ``method`` learns from the other folds."""
    out = None
    for k in folds:
        part = mapped(df.where(F.col("fold") != k), df.where(F.col("fold") == k), labels or [], method, unit)
        out = part if out is None else out.unionByName(part)
    return out


def calibrated_folds(held: DataFrame, apply: DataFrame, folds: list[int], labels: list[str], unit: str, method: str = "sigmoid") -> DataFrame:
    """``unit``, ``label``, ``q``: scores of each fold's model mapped by what ``method`` learns from that fold, normalized by row, and averaged over folds.

    ``held``: rows of each fold as scored by the model without it; ``apply``: ``unit``, ``label``, ``p`` of other rows by the model of each ``fold``.
    """
    out = None
    for k in folds:
        each = mapped(held.where(F.col("fold") == k), apply.where(F.col("fold") == k), labels, method, unit)
        part = normalized_scores(each, unit).select(unit, "label", "q")
        out = part if out is None else out.unionByName(part)
    return fold_average(out, [unit, "label"], "q")


def fold_average(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean over folds of a row's calibrated scores."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))
