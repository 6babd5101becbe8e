"""Prevalence estimators in closed form or on a grid: aggregations over bags joined with scores.

Inputs shared by all of them:

``bag_scores``: bag key columns, ``label``, ``p`` (the score of that label), ``is_pred`` (0/1), one
row per member of a bag and label.
``oof``: ``label``, ``p``, ``is_pred``, ``is_true`` of the training rows, scored out of fold.

Every estimator returns the keys, ``label`` and ``p_pred``, one row per bag and label,
before the estimates of a bag are normalized.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Thresholds of the threshold family: 0, 0.01, ... 1.
STEPS = 100
#: Least gap of the rates that median sweep uses.
SWEEP_GAP = 0.25
#: Mixtures tried by the distribution matchers.
ALPHAS = 100


def class_table(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast: it has one row per class, or one per class and threshold.

    The classes are those of the score arrays, so the bound is known before the job runs.
    """
    return F.broadcast(df)


def clip(c: Column) -> Column:
    """``c`` within [0, 1]; null stays null (greatest and least alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def adjusted(raw: Column, high: Column, low: Column) -> Column:
    """(raw - low) / (high - low) within [0, 1]; the raw value where both rates are equal or unknown."""
    return F.coalesce(clip(F.try_divide(raw - low, high - low)), raw)


def normalized(df: DataFrame, keys: list[str], value: str = "p_pred") -> DataFrame:
    """Estimates cut at 0 and divided by their sum; equal shares where the sum is 0."""
    group = Window.partitionBy(*keys)
    cut = F.greatest(F.lit(0.0), F.col(value))
    total = F.sum(cut).over(group)
    return df.withColumn(value, F.when(total > 0, cut / F.nullif(total, F.lit(0.0))).otherwise(F.lit(1.0) / F.count("*").over(group)))


def cc(bag_scores: DataFrame, keys: list[str]) -> DataFrame:
    """Classify and count."""
    return bag_scores.groupBy(*keys, "label").agg(F.avg("is_pred").alias("p_pred"))


def pcc(bag_scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean probability."""
    return bag_scores.groupBy(*keys, "label").agg(F.avg("p").alias("p_pred"))


def rates(oof: DataFrame) -> DataFrame:
    """``label``, ``tpr``, ``fpr``, ``mu_pos``, ``mu_neg`` and ``prior``, one row per class."""
    yes, no = F.col("is_true") == 1, F.col("is_true") == 0
    return oof.groupBy("label").agg(
        F.avg(F.when(yes, F.col("is_pred"))).alias("tpr"),
        F.avg(F.when(no, F.col("is_pred"))).alias("fpr"),
        F.avg(F.when(yes, F.col("p"))).alias("mu_pos"),
        F.avg(F.when(no, F.col("p"))).alias("mu_neg"),
        F.avg("is_true").alias("prior"),
    )


def acc(bag_scores: DataFrame, oof: DataFrame, keys: list[str]) -> DataFrame:
    """Adjusted count."""
    return cc(bag_scores, keys).join(class_table(rates(oof)), "label").select(
        *keys, "label", adjusted(F.col("p_pred"), F.col("tpr"), F.col("fpr")).alias("p_pred")
    )


def pacc(bag_scores: DataFrame, oof: DataFrame, keys: list[str]) -> DataFrame:
    """Adjusted mean probability."""
    return pcc(bag_scores, keys).join(class_table(rates(oof)), "label").select(
        *keys, "label", adjusted(F.col("p_pred"), F.col("mu_pos"), F.col("mu_neg")).alias("p_pred")
    )


def _step(p: Column) -> Column:
    """The last threshold that a score reaches, in steps; scores have 6 decimals at most."""
    return F.floor(F.round(p * STEPS, 6)).cast("int")


def roc(oof: DataFrame) -> DataFrame:
    """``label``, ``step``, ``tpr``, ``fpr``: rates of "score at least step / 100" for every threshold."""
    steps = oof.groupBy("label", _step(F.col("p")).alias("s")).agg(F.sum("is_true").alias("pos"), F.sum(1 - F.col("is_true")).alias("neg"))
    grid = steps.select("label").distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(STEPS))))
    at = grid.join(steps, (grid["label"] == steps["label"]) & (F.col("s") == F.col("step")), "left").select(
        grid["label"], "step", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg")
    )
    label = Window.partitionBy("label")
    reach = label.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return at.select(
        "label", "step",
        F.try_divide(F.sum("pos").over(reach), F.sum("pos").over(label)).alias("tpr"),
        F.try_divide(F.sum("neg").over(reach), F.sum("neg").over(label)).alias("fpr"),
    )


def bag_reach(bag_scores: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``label``, ``size``, ``counts``: members of a bag per threshold step, as one array of 101 counts."""
    steps = bag_scores.groupBy(*keys, "label", _step(F.col("p")).alias("s")).agg(F.count("*").alias("n"))
    by_step = steps.groupBy(*keys, "label").agg(F.map_from_entries(F.collect_list(F.struct("s", "n"))).alias("m"), F.sum("n").alias("size"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    return by_step.select(*keys, "label", "size", counts.alias("counts"))


def _share_reaching(step: Column) -> Column:
    above = F.slice("counts", step + 1, F.lit(STEPS + 1))
    return F.aggregate(above, F.lit(0).cast("long"), lambda s, x: s + x) / F.col("size")


def chosen_thresholds(curve: DataFrame, rule: str) -> DataFrame:
    """``label``, ``step``, ``tpr``, ``fpr`` of the threshold that a rule picks; the least step of equals.

    ``x``: where the false positive rate meets the false negative rate; ``max``: where the gap of both rates is greatest;
    ``t50``: where half of the positives are found.
    """
    cost = {
        "x": F.abs(F.col("fpr") - (1 - F.col("tpr"))),
        "max": F.col("fpr") - F.col("tpr"),
        "t50": F.abs(F.col("tpr") - 0.5),
    }[rule]
    best = F.min_by(F.struct("step", "tpr", "fpr"), F.struct(F.round(cost, 9), F.col("step")))
    return curve.groupBy("label").agg(best.alias("b")).select("label", "b.step", "b.tpr", "b.fpr")


def threshold(bag_scores: DataFrame, oof: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """X, Max and T50: the adjusted count at a threshold that suits the classes."""
    chosen = class_table(chosen_thresholds(roc(oof), rule))
    return bag_reach(bag_scores, keys).join(chosen, "label").select(
        *keys, "label", adjusted(_share_reaching(F.col("step")), F.col("tpr"), F.col("fpr")).alias("p_pred")
    )


def _solved(df: DataFrame, keys: list[str], columns: list[str], solve: Callable[[str, list[np.ndarray]], np.ndarray]) -> DataFrame:
    """``keys``, ``label``, ``p_pred``: ``solve`` of the arrays in ``columns``, for all rows of an Arrow batch with one label at once."""
    fields = [*(df.schema[k] for k in keys), T.StructField("label", T.StringType()), T.StructField("p_pred", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            arrays = [batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) for c in columns]
            named = np.array(batch.column("label").to_pylist(), dtype=object)
            out = np.zeros(batch.num_rows)
            for label in set(named):
                mine = np.flatnonzero(named == label)
                out[mine] = solve(label, [x[mine] for x in arrays])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("label"), pa.array(out)], [*keys, "label", "p_pred"])

    return df.select(*keys, "label", *columns).mapInArrow(run, T.StructType(fields))


def median_sweep(bag_scores: DataFrame, oof: DataFrame, keys: list[str], gap: float = SWEEP_GAP) -> DataFrame:
    """Median of the adjusted counts over all thresholds whose rates differ by more than ``gap``; 0 where none do."""
    curves: dict[str, list] = {}
    for r in roc(oof).where(F.col("tpr") - F.col("fpr") > gap).collect():  # one row per class and threshold at most
        curves.setdefault(r["label"], []).append((r["step"], r["tpr"], r["fpr"]))

    def solve(label: str, arrays: list[np.ndarray]) -> np.ndarray:
        reaching = arrays[0][:, ::-1].cumsum(axis=1)[:, ::-1] / arrays[1]
        if label not in curves:
            return np.zeros(len(reaching))
        step, tpr, fpr = (np.array(c) for c in zip(*curves[label]))
        return np.median(np.clip((reaching[:, step.astype(int)] - fpr) / (tpr - fpr), 0.0, 1.0), axis=1)

    held = bag_reach(bag_scores, keys).withColumn("sizes", F.array("size"))
    return _solved(held, keys, ["counts", "sizes"], solve)


def _histogram(df: DataFrame, keys: list[str], bins: int, weight: Column, name: str) -> DataFrame:
    """``keys``, ``name``: shares of ``weight`` per equal bin of the score, as an array."""
    b = F.least(F.lit(bins - 1), F.floor(F.round(F.col("p") * bins, 6))).cast("int")
    per = df.groupBy(*keys, b.alias("b")).agg(F.sum(weight).alias("w"))
    whole = per.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("m"), F.sum("w").alias("t"))
    share = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_divide(F.coalesce(F.try_element_at("m", i), F.lit(0)), F.col("t")), F.lit(0.0)))
    return whole.select(*keys, share.alias(name))


def _hellinger(test: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """Squared Hellinger distances without their constant; they have the same minimum."""
    return -np.sqrt(test) @ np.sqrt(mixed).T


def _topsoe(test: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    t, m = test[:, None, :], mixed[None, :, :]
    part = lambda x: np.where(x > 0, x * np.log(2 * np.where(x > 0, x, 1.0) / np.where(x > 0, t + m, 2.0)), 0.0)
    return (part(t + 0 * m) + part(m + 0 * t)).sum(axis=2)


def _l1_cdf(test: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    return np.abs(test.cumsum(axis=1)[:, None, :] - mixed.cumsum(axis=1)[None, :, :]).sum(axis=2)


DISTANCES = {"hellinger": _hellinger, "topsoe": _topsoe, "cdf": _l1_cdf}
#: Bags whose distances to all mixtures are computed at once.
TILE = 1024


def matched(bag_scores: DataFrame, oof: DataFrame, keys: list[str], distance: str, bins: int | tuple[int, ...]) -> DataFrame:
    """The mixture of the positive and negative score distributions nearest to the bag's, on a grid of 101 shares.

    ``distance``: hellinger (HDy), topsoe (DyS) or cdf (the mixture of cumulative distributions). The least share of equals. With several
    numbers of ``bins``, each of which divides the greatest, the median over them: one histogram is taken and its bins are merged.
    """
    each = (bins,) if isinstance(bins, int) else bins
    finest = max(each)
    pos = _histogram(oof, ["label"], finest, F.col("is_true"), "pos")
    neg = _histogram(oof, ["label"], finest, 1 - F.col("is_true"), "neg")
    shares = np.arange(ALPHAS + 1)[:, None] / ALPHAS
    merged = lambda x, b: x.reshape(len(x), b, finest // b).sum(axis=2)
    classes = {r["label"]: (np.array([r["pos"]]), np.array([r["neg"]])) for r in pos.join(neg, "label").collect()}
    mixtures = {c: [shares * merged(p, b) + (1 - shares) * merged(n, b) for b in each] for c, (p, n) in classes.items()}

    def solve(label: str, arrays: list[np.ndarray]) -> np.ndarray:
        test = arrays[0]
        best = np.zeros((len(each), len(test)))
        for i, b in enumerate(each):
            for at in range(0, len(test), TILE):
                far = DISTANCES[distance](merged(test[at : at + TILE], b), mixtures[label][i])
                best[i, at : at + TILE] = np.round(far, 9).argmin(axis=1) / ALPHAS
        return np.median(best, axis=0)

    held = _histogram(bag_scores, [*keys, "label"], finest, F.lit(1), "test").where(F.col("label").isin(*classes))
    return _solved(held, keys, ["test"], solve)


def hdy(bag_scores: DataFrame, oof: DataFrame, keys: list[str], bins: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Median over an odd number of bin counts of the Hellinger match."""
    return matched(bag_scores, oof, keys, "hellinger", bins)
