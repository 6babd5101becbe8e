"""Errors of prevalence estimates, and calibration of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagmeter.functions.arrays import bin_of
from bagmeter.functions.ranks import percentiles
from bagmeter.functions.zones import band_count, find_zone


def absolute_error(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``ae``: mean over labels of |p_true - p_pred|."""
    return df.groupBy(*keys).agg(F.avg(F.abs(F.col("p_true") - F.col("p_pred"))).alias("ae"))


def zone_report(df: DataFrame, keys: list[str], ranges: dict | None = None) -> DataFrame:
    """``keys``, ``label``, ``true_zone``, ``pred_zone``, ``bands``, ``crossed`` for labels with at least two bands."""
    label = F.col("label")
    return (
        df.select(
            *keys, "label",
            find_zone(label, F.col("p_true"), ranges).alias("true_zone"),
            find_zone(label, F.col("p_pred"), ranges).alias("pred_zone"),
            band_count(label, ranges).alias("bands"),
        )
        .where("bands >= 2")
        .withColumn("crossed", F.col("true_zone") != F.col("pred_zone"))
    )


def zone_crossing_error(df: DataFrame, keys: list[str], ranges: dict | None = None) -> DataFrame:
    """``keys``, ``zce``: mean over labels with bands of the share of bands crossed; 0 where no label has two."""
    step = F.abs(F.col("true_zone") - F.col("pred_zone")) / (F.col("bands") - 1)
    errors = zone_report(df, keys, ranges).groupBy(*keys).agg(F.avg(step).alias("zce"))
    return df.select(*keys).distinct().join(errors, keys, "left").withColumn("zce", F.coalesce("zce", F.lit(0.0)))


def check_scores(df: DataFrame, label: str, p: str, classes: list[str]) -> None:
    """Raise ValueError unless ``df`` has rows, each with a known label and with one score from 0 to 1 for each class; one aggregation."""
    wrong = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(True)).cast("long")), F.lit(0))
    outside = F.exists(F.col(p), lambda v: v.isNull() | F.isnan(v) | (v < -1e-9) | (v > 1 + 1e-9))
    row = df.agg(
        F.count("*").alias("rows"), wrong(F.size(p) != len(classes)).alias("width"), wrong(~F.col(label).isin(*classes)).alias("label"),
        wrong(outside).alias("range"),
    ).first()
    if not row["rows"]:
        raise ValueError("there are no rows")
    for name, text in (("width", f"don't have {len(classes)} scores"), ("label", f"have a label that isn't one of {classes}"), ("range", "have scores that don't lie in [0, 1]")):
        if row[name]:
            raise ValueError(f"{row[name]} rows {text}")


def brier(df: DataFrame, keys: list[str], label: str, p: str, classes: Column, half: bool = False) -> DataFrame:
    """``keys``, ``brier``: mean over rows of the squared distance to the one-hot label; from 0 to 2, or halved."""
    one_hot = F.transform(classes, lambda c: (c == F.col(label)).cast("double"))
    square = F.aggregate(F.zip_with(F.col(p), one_hot, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return df.groupBy(*keys).agg((F.avg(square) * (0.5 if half else 1.0)).alias("brier"))


def reliability(df: DataFrame, keys: list[str], confidence: Column, correct: Column, edges: Column) -> DataFrame:
    """``keys``, ``bin``, ``n``, ``confidence``, ``accuracy`` of the bins that hold rows."""
    return df.groupBy(*keys, bin_of(confidence, edges).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(confidence).alias("confidence"), F.avg(correct.cast("double")).alias("accuracy")
    )


def calibration_error(curve: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``ece``: mean gap of confidence and accuracy, weighted by the rows of the bins."""
    gap = F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))
    return curve.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def quantile_edges(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """``keys``, ``edges``: 0, the inner linear quantiles, 1, without repeats."""
    inner = F.collect_list("value")  # one value per bin
    edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), inner, F.array(F.lit(1.0)))))
    return percentiles(df, keys, F.col(value), [i / bins for i in range(1, bins)]).groupBy(*keys).agg(edges.alias("edges"))


def log_loss_accuracy(df: DataFrame, keys: list[str], p_true: Column, correct: Column) -> DataFrame:
    """``keys``, ``log_loss``, ``accuracy``; a probability counts as 1e-15 at least."""
    return df.groupBy(*keys).agg(
        F.avg(-F.log(F.greatest(p_true, F.lit(1e-15)))).alias("log_loss"), F.avg(correct.cast("double")).alias("accuracy")
    )


def f1_accuracy(df: DataFrame, keys: list[str], truth: Column, guess: Column) -> DataFrame:
    """``keys``, ``f1``, ``accuracy`` of a 0/1 guess; F1 is 0 where nothing is or is called positive."""
    count = lambda c: F.sum(c.cast("long"))
    tp, fp, fn = count((truth == 1) & (guess == 1)), count((truth == 0) & (guess == 1)), count((truth == 1) & (guess == 0))
    return df.groupBy(*keys).agg(
        F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"), F.avg((truth == guess).cast("double")).alias("accuracy")
    )
