"""Entry points: python -m bagmeter.pipeline {splits,experiment,protocols,calibration,bundle,balance} DATA OUT."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagmeter.config import LABELS
from bagmeter.operators import bags, estimators, iterative, labels, metrics, scoring, split, stats
from bagmeter.plans import learned, protocols, quantify
from bagmeter.sources.bundle import export_bundle
from bagmeter.sources.checkpoint import ExperimentCheckpoint
from bagmeter.sources.scratch import stage

KEYS = ["bag_size", "bag_index"]
PROTOCOLS = ("APP", "C-APP")


def prepare_splits(spark: SparkSession, data: str, out: str, test_size: float = 0.3, seed: int = 0) -> DataFrame:
    """Beats with a split by record that has every label on both sides, written by split with its metadata."""
    rows = protocols.beats(spark, data).where(F.col("y").isin(*LABELS) & F.col("record").isNotNull()).drop("split")
    sides, used = split.guaranteed_split(rows, "record", "y", test_size, seed)
    result = rows.join(sides, "record").withColumnRenamed("side", "split")
    if not split.leaking_groups(result, "record", "split").isEmpty():
        raise RuntimeError("a record is on both sides")
    result.write.mode("overwrite").partitionBy("split").parquet(f"{out}/splits")
    spark.createDataFrame([(json.dumps({"test_size": test_size, "seed": used, "labels": LABELS}),)], "meta string").write.mode("overwrite").json(f"{out}/splits_meta")
    return spark.read.parquet(f"{out}/splits")


def registry() -> dict[str, Callable[[DataFrame, DataFrame, DataFrame, DataFrame], DataFrame]]:
    """Estimators by name: functions of (training scores, bag rows, long bags, long training scores)."""
    normal = lambda df: estimators.normalized(df, KEYS)
    return {
        "CC": lambda t, b, lb, lo: estimators.cc(lb, KEYS),
        "PCC": lambda t, b, lb, lo: estimators.pcc(lb, KEYS),
        "ACC": lambda t, b, lb, lo: normal(estimators.acc(lb, lo, KEYS)),
        "PACC": lambda t, b, lb, lo: normal(estimators.pacc(lb, lo, KEYS)),
        "X": lambda t, b, lb, lo: normal(estimators.threshold(lb, lo, KEYS, "x")),
        "Max": lambda t, b, lb, lo: normal(estimators.threshold(lb, lo, KEYS, "max")),
        "T50": lambda t, b, lb, lo: normal(estimators.threshold(lb, lo, KEYS, "t50")),
        "MedianSweep": lambda t, b, lb, lo: normal(estimators.median_sweep(lb, lo, KEYS)),
        "HDy": lambda t, b, lb, lo: normal(estimators.hdy(lb, lo, KEYS)),
        "DyS": lambda t, b, lb, lo: normal(estimators.matched(lb, lo, KEYS, "topsoe", 10)),
        "FormanMM": lambda t, b, lb, lo: normal(estimators.matched(lb, lo, KEYS, "cdf", 20)),
        "GAC": lambda t, b, lb, lo: iterative.mixture(t, b, KEYS, "hard"),
        "GPAC": lambda t, b, lb, lo: iterative.mixture(t, b, KEYS, "soft"),
        "FM": lambda t, b, lb, lo: iterative.mixture(t, b, KEYS, "prior"),
        "EMQ": lambda t, b, lb, lo: iterative.emq(t, b, KEYS),
        "CDE": lambda t, b, lb, lo: normal(iterative.cde(lb.select(*KEYS, "label", "p"), estimators.rates(lo).select("label", "prior", "tpr", "fpr"), KEYS)),
        "HDx": lambda t, b, lb, lo: iterative.hdx(t, b, KEYS, "features", scoring.WIDTH),
        "ReadMe": lambda t, b, lb, lo: iterative.readme(t, b, KEYS, "features", scoring.WIDTH),
        "ED": lambda t, b, lb, lo: iterative.energy_distance(t, b, KEYS, "features"),
    }


#: Classifiers of whole score vectors by name: functions of (session, data).
SCORERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"centroid": quantify.scores, "multinomial": learned.oof_scores_multinomial}


def _trained(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def scores(spark: SparkSession, data: str) -> DataFrame:
        rows, sizes = quantify.instances(spark, data), scoring.STUDY_SIZES.get(kind, {})
        return scoring.trained_scores(rows, kind, len(learned.FOLDS), ["instance_id", "split", "y"], **sizes)

    return scores


SCORERS |= {kind: _trained(kind) for kind in scoring.CLASSIFIERS}


def methods(classifiers: list[str] | None = None, names: list[str] | None = None) -> list[str]:
    """Every classifier with every estimator, as ``classifier-estimator``; estimators that read features come once, alone."""
    names, plain = names or list(registry()), ("HDx", "ReadMe", "ED")
    return [n for n in names if n in plain] + [f"{c}-{n}" for c in classifiers or list(SCORERS) for n in names if n not in plain]


def _scored(spark: SparkSession, data: str, classifier: str) -> DataFrame:
    """Scores of a classifier with the features, which some estimators read instead; written once."""
    features = quantify.instances(spark, data).select("instance_id", "features")
    return stage(SCORERS[classifier](spark, data).join(features, "instance_id"), "scored")


def _long(rows: DataFrame, keep: list[str]) -> DataFrame:
    flag = lambda c: (F.col(c) == F.col("label")).cast("int")
    return scoring.long_scores(rows, [*keep, "y", "pred"]).select(*keep, "label", "p", flag("pred").alias("is_pred"), flag("y").alias("is_true"))


def _drawn(spark: SparkSession, data: str, protocol: str, scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Truth and members with scores of a protocol's bags; both are written once."""
    asked = protocols._bags(spark, data, protocol)
    truth = bags.app_truth(asked) if protocol == "APP" else bags.capp_truth(asked)
    test = scored.where("split = 'test'").select("instance_id", "y", "p", "pred", *({"features"} & set(scored.columns)))
    label = labels.binary_label(F.col("y")) if protocol == "APP" else F.col("y")
    drawn = bags.members(truth, test.select(label.alias("label"), "instance_id"), "instance_id")
    return truth, stage(drawn.select(*KEYS, "pos", "instance_id").join(test, "instance_id"), "bag-rows")


def run_experiment(spark: SparkSession, data: str, out: str, names: list[str] | None = None, fresh: bool = False, classifier: str = "centroid") -> DataFrame:
    """Evaluate estimators on bags within risk bands and write the summary; finished units are skipped on a second run."""
    known = registry()
    names = names or list(known)
    check = ExperimentCheckpoint(spark, f"{out}/checkpoint", fresh)
    check.record_config({"data": data, "protocol": "C-APP", "estimators": sorted(known), "classifier": classifier})
    todo = [n for n in names if not check.is_done(n)]
    if todo:
        scored = _scored(spark, data, classifier)
        train = scored.where("split = 'train'")
        truth, rows = _drawn(spark, data, "C-APP", scored)
        long_bags, oof = _long(rows, KEYS), _long(train, [])
        true = truth.select(*KEYS, "label", F.col("prevalence").alias("p_true"))
        for name in todo:
            guess = known[name](train, rows, long_bags, oof)
            both = stage(true.join(guess, [*KEYS, "label"]), "evaluated")
            errors = metrics.absolute_error(both, KEYS).withColumnRenamed("ae", "mae").join(metrics.zone_crossing_error(both, KEYS), KEYS)
            check.save(errors.withColumn("quantifier", F.lit(name)), name)
    check.results().where(F.col("quantifier").isin(*names)).write.mode("overwrite").parquet(f"{out}/results")  # one row per bag and estimator
    summary = stats.summary(check.results(), ["quantifier", "bag_size"], ["mae", "zce"])
    summary.write.mode("overwrite").csv(f"{out}/summary_table", header=True)
    return summary


def run_grid(spark: SparkSession, data: str, out: str, classifiers: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """:func:`run_experiment` for every method of :func:`methods`, each classifier in its own folder; the summaries as one table."""
    known, result = methods(classifiers, names), None
    for classifier in classifiers or list(SCORERS):
        own = [n.removeprefix(f"{classifier}-") for n in known if n.startswith(f"{classifier}-")]
        plain = [n for n in known if "-" not in n] if result is None else []
        part = run_experiment(spark, data, f"{out}/{classifier}", own + plain, classifier=classifier).where(F.col("quantifier").isin(*own, *plain))
        named = F.when(F.col("quantifier").isin(*plain), F.col("quantifier")).otherwise(F.concat(F.lit(f"{classifier}-"), "quantifier"))
        part = part.withColumn("quantifier", named)
        result = part if result is None else result.unionByName(part)
    result.write.mode("overwrite").csv(f"{out}/summary_table", header=True)
    return result


def compare_protocols(spark: SparkSession, data: str, out: str, names: list[str] | None = None, fresh: bool = False, classifier: str = "centroid") -> DataFrame:
    """Ranks of the estimators on bags of both protocols, drawn from the same scores, and their shifts.

    The error is that of the positive label's share: bags with uniform shares are drawn by it, and within risk bands the
    other labels are collapsed. Units (estimator::protocol) that are finished are skipped on a second run.
    """
    known = registry()
    names = names or list(known)
    check = ExperimentCheckpoint(spark, f"{out}/protocols_checkpoint", fresh)
    check.record_config({"data": data, "estimators": sorted(known), "classifier": classifier})
    todo = [(n, p) for p in PROTOCOLS for n in names if not check.is_done(n, p)]
    if todo:
        scored = _scored(spark, data, classifier)
        train = scored.where("split = 'train'")
        oof = _long(train, [])
    for protocol in PROTOCOLS:
        mine = [n for n, p in todo if p == protocol]
        if not mine:
            continue
        truth, rows = _drawn(spark, data, protocol, scored)
        binary = F.col("label") if protocol == "APP" else labels.binary_label(F.col("label"))
        true = truth.groupBy(*KEYS).agg(F.sum(F.when(binary == 1, F.col("prevalence")).otherwise(0.0)).alias("p_true"))
        long_bags = _long(rows, KEYS)
        for name in mine:
            guess = known[name](train, rows, long_bags, oof).where(labels.binary_label(F.col("label")) == 1)
            errors = true.join(guess, KEYS).select(*KEYS, F.abs(F.col("p_true") - F.col("p_pred")).alias("mae"))
            check.save(errors.withColumns({"quantifier": F.lit(name), "protocol": F.lit(protocol)}), name, protocol)
    means = check.results().groupBy("quantifier", "protocol", "bag_size").agg(F.round(F.avg("mae"), 9).alias("mae"))
    shifts = stats.rank_shift(means, ["bag_size"], "quantifier", "protocol", "mae", *PROTOCOLS).select(
        "bag_size", "quantifier", F.col("first_rank").alias("app_rank"), F.col("second_rank").alias("capp_rank"), F.col("shift").alias("rank_shift")
    )
    shifts.write.mode("overwrite").csv(f"{out}/ranking_comparison", header=True)
    return shifts


def calibration_study(spark: SparkSession, data: str, out: str) -> DataFrame:
    """Classwise calibration errors of each method, as one long table."""
    parts = [f(spark, data).select("label", "ece", F.lit(f.__name__).alias("method")) for f in (learned.platt, learned.isotonic, learned.temperature, learned.cross_fit)]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    result.write.mode("overwrite").parquet(f"{out}/calibration")
    return spark.read.parquet(f"{out}/calibration")


def make_bundle(spark: SparkSession, data: str, out: str) -> None:
    """Export scores, bags, their truth and results of an experiment; bags are checked against their truth first."""
    scored = quantify.scores(spark, data)
    truth, rows = _drawn(spark, data, "C-APP", scored)
    results = ExperimentCheckpoint(spark, f"{out}/checkpoint").results()
    tables = {
        "instances": scored.select("instance_id", "record_id", "split", "fold", "y"),
        "scores": scored.select("instance_id", F.col("p").cast("array<float>").alias("p"), "pred"),
        "bag_truth": stage(truth, "truth"),
        "bag_members": rows.select(*KEYS, "pos", "instance_id"),
    }
    export_bundle(f"{out}/bundle", "capp", tables | ({"results": results} if results is not None else {}), {"data": data})


def balance(spark: SparkSession, data: str, out: str) -> DataFrame:
    """Rows per label and split, few and missing ones marked."""
    report = labels.balance_report(protocols.beats(spark, data).where("split is not null"), "split", "y")
    report.write.mode("overwrite").csv(f"{out}/balance", header=True)
    return report


STEPS = {
    "splits": prepare_splits, "experiment": run_experiment, "protocols": compare_protocols, "calibration": calibration_study,
    "bundle": make_bundle, "balance": balance,
}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("step", choices=STEPS)
    parser.add_argument("data", help="folder of the input tables")
    parser.add_argument("out", help="folder for results, shared by driver and executors")
    given = parser.parse_args(args)
    STEPS[given.step](SparkSession.builder.appName(f"bagmeter-{given.step}").getOrCreate(), given.data, given.out)


if __name__ == "__main__":
    main()
