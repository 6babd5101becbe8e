"""Class scores of instances: one wide job that every estimator reads.

A scorer is anything that turns instances into ``p``, an array of probabilities in the
order of the labels. Here are a centroid scorer, whose fit is one aggregation, and adapters
of MLlib classifiers; both score the training rows out of fold.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagmeter.config import LABELS
from bagmeter.operators.calibration import apply_platt, fit_platt
from bagmeter.sources.scratch import stage

#: Values of a whole feature list.
WIDTH = 20
#: Fold of the model that is fitted on all training rows.
ALL = -1
#: Most models (fold and label) in the table of centroids, which is sent to all tasks.
MOST_MODELS = 10_000


def is_whole(features: Column, width: int = WIDTH) -> Column:
    """Whether a list has ``width`` values, none null or NaN."""
    return F.coalesce((F.size(features) == width) & F.forall(features, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))


def centroids(train: DataFrame, labels: tuple[str, ...] = LABELS, width: int = WIDTH) -> DataFrame:
    """``fold``, ``model``: mean vectors of the labels, from all training rows (fold -1) and without each fold.

    ``train``: ``fold``, ``y``, ``features``. One aggregation gives sums per fold and label; a fold's model
    is the sum over the other folds. A label without rows has no centroid in that model.
    """
    sums = [F.sum(F.element_at("features", i + 1)).alias(f"s{i}") for i in range(width)]
    # one row per fold and label, written once: read for the list of folds and for the sums
    per_fold = stage(train.where(F.col("y").isin(*labels)).groupBy("fold", "y").agg(F.count("*").alias("n"), *sums), "sums")
    columns = ["n", *(f"s{i}" for i in range(width))]
    folds = [r["fold"] for r in per_fold.select("fold").where("fold is not null").distinct().limit(MOST_MODELS).collect()]
    models = F.explode(F.array(F.lit(ALL), *(F.lit(f) for f in sorted(folds))))
    every = (
        per_fold.withColumn("m", models)
        .where(F.col("fold").isNull() | (F.col("m") != F.col("fold")))
        .groupBy("m", "y")
        .agg(*(F.sum(c).alias(c) for c in columns))
    )
    mean = F.array(*(F.col(f"s{i}") / F.col("n") for i in range(width)))
    return (
        every.where("n > 0")
        .groupBy(F.col("m").alias("fold"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("y").alias("label"), mean.alias("c")))).alias("model"))
    )


def centroid_scores(rows: DataFrame, models: DataFrame, labels: tuple[str, ...] = LABELS, digits: int | None = 6) -> DataFrame:
    """``rows`` with ``p`` and ``pred``: a softmax of half the negative squared distances to the centroids.

    A training row is scored by the model without its fold, any other row by the whole
    model; a training row without a model of its fold is left out. The models are few, so they
    go to the tasks with the function; nothing is shuffled. ``pred`` is the first label with the
    greatest score, a label without a centroid has score 0. Stored scores have ``digits`` decimals.
    """
    known = models.limit(MOST_MODELS + 1).collect()
    if len(known) * len(labels) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} centroids")
    by_fold = {r["fold"]: {m["label"]: np.array(m["c"]) for m in r["model"]} for r in known}
    schema = T.StructType([*rows.schema.fields, T.StructField("p", T.ArrayType(T.DoubleType())), T.StructField("pred", T.StringType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = np.array(batch.column("split").to_pylist(), dtype=object)
            fold = batch.column("fold").fill_null(ALL - 1).to_numpy(zero_copy_only=False)
            wanted = np.where(split == "train", fold, ALL)
            kept = np.flatnonzero(np.isin(wanted, list(by_fold)))
            if not len(kept):
                continue
            batch, wanted = batch.take(pa.array(kept)), wanted[kept]
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(len(kept), -1)
            w = np.zeros((len(kept), len(labels)))
            for f, model in by_fold.items():
                mine = np.flatnonzero(wanted == f)
                for i, label in enumerate(labels):
                    if label in model:
                        w[mine, i] = np.exp(-0.5 * ((x[mine] - model[label]) ** 2).sum(axis=1))
            p = w / w.sum(axis=1, keepdims=True)
            p = p if digits is None else np.round(p, digits)
            names = pa.array([labels[i] for i in p.argmax(axis=1)], pa.string())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * len(labels)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, names], [*batch.schema.names, "p", "pred"])

    return rows.mapInArrow(score, schema)


def argmax(p: str, labels: tuple[str, ...] = LABELS) -> Column:
    """The first label whose score is the greatest."""
    names = F.array(*(F.lit(label) for label in labels))
    return F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))


def long_scores(scored: DataFrame, keep: list[str], labels: tuple[str, ...] = LABELS) -> DataFrame:
    """One row per instance and label: ``keep``, ``label``, ``p``."""
    names = F.array(*(F.lit(label) for label in labels))
    return scored.select(*keep, F.explode(F.arrays_zip(names.alias("label"), F.col("p").alias("p"))).alias("_z")).select(*keep, "_z.label", "_z.p")


def align_scores(p: Column, present: list[str], labels: tuple[str, ...] = LABELS) -> Column:
    """Scores in the order of ``labels``; a label that the model doesn't know gets 0."""
    return F.array(*(F.element_at(p, present.index(x) + 1) if x in present else F.lit(0.0) for x in labels))


#: Classifiers by name; each call gives an unfitted MLlib estimator for one label against the rest.
CLASSIFIERS: dict[str, Callable[[], object]] = {
    "LR": lambda: LogisticRegression(maxIter=50, regParam=1e-3, standardization=False),
    "RF": lambda: RandomForestClassifier(numTrees=30, maxDepth=6, seed=7),
    "GB": lambda: GBTClassifier(maxIter=10, maxDepth=3, stepSize=0.1, seed=7),
    "SVM": lambda: LinearSVC(maxIter=30, regParam=1e-3),
    "NB": lambda: NaiveBayes(modelType="gaussian"),
    "Ridge": lambda: LinearRegression(regParam=1e-2, elasticNetParam=0.0),
}


#: Classifiers without probabilities.
MARGINS = ("SVM", "Ridge")


def _fit(kind: str, train: DataFrame, sizes: dict):
    model = CLASSIFIERS[kind]().setFeaturesCol("_x").setLabelCol("_y")
    return model.setParams(**sizes).fit(train) if sizes else model.fit(train)


def _positive(df: DataFrame) -> Column:
    """The score of the positive class: its probability, or its margin or prediction for a model without one."""
    if "probability" not in df.columns and "rawPrediction" not in df.columns:
        return F.col("prediction")
    return F.element_at(vector_to_array("probability" if "probability" in df.columns else "rawPrediction"), 2)


def one_vs_rest_scores(rows: DataFrame, kind: str, label: str, n_folds: int, keep: list[str], **sizes) -> DataFrame:
    """``keep``, ``score``: one label against the rest; training rows out of fold, other rows by the whole model.

    ``rows``: ``split``, ``fold`` (from 0), ``y``, whole ``features``. The fits share one cached input. ``sizes`` are parameters of the model.
    """
    data = rows.withColumn("_x", array_to_vector("features")).withColumn("_y", (F.col("y") == label).cast("double"))
    train = data.where("split = 'train' and fold is not null and y is not null").persist()
    train.count()
    try:
        rest = data.where("split <> 'train'")
        scored = _fit(kind, train, sizes).transform(rest)
        out = scored.select(*keep, _positive(scored).alias("score"))
        for k in range(n_folds):
            held = _fit(kind, train.where(F.col("fold") != k), sizes).transform(data.where((F.col("split") == "train") & (F.col("fold") == k)))
            out = out.unionByName(held.select(*keep, _positive(held).alias("score")))
    finally:
        train.unpersist()
    return out


#: Sizes of the models that a study fits; the queries take smaller ones.
STUDY_SIZES = {"RF": {"numTrees": 100}, "GB": {"maxIter": 100}}


def trained_scores(rows: DataFrame, kind: str, n_folds: int, keep: list[str], labels: tuple[str, ...] = LABELS, **sizes) -> DataFrame:
    """``keep``, ``p``, ``pred``: a trained classifier of each label against the rest, its scores divided by their sum.

    Margins and predictions of models without probabilities become probabilities by Platt's map, fitted on the out-of-fold scores.
    ``keep`` has ``instance_id``, ``split`` and ``y``; ``sizes`` are parameters of the model.
    """
    parts = None
    for label in labels:
        scored = one_vs_rest_scores(rows, kind, label, n_folds, keep, **sizes).select(*keep, F.lit(label).alias("label"), F.col("score").alias("p"))
        parts = scored if parts is None else parts.unionByName(scored)
    parts = stage(parts, "trained-scores")
    if kind in MARGINS:
        oof = parts.where("split = 'train'").withColumn("is_true", (F.col("y") == F.col("label")).cast("int"))
        parts = apply_platt(parts, ["label"], fit_platt(oof, ["label"])).drop("p").withColumnRenamed("q", "p")
    of = F.map_from_entries(F.collect_list(F.struct("label", "p")))  # one entry per label
    p = F.transform(F.array(*map(F.lit, labels)), lambda x: F.greatest(F.try_element_at("_m", x), F.lit(0.0)))
    total = F.aggregate("_p", F.lit(0.0), lambda s, x: s + x)
    shares = F.when(total > 0, F.transform("_p", lambda x: x / total)).otherwise(F.array(*(F.lit(1 / len(labels)) for _ in labels)))
    vectors = parts.groupBy(*keep).agg(of.alias("_m")).withColumn("_p", p)
    return vectors.select(*keep, shares.alias("p")).withColumn("pred", argmax("p", labels))


def parameter_grid(**values: list) -> list[dict]:
    """All combinations of parameter values."""
    return [dict(zip(values, some)) for some in itertools.product(*values.values())]


def grid_scores(rows: DataFrame, kind: str, label: str, n_folds: int, grid: list[dict]) -> list[tuple[dict, float]]:
    """Each combination with its out-of-fold log loss on the training rows, the best first; margins count as log odds."""
    out = []
    for some in grid:
        scored = one_vs_rest_scores(rows, kind, label, n_folds, ["split", "y"], **some).where("split = 'train'")
        p = 1 / (1 + F.exp(-F.col("score"))) if kind in MARGINS else F.col("score")
        hit = F.when(F.col("y") == label, p).otherwise(1 - p)
        loss = scored.agg(F.avg(-F.log(F.greatest(hit, F.lit(1e-15)))).alias("l")).first()["l"]
        out.append((some, float("inf") if loss is None else loss))
    return sorted(out, key=lambda x: x[1])


def multinomial_scores(rows: DataFrame, labels: tuple[str, ...], n_folds: int, keep: list[str]) -> DataFrame:
    """``keep``, ``p``: multinomial logistic regression; training rows out of fold, other rows by the whole model."""
    index = F.array_position(F.array(*(F.lit(x) for x in labels)), F.col("y")) - 1
    data = rows.withColumn("_x", array_to_vector("features")).withColumn("_y", index.cast("double"))
    train = data.where((F.col("split") == "train") & F.col("fold").isNotNull() & F.col("y").isin(*labels)).persist()
    train.count()
    maker = LogisticRegression(maxIter=50, regParam=1e-3, standardization=False, family="multinomial", featuresCol="_x", labelCol="_y")
    try:
        out = maker.fit(train).transform(data.where("split <> 'train'"))
        out = out.select(*keep, vector_to_array("probability").alias("p"))
        for k in range(n_folds):
            held = maker.fit(train.where(F.col("fold") != k)).transform(data.where((F.col("split") == "train") & (F.col("fold") == k)))
            out = out.unionByName(held.select(*keep, vector_to_array("probability").alias("p")))
    finally:
        train.unpersist()
    return out


def knn_scores(rows: DataFrame, keep: list[str], k: int = 5, sample: int = 5000, labels: tuple[str, ...] = LABELS, seed: int = 7) -> DataFrame:
    """``keep``, ``p``: shares of the labels among the ``k`` nearest training rows, those of the row's own fold left out.

    The model is at most ``sample`` training rows, those with the least hash of ``instance_id`` (a documented bound of
    the fit); every row is scored, in Arrow batches against this table.
    """
    train = rows.where((F.col("split") == "train") & F.col("y").isin(*labels))
    kept = train.select("features", "y", "fold", F.xxhash64(F.lit(seed), "instance_id").alias("_o")).orderBy("_o").limit(sample).collect()
    points = np.array([r["features"] for r in kept], dtype=float).reshape(len(kept), -1)
    own = np.array([r["fold"] if r["fold"] is not None else ALL for r in kept])
    one_hot = np.array([[float(r["y"] == x) for x in labels] for r in kept]).reshape(len(kept), len(labels))
    if len(kept) <= k:
        raise ValueError("more training rows than neighbours are needed")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                held = np.array(batch.column("split").to_pylist(), dtype=object) == "train"
                fold = batch.column("fold").fill_null(ALL - 1).to_numpy(zero_copy_only=False)
                far = (x * x).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * x @ points.T
                far[held[:, None] & (fold[:, None] == own[None, :])] = np.inf
                near = np.argpartition(far, k, axis=1)[:, :k]
                p = one_hot[near].mean(axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * len(labels)), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], [*keep, "p"])

    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("p", T.ArrayType(T.DoubleType()))])
    columns = list(dict.fromkeys([*keep, "split", "fold", "features"]))
    return rows.select(*columns).mapInArrow(score, schema)
