"""Splits by group, so that no group is on both sides."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagmeter.functions.ranks import ranked
from bagmeter.functions.rng import uniform
from bagmeter.sources.scratch import drop, stage


def fold_count(test_size: float) -> int:
    """Number of folds for a test share: 1 / share to the nearest (halves to even), 2 at least; so 0.4 gives 2."""
    return max(int(round(1 / test_size)), 2)


#: Equal ranges of the random numbers in which the cut is looked for.
CUT_BINS = 65_536


def hash_split(groups: DataFrame, group: str, test_size: float, seed: int = 42) -> DataFrame:
    """``group``, ``side``: groups in a seeded random order, the first ceil(share x groups) of which are test.

    The cut is found by a histogram of the random numbers and a sort of the one bin it falls into.
    """
    u = uniform(seed, "group", F.col(group))
    distinct = groups.select(group).where(F.col(group).isNotNull()).distinct().withColumn("_u", u)
    bins = distinct.groupBy(F.floor(F.col("_u") * CUT_BINS).alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()
    left = math.ceil(test_size * sum(r["n"] for r in bins))
    last = F.lit(False)
    for r in bins:
        if left <= r["n"]:
            if left:
                here = distinct.where(F.floor(F.col("_u") * CUT_BINS) == r["b"])
                edge = here.orderBy("_u", group).limit(left).agg(F.max(F.struct("_u", group)).alias("m")).first()["m"]
                last = (F.col("_u") < edge["_u"]) | ((F.col("_u") == edge["_u"]) & (F.col(group) <= edge[group]))
            break
        left -= r["n"]
    return distinct.select(group, F.when(last, "test").otherwise("train").alias("side"))


def class_counts(df: DataFrame, group: str, label: str) -> tuple[DataFrame, list, list[float]]:
    """A written table of ``group`` and ``v``, its rows by label; the labels, and the rows of each."""
    known = df.where(F.col(group).isNotNull() & F.col(label).isNotNull())
    labels = sorted(r[label] for r in known.select(label).distinct().collect())
    v = F.array(*(F.sum((F.col(label) == F.lit(x)).cast("double")) for x in labels)) if labels else F.array().cast("array<double>")
    counts = stage(known.groupBy(group).agg(v.alias("v")), "class-counts")
    row = counts.agg(*(F.sum(F.element_at("v", i + 1)).alias(f"n{i}") for i in range(len(labels)))).first() if labels else []
    return counts, labels, [x or 0.0 for x in row]


#: Groups that are dealt one after the other.
HEAD = 100_000


def _dealer(group: str, folds: int, totals: list[float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, scale = np.zeros((folds, len(totals))), np.maximum(np.array(totals), 1)
        each = np.arange(folds)
        for batch in batches:
            out = np.zeros(len(batch), dtype=np.int32)
            for at, v in enumerate(batch["v"]):
                tried = np.repeat(held[None], folds, axis=0)
                tried[each, each] += v
                costs = (tried / scale).std(axis=1).mean(axis=1).round(12)
                best = np.lexsort((tried[each, each].sum(axis=1), costs))[0]
                held[best] += v
                out[at] = best
            yield pd.DataFrame({group: batch[group], "fold": out})

    return run


def balanced_folds(counts: DataFrame, group: str, totals: list[float], folds: int, seed: int | None) -> DataFrame:
    """``group``, ``fold``, a written table: folds such that the classes are spread evenly over them.

    Groups are taken by falling deviation of their class counts, equal ones in a seeded random order. Of the first :data:`HEAD` each goes to the
    fold for which the class shares over folds deviate least, and of equals to that with fewest rows; each choice depends on
    those before it, so one task makes them in one ordered pass. The groups beyond them deviate least and could tip no balance: those with
    the same commonest class are dealt to the folds in turn, beginning with the fold that has fewest of its rows, by all tasks.
    """
    # the variance in whole numbers, so that equal ones tie
    square, total = (F.aggregate("v", F.lit(0.0), f) for f in (lambda s, x: s + x * x, lambda s, x: s + x))
    spread = square * F.size("v") - total * total
    ties = [] if seed is None else [uniform(seed, "fold", F.col(group))]
    kind = dict(counts.dtypes)[group]
    order = ["_spread", *(["_tie"] if ties else []), group]
    placed = counts.withColumn("_spread", -spread)
    placed = placed.withColumn("_tie", ties[0]) if ties else placed
    placed = stage(ranked(placed, [], F.col("_spread"), order[1:], "_at"), "ordered-groups")
    first = placed.where(F.col("_at") < HEAD).coalesce(1).sortWithinPartitions("_at")
    dealt = stage(first.select(group, "v").mapInPandas(_dealer(group, folds, totals), f"`{group}` {kind}, fold int"), "folds")
    rest = placed.where(F.col("_at") >= HEAD)
    if rest.isEmpty():
        return dealt
    width = len(totals)
    sums = [F.sum(F.element_at("v", i + 1)).alias(f"n{i}") for i in range(width)]
    held = np.zeros((folds, width))
    for r in dealt.join(counts, group).groupBy("fold").agg(*sums).collect():
        held[r["fold"]] = [r[f"n{i}"] for i in range(width)]
    turns = F.array(*(F.array(*(F.lit(int(f)) for f in np.argsort(held[:, i], kind="stable"))) for i in range(width)))
    main = rest.withColumn("_main", F.array_position("v", F.array_max("v")).cast("int"))
    at = ranked(main, ["_main"], F.col("_at"), [], "_turn")
    tail = at.select(group, F.element_at(F.element_at(turns, F.col("_main")), (F.col("_turn") % folds + 1).cast("int")).cast("int").alias("fold"))
    return stage(dealt.unionByName(tail), "folds")


def stratified_folds(df: DataFrame, group: str, label: str, folds: int, seed: int | None = None) -> DataFrame:
    """``group``, ``fold``."""
    counts, _, totals = class_counts(df, group, label)
    return balanced_folds(counts, group, totals, folds, seed)


def _sides(folds: DataFrame, group: str) -> DataFrame:
    return folds.select(group, F.when(F.col("fold") == 0, "test").otherwise("train").alias("side"))


def stratified_split(df: DataFrame, group: str, label: str, test_size: float = 0.3, seed: int | None = None) -> DataFrame:
    """``group``, ``side``: the first of :func:`fold_count` balanced folds is test."""
    return _sides(stratified_folds(df, group, label, fold_count(test_size), seed), group)


def guaranteed_split(df: DataFrame, group: str, label: str, test_size: float = 0.3, seed: int = 0, ensure: list | None = None, attempts: int = 50) -> tuple[DataFrame, int]:
    """``group``, ``side`` with every label of ``ensure`` on both sides, and the seed that gave it.

    The counts are aggregated once; attempts only order them anew. Raises if no seed does, at once where a label has a single group.
    """
    counts, labels, totals = class_counts(df, group, label)
    wanted = [labels.index(x) for x in (ensure or labels)]
    groups = [F.coalesce(F.sum((F.element_at("v", i + 1) > 0).cast("long")), F.lit(0)).alias(f"g{i}") for i in wanted]
    failed = RuntimeError(f"no split with every label on both sides in {attempts} attempts")
    if groups and min(counts.agg(*groups).first()) < 2:
        raise failed
    more = np.random.default_rng(seed).integers(0, 2**31 - 1, attempts - 1)
    for s in [seed, *(int(x) for x in more)]:
        folds = balanced_folds(counts, group, totals, fold_count(test_size), s)
        held = _sides(folds, group).join(counts, group).groupBy("side").agg(*groups).drop("side").collect()
        if not groups or (len(held) == 2 and all(n > 0 for r in held for n in r)):
            return _sides(folds, group), s
        drop(folds)
    raise failed


def make_splits(df: DataFrame, label: str, unit: str, folds: int, group: str | None = None, seed: int = 0) -> DataFrame:
    """``df`` with ``fold`` for calibration: stratified by label, and with ``group`` no group in two folds.

    Without groups the rows of a label are dealt in a seeded random order of ``unit``. Rows with a null label (or group) are left out.
    """
    if group is not None:
        return df.join(stratified_folds(df, group, label, folds, seed), group)
    known = df.where(F.col(label).isNotNull())
    return ranked(known, [label], uniform(seed, "fold", F.col(unit)), [unit], "_at").withColumn("fold", (F.col("_at") % folds).cast("int")).drop("_at")


def leaking_groups(df: DataFrame, group: str, side: str, a: str = "train", b: str = "test") -> DataFrame:
    """Groups that are on both sides; must be empty."""
    return df.where(F.col(side) == a).select(group).intersect(df.where(F.col(side) == b).select(group))


def class_folds(df: DataFrame, label: str, unit: str, folds: int) -> DataFrame:
    """``unit``, ``label``, ``fold``: contiguous blocks of each class in the order of ``unit``, without shuffling.

    Blocks differ by one row at most, the longer ones come first.
    """
    rows = ranked(df.select(unit, label), [label], F.col(unit), [], "_at", "_n")
    short, longer = F.floor(F.col("_n") / folds), F.col("_n") % folds
    edge = longer * (short + 1)
    fold = F.when(F.col("_at") < edge, F.floor(F.col("_at") / (short + 1))).otherwise(longer + F.floor((F.col("_at") - edge) / F.greatest(short, F.lit(1))))
    return rows.select(unit, label, fold.cast("int").alias("fold"))
