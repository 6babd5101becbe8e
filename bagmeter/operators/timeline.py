"""Windows over ordered events."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagmeter.functions.ranks import ranked


#: Rows of one key that are framed in one task.
CHUNK = 10_000


def tumbling(df: DataFrame, key: str, order: Column, ties: list[str], size: int, at: str = "window_at") -> DataFrame:
    """``df`` with ``at``: the number of its window of ``size`` consecutive rows of a key; the last one may be short.

    ``order`` is a whole number such as microseconds; ``ties`` settle equal ones.
    """
    return ranked(df, [key], order, ties, "_place").withColumn(at, F.floor(F.col("_place") / size).cast("int")).drop("_place")


def window_share(df: DataFrame, keys: list[str], positive: Column) -> DataFrame:
    """``keys``, ``n``, ``share``: share of positive rows of each window; 0 where none is."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(positive.cast("double")).alias("share"))


def most_diverse_window(df: DataFrame, key: str, order: Column, ties: list[str], label: str, classes: list[str], size: int = 30, stride: int = 1) -> DataFrame:
    """``key``, ``first_at``, ``last_at``, ``score``: the window of ``size`` rows with the most varied labels of each key.

    The score is the number of distinct labels plus their entropy over ln(size), among rows of
    ``classes``; windows without such rows are skipped, the earliest of equal ones wins. If all are skipped it is the first
    window. Keys with fewer than ``size`` rows have none. Positions count from 0.

    Keys are framed in chunks that overlap by a window, so a key with most of the rows is spread over tasks.
    """
    chunk = F.floor(F.col("at") / CHUNK)
    overlaps = (F.col("at") % CHUNK < size - 1) & (chunk > 0)
    spread = ranked(df.select(key, label, order.alias("_o"), *ties), [key], F.col("_o"), ties, "at").withColumn(
        "_chunk", F.explode(F.when(overlaps, F.array(chunk - 1, chunk)).otherwise(F.array(chunk)))
    )
    ordered = Window.partitionBy(key, "_chunk").orderBy("at")
    frame = ordered.rowsBetween(0, size - 1)
    counts = [F.sum((F.col(label) == c).cast("int")).over(frame).alias(f"_n{i}") for i, c in enumerate(classes)]
    rows = spread.select(key, "at", "_chunk", F.count("*").over(frame).alias("_rows"), *counts).where(chunk == F.col("_chunk"))
    numbers = [F.coalesce(F.col(f"_n{i}"), F.lit(0)) for i in range(len(classes))]
    total = sum(numbers, F.lit(0))
    share = lambda n: n / F.nullif(total, F.lit(0))
    entropy = -sum((F.when(n > 0, share(n) * F.log(share(n) + 1e-12)).otherwise(0.0) for n in numbers), F.lit(0.0))
    distinct = sum(((n > 0).cast("int") for n in numbers), F.lit(0))
    score = F.when(total > 0, F.round(distinct + entropy / math.log(size), 9)).otherwise(F.lit(-1.0))
    whole = rows.where((F.col("_rows") == size) & (F.col("at") % stride == 0)).select(key, "at", score.alias("score"))
    best = F.max_by(F.struct("at", "score"), F.struct("score", (-F.col("at")).alias("early")))
    return whole.groupBy(key).agg(best.alias("b")).select(key, F.col("b.at").alias("first_at"), (F.col("b.at") + size - 1).alias("last_at"), F.col("b.score").alias("score"))


def segment_bounds(df: DataFrame, key: str, at: str, length: str, margin: int = 40) -> DataFrame:
    """``df`` with ``seg_start`` and ``seg_end``: segments around annotations, cut halfway to their neighbours.

    A key's annotations are cut into pieces of :data:`CHUNK`, so no task holds a key. ``at`` and ``length`` are whole columns; the outer ends lie ``margin`` beyond the first and last annotation, within the signal.
    """
    # pieces of a key's order; the rows at a border also go to the piece beyond it, as neighbours only
    places = ranked(df, [key], F.col(at), [], "_at")
    own, inside = F.floor(F.col("_at") / CHUNK), F.col("_at") % CHUNK
    pieces = F.when((inside == 0) & (own > 0), F.array(own, own - 1)).when(inside == CHUNK - 1, F.array(own, own + 1)).otherwise(F.array(own))
    ordered = Window.partitionBy(key, "_piece").orderBy("_at")
    before, after = F.lag(at).over(ordered), F.lead(at).over(ordered)
    start = F.coalesce(F.floor((before + F.col(at)) / 2), F.greatest(F.lit(0), F.col(at) - margin))
    end = F.coalesce(F.floor((F.col(at) + after) / 2), F.least(F.col(length), F.col(at) + margin))
    spread = places.withColumn("_own", own).withColumn("_piece", F.explode(pieces))
    return spread.withColumns({"seg_start": start.cast("int"), "seg_end": end.cast("int")}).where("_piece = _own").drop("_at", "_own", "_piece")
