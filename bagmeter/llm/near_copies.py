"""Rows of other splits whose feature vectors also occur, exactly or almost, in the training split."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bagmeter.sources.scratch import drop, stage

#: A pair agrees in at least so many positions ...
AGREE = 17
#: ... each by at most this difference ...
TOLERANCE = 0.02
#: ... of so many.
WIDTH = 20
#: Step of the grid whose points are the shingles of a value, and how many points on each side of it belong to the value.
STEP, REACH = 0.02, 3
#: Values beyond this are equal where they are within the tolerance.
FAR = 1e15
#: Slots of the keys, by which buckets are known as hot, and the rows beyond which a bucket is.
SLOTS, HOT = 1 << 22, 4096
#: Rows by which a hot bucket shows among the vectors on which buckets are measured.
SEEN = 256
#: Parts into which what is left in a hot bucket's finer buckets is cut for the join.
SALTS = 8
#: The bands go through the shuffle in so many passes.
PASSES = 2
#: Width of the cells of a sketch; values within the tolerance are in the same cell or in neighbours.
CELL = 0.025
#: The lowest and the highest bit of each of a sketch's lanes.
_LOW = sum(1 << 3 * i for i in range(WIDTH))
_HIGH = _LOW << 2
#: Bits of the map that tells which vectors have a candidate: a prime, by which sketches are spread.
MARKS = 134_217_689
#: Spark setting by which a query's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Candidate pairs are broadcast up to so many rows (16 bytes each), else joined by shuffle.
BROADCAST_PAIRS = 1_000_000
#: Rounding of decimals stored as doubles.
_EPS = 1e-9


def bands(width: int = WIDTH, agree: int = AGREE) -> list[list[int]]:
    """Positions of each band: one band more than the positions in which a pair may differ."""
    n = width - agree + 1
    return [[int(x) for x in b] for b in np.array_split(np.arange(width), n)]


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Minwise hash step: 64-bit mixing of ``x`` into ``h``; distinct inputs keep distinct chains in practice."""
    with np.errstate(over="ignore"):
        z = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(29)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        return z ^ (z >> np.uint64(32))


def _points(i: np.ndarray, position: int) -> np.ndarray:
    """Hashes of grid points of a position: one random order of all shingles."""
    return _mix(np.full(len(i), position + 1, np.uint64), i.astype(np.int64).view(np.uint64))


def _minima(i: np.ndarray, position: int) -> np.ndarray:
    """Minwise hash of values: the least hash of the grid points within REACH of each."""
    lo, hi = int(i.min()) - REACH, int(i.max()) + REACH
    if hi - lo <= 8 * len(i) + 1000:  # neighbouring values share points, so each point is hashed once
        table = np.lib.stride_tricks.sliding_window_view(_points(np.arange(lo, hi + 1), position), 2 * REACH + 1).min(axis=1)
        return table[i - (lo + REACH)]
    out = _points(i - REACH, position)
    for k in range(1 - REACH, REACH + 1):
        np.minimum(out, _points(i + k, position), out=out)
    return out


def signature(v: np.ndarray, position: int, probe: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """The minima of a position's values, each with a mask of the rows that have it.

    A row has one. With ``probe`` it has those of all values within the tolerance (one or two, mostly), so that it shares one with
    each row that agrees with it.
    """
    far = np.abs(v) >= FAR
    bits = v.view(np.int64)
    place = lambda x: np.where(far, bits >> 8, np.floor(np.where(far, 0.0, x) / STEP).astype(np.int64))
    if not probe:
        return [(np.ones(len(v), bool), _minima(place(v), position))]
    lo, hi = place(v - TOLERANCE - 2 * _EPS), place(v + TOLERANCE + 2 * _EPS)
    out = [(np.ones(len(v), bool), _minima(lo, position))]
    before = out[0][1]
    for k in range(1, int((hi - lo).max()) + 1 if len(v) else 0):
        now = _minima(np.minimum(lo + k, hi), position)
        out.append(((lo + k <= hi) & (now != before), now))
        before = now
    return out


def _chains(minima: list, rows: np.ndarray, start: np.ndarray, positions: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and hashes of a band: every combination of the minima that a row has at ``positions``.

    Rows with a missing value at one of the positions get none.
    """
    h = start
    for i in positions:
        whole, alternatives = minima[i]
        rows, h = rows[whole[rows]], h[whole[rows]]
        parts = [(rows[m[rows]], _mix(h[m[rows]], x[rows[m[rows]]])) for m, x in alternatives]
        rows, h = np.concatenate([r for r, _ in parts]), np.concatenate([k for _, k in parts])
    return rows, h


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("features").flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, WIDTH)


def sketches(x: np.ndarray) -> np.ndarray:
    """A number for each vector: for each position the cell of its value modulo 8, in three bits.

    Where two values agree, their cells differ by one at most. Missing values have the cell 0.
    """
    out = np.zeros(len(x), np.int64)
    for i in range(WIDTH):
        v = np.where(np.isfinite(x[:, i]), x[:, i], 0.0)
        far = np.abs(v) >= FAR
        cell = np.where(far, v.view(np.int64), np.floor(np.where(far, 0.0, v) / CELL).astype(np.int64))
        out |= (cell & 7) << (3 * i)
    return out


def may_agree(a: str, b: str) -> Column:
    """Whether the sketches in two columns are of vectors that can agree in AGREE positions: the other lanes differ by more than one."""
    rest = ((1 << 3 * WIDTH) - 1) ^ _HIGH
    apart = f"((({a} | {_HIGH}L) - ({b} & {rest}L)) ^ (({a} ^ ~{b}) & {_HIGH}L))"  # differences of the lanes, modulo 8
    moved = f"((({apart} & {rest}L) + {_LOW}L) ^ ({apart} & {_HIGH}L))"  # and one more: 0, 1 or 2 where they are near
    return F.expr(f"bit_count((shiftright({moved}, 2) | (shiftright({moved}, 1) & {moved})) & {_LOW}L) <= {WIDTH - AGREE}")


def _bucket_rows(probe: bool, some: list[int], hot: np.ndarray):
    """Bucket keys of each vector, one for each of the bands ``some`` of its minima, and its sketch.

    Buckets in the slots ``hot`` are cut finer by a second band of the other positions, and salted.
    """
    layout = bands()
    others = [[p for p in range(WIDTH) if p not in b] for b in layout]
    finer = [[[int(x) for x in s] for s in np.array_split(np.array(o), WIDTH - AGREE + 1)] for o in others]
    used = range(WIDTH) if len(hot) else [i for b in some for i in layout[b]]

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            # equal vectors of a batch are one
            x = x[np.unique(batch.column("h").to_numpy(), return_index=True)[1]]
            minima: list = [None] * WIDTH
            for i in used:
                whole = np.isfinite(x[:, i])
                minima[i] = (whole, signature(np.where(whole, x[:, i], 0.0), i, probe))
            sketch = sketches(x)
            found = []
            for b in some:
                rows, h = _chains(minima, np.arange(len(x)), np.full(len(x), b + 1, np.uint64), layout[b])
                if not len(hot):
                    found.append((h, rows))
                    continue
                crowded = np.isin((h % np.uint64(SLOTS)).astype(np.int64), hot)
                found.append((h[~crowded], rows[~crowded]))
                rows, h = rows[crowded], h[crowded]
                for s, sub in enumerate(finer[b]):
                    at, k = _sub(minima, rows, h, s, sub)
                    salts = [_mix(np.zeros(len(at), np.uint64), sketch[rows[at]].view(np.uint64)) % np.uint64(SALTS)] if probe else np.arange(SALTS, dtype=np.uint64)
                    found += [(_mix(k, salt + np.uint64(1)), rows[at]) for salt in salts]
            key, rows = (np.concatenate([f[j] for f in found]) for j in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(sketch[rows])], ["key", "sketch"])

    return buckets


def _sub(minima: list, rows: np.ndarray, h: np.ndarray, s: int, sub: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Finer keys of the bucket rows ``rows`` with hashes ``h``, and which of them each is of."""
    own = [(whole[rows], [(m[rows], x[rows]) for m, x in alternatives]) if i in sub else None for i, (whole, alternatives) in enumerate(minima)]
    return _chains(own, np.arange(len(rows)), _mix(h, np.full(len(h), s + 101, np.uint64)), sub)


def comparable(rows: DataFrame, unit: str, split: str, features: str, train: str, others: list[str]) -> DataFrame:
    """One row per unit that can have a near copy: right length, not all values equal."""
    values = F.col(features)
    flat = F.forall(values, lambda v: v.isNotNull() & (v == F.element_at(values, 1)))
    return (
        rows.where(F.col(split).isin(train, *others) & F.col(unit).isNotNull() & (F.size(values) == WIDTH) & ~F.coalesce(flat, F.lit(False)))
        .select(
            F.col(unit).cast("long").alias("id"), F.col(split).isin(*others).alias("probe"), values.cast("array<double>").alias("features"),
            F.xxhash64(values).alias("h"),
        )
    )


def _agreeing(a: Column, b: Column) -> Column:
    """Positions in which two vectors agree; a null or NaN agrees with nothing."""
    near = F.zip_with(a, b, lambda x, y: F.coalesce((F.abs(x - y) <= TOLERANCE + _EPS).cast("int"), F.lit(0)))
    return F.aggregate(near, F.lit(0), lambda acc, v: acc + v)


def _attach(pairs: DataFrame, vectors: DataFrame, of: str, n_pairs: int) -> DataFrame:
    """``pairs`` with the ids and vectors behind the sketch ``of``_sketch; the pairs are broadcast only if they are few."""
    side = F.broadcast(pairs) if n_pairs <= BROADCAST_PAIRS else pairs
    return vectors.select(F.col("sketch").alias(f"{of}_sketch"), F.col("id").alias(f"{of}_id"), F.col("features").alias(f"{of}_features")).join(side, f"{of}_sketch")


def _buckets(vectors: DataFrame, probe: bool, some: list[int], hot: np.ndarray) -> DataFrame:
    side = vectors.where("probe" if probe else "not probe").select("h", "features")
    # distinct within the partitions of the join, so that copies in different batches don't meet more than once
    return side.mapInArrow(_bucket_rows(probe, some, hot), "key long, sketch long").repartition("key").dropDuplicates()


def _hot_slots(vectors: DataFrame) -> np.ndarray:
    """Slots of the buckets with more than HOT vectors, as measured on a fixed part of the vectors, by their hash.

    What is taken for hot only decides how a bucket is cut: no pair depends on it.
    """
    every = max(1, HOT // SEEN)
    measured = vectors.where(F.pmod("h", F.lit(every)) == 0)
    none = np.zeros(0, np.int64)
    keys = [_buckets(measured, probe, list(range(len(bands()))), none).select("key") for probe in (False, True)]
    counts = keys[0].unionByName(keys[1]).groupBy("key").count().where(F.col("count") * every > HOT)
    # at most SLOTS rows reach the driver, whatever the input; keys are hashes, so the slot of a signed key is that of the unsigned one
    slots = stage(counts.select(F.pmod("key", F.lit(SLOTS)).alias("slot")).distinct(), "hot-slots")
    hot = slots.toArrow()["slot"].to_numpy()
    return np.sort(hot)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query written in here are deleted as soon as it ends, not when the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def _candidates(vectors: DataFrame) -> DataFrame:
    """``train_sketch``, ``other_sketch``, a written table: sketches of vectors that share a bucket and may agree.

    A pass writes the bucket rows of its bands, and only pairs whose sketches may agree leave the join, so neither bucket rows
    nor pairs of chance, whose number grows with the square of the input, are kept. Rows of hot buckets meet in finer buckets,
    salted, as these may be hot again.
    """
    passes: list[DataFrame] = []
    with _shuffles_dropped(vectors.sparkSession):
        hot = _hot_slots(vectors)
        for some in np.array_split(np.arange(len(bands())), PASSES):
            left, right = (_buckets(vectors, probe, some.tolist(), hot) for probe in (False, True))
            pairs = left.withColumnRenamed("sketch", "train_sketch").join(right.withColumnRenamed("sketch", "other_sketch"), "key")
            passes.append(stage(pairs.where(may_agree("train_sketch", "other_sketch")).select("train_sketch", "other_sketch").distinct(), "band-pairs"))
        found = stage(reduce(DataFrame.unionByName, passes).distinct(), "near-pairs")
    drop(*passes)
    return found


def _marked(marks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = sketches(_matrix(batch))
            at = sketch % MARKS
            some = pa.array((marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)
            yield pa.RecordBatch.from_arrays([pa.array(sketch), *batch.columns], ["sketch", *batch.schema.names]).filter(some)

    return run


def _of_pairs(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """``sketch``, ``id``, ``probe``, ``features``, a written table: the vectors that have a candidate, and few others.

    The sketches of the pairs are bits of a map of fixed size, so that other vectors aren't shuffled.
    """
    place = pairs.select(F.explode(F.array("train_sketch", "other_sketch")).alias("s")).select((F.col("s") % MARKS + 1).alias("place"))
    parts = place.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    marks = np.zeros((MARKS // 32768 + 1, 4096), np.uint8)
    for r in stage(parts, "near-marks").toLocalIterator():
        marks[r["part"] - 1] = np.frombuffer(r["bits"], np.uint8)
    found = vectors.select("id", "probe", "features").mapInArrow(_marked(marks.ravel()), "sketch long, id long, probe boolean, features array<double>")
    return stage(found, "near-vectors")


def _agreement(with_train: DataFrame, with_other: DataFrame) -> DataFrame:
    """Pairs that agree in at least AGREE positions of their exact values, with ``agree`` and ``jaccard``."""
    agree = _agreeing(F.col("train_features"), F.col("other_features"))
    checked = with_train.join(with_other, ["train_sketch", "other_sketch"]).withColumn("agree", agree).where(F.col("agree") >= AGREE)
    return checked.withColumn("jaccard", F.col("agree") / (2 * WIDTH - F.col("agree")))


def near_copies(rows: DataFrame, unit: str, split: str, features: str, train: str, others: list[str]) -> DataFrame:
    """Pairs ``train_id``, ``other_id``, ``agree``, ``jaccard`` of a training row and a row of another split.

    Minwise hashing in one permutation with a bin for each position: the shingles of a value are the points of a fine grid around it, the
    signature has for each position the shingle with the least hash, and bands of it make buckets. There is one band more
    than a pair may have differing positions, and the rows that probe take the minima of all values within the tolerance,
    so every true pair meets in a bucket: the recall is 1, not a matter of chance. Hot buckets are cut finer by a
    second band of the other positions, which loses nothing either. Only pairs of a
    training row and another row are formed. Buckets hold sketches of whole vectors, so copies of
    one vector, however many, are one entry, and chance pairs are known in the join by their sketches; rows are told apart when a
    pair is checked on the exact values: agreement m of 20 is an exact Jaccard similarity of m / (40 - m).

    A null, NaN or infinite value agrees with nothing; lists of another length, null lists and vectors of equal
    values have no pair; rows delivered more than once count once; no input gives no rows. Other columns aren't read.
    """
    vectors = comparable(rows, unit, split, features, train, others)
    pairs = _candidates(vectors)
    vectors, n = _of_pairs(vectors, pairs), pairs.count()
    found = _agreement(_attach(pairs, vectors.where("not probe"), "train", n), _attach(pairs, vectors.where("probe"), "other", n))
    return found.select("train_id", "other_id", "agree", "jaccard").distinct()


def copy_report(rows: DataFrame, unit: str, split: str, features: str, train: str, others: list[str], by: list[str]) -> DataFrame:
    """``by``, ``pairs``, ``units``, ``best_jaccard``: the pairs of :func:`near_copies` by columns of the other row.

    Equal vectors are classes with counts on both sides, so a vector with many copies is one row here, not one for each pair.
    Rows delivered more than once count once, with the columns ``by`` of one of them.
    """
    vectors = comparable(rows, unit, split, features, train, others)
    pairs = _candidates(vectors)
    vectors, n = _of_pairs(vectors, pairs), pairs.count()
    classes = _attach(pairs, vectors.where("not probe"), "train", n).groupBy("train_sketch", "other_sketch", "train_features").agg(F.countDistinct("train_id").alias("n_train"))
    asked = rows.where(F.col(split).isin(*others) & F.col(unit).isNotNull()).select(F.col(unit).cast("long").alias("other_id"), *by).dropDuplicates(["other_id"])
    members = _attach(pairs, vectors.where("probe"), "other", n).distinct().join(asked, "other_id")
    others_ = members.groupBy("train_sketch", "other_sketch", "other_features", *by).agg(F.count("*").alias("n_other"))
    found = _agreement(classes, others_)
    per_class = found.groupBy("other_sketch", "other_features", *by).agg(
        F.sum("n_train").alias("n_train"), F.max("n_other").alias("n_other"), F.max("jaccard").alias("best")
    )
    return per_class.groupBy(*by).agg(
        F.sum(F.col("n_train") * F.col("n_other")).alias("pairs"), F.sum("n_other").alias("units"), F.max("best").alias("best_jaccard")
    )
