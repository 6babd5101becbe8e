"""Estimators that solve a small problem per bag.

Everything that depends on the training data is an aggregation to a small table of class
statistics. What a bag contributes is aggregated too where a few numbers suffice (confusion
shares, histograms); only EM and the cost-sensitive threshold read a bag's scores themselves.
They count equal scores first, and EM takes bags beyond a size by aggregations, so no group is unbounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagmeter.config import LABELS
from bagmeter.functions.distance_series import WIDTHS, Series, nearest
from bagmeter.functions.ranks import percentiles
from bagmeter.operators import solvers
from bagmeter.sources.scratch import drop, stage

#: Bags that a solver takes at once.
SOLVED_ROWS = 2048
#: Distinct score vectors of a bag that one task takes whole.
WHOLE_BAG = 100_000


def _matrix(rows: list, at: str, of: str, value: str, size: tuple[int, int]) -> np.ndarray:
    out = np.zeros(size)
    for r in rows:
        out[r[at], r[of]] = r[value]
    return out


def class_matrix(train: DataFrame, vector: str, labels: tuple[str, ...] = LABELS) -> tuple[np.ndarray, np.ndarray]:
    """Mean of ``vector`` by class, as columns, and the shares of the classes: labels x features numbers, collected."""
    k = len(labels)
    index = F.array_position(F.array(*map(F.lit, labels)), F.col("y")) - 1
    some = train.select(vector).where(F.col(vector).isNotNull()).first()
    width = len(some[0]) if some else k
    means = [F.avg(F.element_at(vector, i + 1)).alias(f"m{i}") for i in range(width)]
    rows = train.where(F.col("y").isin(*labels)).groupBy(index.alias("c")).agg(F.count("*").alias("n"), *means).collect()
    c, prior = np.zeros((width, k)), np.zeros(k)
    for r in rows:
        c[:, r["c"]] = [r[f"m{i}"] or 0.0 for i in range(width)]
        prior[r["c"]] = r["n"]
    return c, prior / max(prior.sum(), 1)


def solved(bags: DataFrame, keys: list[str], vector: str, width: int, solve, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``keys``, ``label``, ``p_pred``: ``solve`` of the mean of ``vector`` over each bag.

    The means are aggregated by Spark; the solver sees one short vector per bag, in Arrow batches.
    """
    means = [F.avg(F.element_at(vector, i + 1)) for i in range(width)]
    return solved_means(bags.groupBy(*keys).agg(F.array(*means).alias("q")), keys, solve, labels)


def solved_means(means: DataFrame, keys: list[str], solve: Callable[[np.ndarray], np.ndarray], labels: tuple[str, ...] = LABELS, dense=None) -> DataFrame:
    """As :func:`solved`, from the vector ``q`` of each bag; ``solve`` takes a matrix with one row per bag.

    ``dense`` makes such a matrix of a batch's ``q`` where these aren't vectors of one length.
    """
    kinds = dict(means.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "label string", "p_pred double"])
    make = dense or (lambda column: np.vstack([np.asarray(v, dtype=float) for v in column]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), SOLVED_ROWS):
                batch = whole.iloc[at : at + SOLVED_ROWS]
                p = solve(make(batch["q"]))
                out = {k: np.repeat(batch[k].to_numpy(), len(labels)) for k in keys}
                yield pd.DataFrame({**out, "label": np.tile(np.array(labels, dtype=object), len(batch)), "p_pred": p.ravel()})

    return means.select(*keys, "q").mapInPandas(run, schema)


def one_hot(pred: Column, labels: tuple[str, ...] = LABELS) -> Column:
    return F.array(*((pred == x).cast("double") for x in labels))


def above_prior(p: Column, prior: np.ndarray) -> Column:
    """Whether each score reaches the training share of its class."""
    return F.array(*((F.element_at(p, i + 1) >= float(v)).cast("double") for i, v in enumerate(prior)))


def mixture(train: DataFrame, bags: DataFrame, keys: list[str], kind: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """GAC (``hard``), GPAC (``soft``) and FM (``prior``): the class shares that explain a bag's mean outputs best.

    ``train`` (out of fold) and ``bags`` have ``y``, ``p``, ``pred``.
    """
    if kind == "hard":
        make = lambda df: df.withColumn("_v", one_hot(F.col("pred"), labels))
    elif kind == "soft":
        make = lambda df: df.withColumn("_v", F.col("p"))
    else:
        prior = class_matrix(train, "p", labels)[1]
        make = lambda df: df.withColumn("_v", above_prior(F.col("p"), prior))
    c, start = class_matrix(make(train), "_v", labels)
    return solved(make(bags), keys, "_v", len(labels), lambda q: solvers.least_squares(c, q, start), labels)


def emq(train: DataFrame, bags: DataFrame, keys: list[str], labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Expectation maximization per bag until it settles, from distinct score vectors with their counts.

    A bag with more than :data:`WHOLE_BAG` vectors isn't gathered: its rounds are aggregations over all tasks.
    """
    prior = class_matrix(train, "p", labels)[1]
    kinds = dict(bags.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "label string", "p_pred double"])
    counted = stage(bags.groupBy(*keys, "p").agg(F.count("*").alias("n")), "bag-vectors")
    large = stage(counted.groupBy(*keys).agg(F.count("*").alias("_size")).where(F.col("_size") > WHOLE_BAG).select(*keys), "large-bags")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = solvers.expectation_maximization(np.vstack(pdf["p"].to_list()), prior, pdf["n"].to_numpy(dtype=float))
        return pd.DataFrame({**dict(zip(keys, key)), "label": list(labels), "p_pred": p})

    if large.isEmpty():
        return counted.groupBy(*keys).applyInPandas(run, schema)
    whole = counted.join(large, keys, "left_anti").groupBy(*keys).applyInPandas(run, schema)
    return whole.unionByName(_settled(counted.join(large, keys, "left_semi"), keys, prior, labels))


def _settled(counted: DataFrame, keys: list[str], prior: np.ndarray, labels: tuple[str, ...]) -> DataFrame:
    """EM of bags of any size: each round is one aggregation, written, until no share moves by the tolerance of the solver."""
    safe = np.maximum(prior, 1e-12)
    start = F.array(*(F.lit(float(v)) for v in safe / safe.sum()))
    shares = stage(counted.select(*keys).distinct().withColumn("g", start), "shares")
    for _ in range(solvers.EM_ROUNDS):
        parts = F.zip_with(F.zip_with("p", "g", lambda x, y: x * y), F.array(*(F.lit(float(v)) for v in safe)), lambda x, y: x / y)
        weighted = counted.join(shares, keys).select(*keys, "n", parts.alias("w"))
        weighted = weighted.withColumn("t", F.greatest(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), F.lit(1e-300)))
        means = F.array(*(F.sum(F.col("n") * F.element_at("w", i + 1) / F.col("t")) / F.sum("n") for i in range(len(safe))))
        fresh = weighted.groupBy(*keys).agg(means.alias("g"))
        moved = F.aggregate(F.zip_with("g", "_g", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: F.greatest(a, x))
        both = stage(fresh.join(shares.withColumnRenamed("g", "_g"), keys).withColumn("moved", moved), "shares")
        drop(shares)
        shares = both.select(*keys, "g")
        shares._scratch_path = both._scratch_path
        if both.where(F.col("moved") >= solvers.EM_TOLERANCE).isEmpty():
            break
    pairs = F.arrays_zip(F.array(*map(F.lit, labels)).alias("label"), F.col("g").alias("p_pred"))
    return shares.select(*keys, F.explode(pairs).alias("z")).select(*keys, "z.label", "z.p_pred")


def emq_fixed(bags: DataFrame, keys: list[str], prior: list[float], rounds: int, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """EM with a fixed number of rounds as plain aggregations, for bags of any size.

    ``bags``: ``keys`` and the scores ``p`` in the order of ``labels``. A round re-weights each row's scores
    by the shares so far and averages them; the shares are one small row per bag, joined back on the bag.
    """
    safe = [max(float(v), 1e-12) for v in prior]
    shares = None
    for _ in range(rounds):
        if shares is None:
            current = bags.select(*keys, "p").withColumn("g", F.array(*(F.lit(v / sum(safe)) for v in safe)))
        else:
            current = bags.select(*keys, "p").join(shares, keys)
        parts = [F.element_at("p", i + 1) * F.element_at("g", i + 1) / F.lit(v) for i, v in enumerate(safe)]
        weighted = current.select(*keys, F.array(*parts).alias("w")).withColumn("t", F.aggregate("w", F.lit(0.0), lambda a, x: a + x))
        shares = weighted.groupBy(*keys).agg(F.array(*(F.avg(F.element_at("w", i + 1) / F.col("t")) for i in range(len(safe)))).alias("g"))
    pairs = F.arrays_zip(F.array(*map(F.lit, labels)).alias("label"), F.col("g").alias("p_pred"))
    return shares.select(*keys, F.explode(pairs).alias("z")).select(*keys, "z.label", "z.p_pred")


def cde(bag_scores: DataFrame, rates: DataFrame, keys: list[str]) -> DataFrame:
    """Class distribution estimation of each label against the rest, from distinct scores with their counts.

    Scores have six decimals, so a group has a million rows at most, however large a bag is.
    ``bag_scores``: ``keys``, ``label``, ``p``; ``rates``: ``label``, ``prior``, ``tpr``, ``fpr``, one row per class.
    """
    kinds = dict(bag_scores.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "label string", "p_pred double"])
    counted = bag_scores.groupBy(*keys, "label", F.round("p", 6).alias("p")).agg(F.count("*").alias("n")).join(F.broadcast(rates), "label")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        p = solvers.cost_sensitive_share(pdf["p"].to_numpy(), r["prior"], r["tpr"] or 0.0, r["fpr"] or 0.0, pdf["n"].to_numpy(dtype=float))
        return pd.DataFrame({**dict(zip([*keys, "label"], key)), "p_pred": [p]})

    return counted.groupBy(*keys, "label").applyInPandas(run, schema)


def feature_edges(train: DataFrame, features: str, width: int, bins: int) -> list[list[float]]:
    """Inner bin edges of each feature: linear quantiles of the training values, without repeats (width x bins numbers)."""
    flat = train.select(F.posexplode(features).alias("i", "v")).where(F.col("i") < width)
    out: list[set[float]] = [set() for _ in range(width)]
    for r in percentiles(flat, ["i"], F.col("v"), [i / bins for i in range(1, bins)]).collect():
        out[r["i"]].add(r["value"])
    return [sorted(cut) for cut in out]


def discretized(features: str, edges: list[list[float]]) -> Column:
    """Ordinal bins of the features; values beyond the training range fall into the end bins."""
    return F.array(
        *(sum(((F.element_at(features, i + 1) >= F.lit(e)).cast("int") for e in cut), F.lit(0)) for i, cut in enumerate(edges))
    )


def coded_matrix(train: DataFrame, codes: Column, parts: int, size: int, labels: tuple[str, ...] = LABELS) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies of each part's codes by class, as columns, and the shares of the classes: labels x parts x size numbers, collected."""
    k = len(labels)
    index = F.array_position(F.array(*map(F.lit, labels)), F.col("y")) - 1
    flat = train.where(F.col("y").isin(*labels)).select(index.alias("c"), F.posexplode(codes).alias("part", "code"))
    c = np.zeros((parts * size, k))
    for r in flat.groupBy("c", "part", "code").agg(F.count("*").alias("n")).collect():
        c[r["part"] * size + r["code"], r["c"]] = r["n"]
    rows = c[:size].sum(axis=0)
    return c / np.maximum(rows, 1), rows / max(rows.sum(), 1)


def coded_means(bags: DataFrame, keys: list[str], codes: Column, size: int) -> DataFrame:
    """``keys``, ``q``: the counts of the codes of each bag, as (part and code, count) of those that occur."""
    flat = bags.select(*keys, F.explode(F.transform(codes, lambda c, part: part * size + c)).alias("at"))
    counts = flat.groupBy(*keys, "at").agg(F.count("*").cast("double").alias("n"))  # combined before the shuffle
    # at most parts x size entries per bag
    return counts.groupBy(*keys).agg(F.collect_list(F.array(F.col("at").cast("double"), F.col("n"))).alias("q"))


def _dense(parts: int, size: int):
    """A matrix of code frequencies, one row per bag."""

    def make(column) -> np.ndarray:
        q = np.zeros((len(column), parts * size))
        for row, entries in enumerate(column):
            at, n = np.array([np.asarray(e) for e in entries]).T
            q[row, at.astype(int)] = n
        return q / np.maximum(q[:, :size].sum(axis=1, keepdims=True), 1)

    return make


def hdx(train: DataFrame, bags: DataFrame, keys: list[str], features: str, width: int, bins: int = 8, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Mixture of class histograms of the features with least Hellinger distance, all features together."""
    codes = discretized(features, feature_edges(train, features, width, bins))
    c, start = coded_matrix(train, codes, width, bins, labels)
    return solved_means(coded_means(bags, keys, codes, bins), keys, lambda q: solvers.hellinger_mixture(c, q, start), labels, _dense(width, bins))


def readme(
    train: DataFrame, bags: DataFrame, keys: list[str], features: str, width: int, bins: int = 2, subset: int = 5, subsets: int = 8,
    seed: int = 7, labels: tuple[str, ...] = LABELS,
) -> DataFrame:
    """Mean over random feature subsets of the mixture that explains the frequencies of bin patterns."""
    edges = feature_edges(train, features, width, bins)
    rng = np.random.default_rng(seed)
    chosen = [sorted(int(i) for i in rng.choice(width, min(subset, width), replace=False)) for _ in range(subsets)]
    place = lambda i: sum(((F.element_at(features, i + 1) >= F.lit(e)).cast("int") for e in edges[i]), F.lit(0))
    codes = F.array(*(sum((place(i) * (bins**at) for at, i in enumerate(some)), F.lit(0)) for some in chosen))
    size = bins ** len(chosen[0])
    c, start = coded_matrix(train, codes, subsets, size, labels)

    def solve(q: np.ndarray) -> np.ndarray:
        parts = [slice(i * size, (i + 1) * size) for i in range(subsets)]
        return np.mean([solvers.least_squares(c[s], q[:, s], start) for s in parts], axis=0)

    return solved_means(coded_means(bags, keys, codes, size), keys, solve, labels, _dense(subsets, size))


#: Bytes of training vectors that are sent to the tasks in one pass; more vectors make more passes.
PASS_BYTES = 8_000_000
#: Rows and columns of a tile of distances.
TILE = 256
#: A vector that is a larger part of its class than one of so many rows is measured pair by pair, so is every vector of a class of fewer rows.
SERIES_ROWS = 10_000
#: A class whose distances get a larger part than this (root mean square) from the last polynomial of their series is measured pair by pair.
LAST_PART = 1e-5
#: Rows that a task sums up for a series, and numbers of such sums in a row.
SUMMED_ROWS, PIECE = 100_000, 8192


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def folded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices whose product has the squared distances of the rows of ``a`` and ``b``."""
    left = np.column_stack([a, (a * a).sum(1), np.ones(len(a))])
    right = np.column_stack([-2 * b, np.ones(len(b)), (b * b).sum(1)])
    return left, np.ascontiguousarray(right.T)


def distance_sums(a: np.ndarray, points: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sums of the distances of each row of ``a`` to the weighted vectors of each class."""
    out = np.zeros((len(a), len(points)))
    for c, (b, weight) in enumerate(points):
        if not len(b):
            continue
        left, right = folded(a, b)
        for i in range(0, len(a), TILE):
            x = left[i : i + TILE]
            for j in range(0, len(b), TILE):
                square = x @ right[:, j : j + TILE]
                out[i : i + TILE, c] += np.sqrt(np.maximum(square, 0, out=square), out=square) @ weight[j : j + TILE]
    return out


def _to_classes(points: list[tuple[np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                d = distance_sums(_vectors(batch.column("x")), points)
                yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("g"), *map(pa.array, d.T)], ["h", "g", *(f"d{i}" for i in range(len(points)))])

    return run


def _between_classes(points: list[tuple[np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(points)
        sums = np.zeros((k, k))
        for batch in batches:
            if not len(batch):
                continue
            c, below = batch.column("c").to_numpy(), batch.column("below").to_numpy(zero_copy_only=False)
            d = distance_sums(_vectors(batch.column("x")), points) * batch.column("w").to_numpy()[:, None]
            for i in range(k):
                sums[i] += d[c == i].sum(axis=0)
                sums[:, i] += d[(c == i) & below].sum(axis=0)  # the pass of those rows doesn't see this block
        at, of = np.indices((k, k), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (at, of, sums)], ["c", "other", "s"])

    return run


def _class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        if len(batch):
            c, x, w = batch.column("c").to_numpy(), _vectors(batch.column("x")), batch.column("w").to_numpy()
            for i in np.unique(c):
                yield int(i), x[c == i], w[c == i]


def _weighted_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for i, x, w in _class_rows(batches):
        yield pa.RecordBatch.from_pydict({"c": pa.array([i], pa.int32()), "n": [w.sum()], "v": [w @ x]})


def _radii(centres: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, x, _ in _class_rows(batches):
            at = nearest(x, i, centres)
            for g in np.unique(at):
                r = np.sqrt(((x[at == g] - centres[int(g)]) ** 2).sum(1))
                yield pa.RecordBatch.from_pydict({"c": pa.array([g], pa.int32()), "low": [r.min()], "high": [r.max()]})

    return run


def _series_sums(centres: dict[int, np.ndarray], empty: dict[int, tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, Series] = {}
        for i, x, w in _class_rows(batches):
            at = nearest(x, i, centres)
            for g in map(int, np.unique(at)):
                if g not in parts:
                    parts[g] = Series.empty(*empty[g])
                parts[g].add(x[at == g], w[at == g], i)
        for g, part in parts.items():
            flat = np.concatenate([s.ravel() for s in part.sums])
            for at in range(0, len(flat), PIECE):
                yield pa.RecordBatch.from_pydict({"c": pa.array([g], pa.int32()), "at": pa.array([at], pa.int32()), "v": [flat[at : at + PIECE]]})

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.iloc[:1].assign(v=[np.sum(np.stack(rows["v"].to_list()), axis=0)])


def class_series(rows: DataFrame, k: int) -> dict[int, Series]:
    """The series of each of ``k`` classes from ``c``, ``x``, ``w``; only sums reach the driver."""
    first = rows.select(F.size("x")).first()
    if first is None or not WIDTHS[0] <= first[0] <= WIDTHS[1]:
        return {}
    n, v = {}, {}
    for r in rows.mapInArrow(_weighted_sums, "c int, n double, v array<double>").toLocalIterator():
        n[r["c"]], v[r["c"]] = n.get(r["c"], 0) + r["n"], v.get(r["c"], 0) + np.array(r["v"])
    centres = {i: v[i] / n[i] for i in sorted(n)}
    spans = rows.mapInArrow(_radii(centres), "c int, low double, high double").groupBy("c").agg(F.min("low"), F.max("high")).collect()
    spans = {g: (low, high) for g, low, high in spans}
    empty = {g: (g, k, centres[g], *spans.get(g, (0.0, 0.0))) for g in centres}
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // SUMMED_ROWS)
    summed = rows.coalesce(tasks).mapInArrow(_series_sums(centres, empty), "c int, at int, v array<double>")
    pieces = summed.groupBy("c", "at").applyInPandas(_added, "c int, at int, v array<double>").toArrow().combine_chunks()
    at, c, values = pieces["at"].to_numpy(), pieces["c"].to_numpy(), pieces["v"]
    out = {g: Series.empty(*empty[g]) for g in centres}
    for g in spans:
        flat = np.concatenate([values[int(p)].values.to_numpy() for p in sorted(np.flatnonzero(c == g), key=lambda p: at[p])])
        ends = np.cumsum([s.size for s in out[g].sums])
        out[g].sums = [part.reshape(s.shape) for s, part in zip(out[g].sums, np.split(flat, ends[:-1]))]
    return out


def _series_between(series: dict[int, Series], n: np.ndarray):
    """Of each class to itself and to the larger ones: sums of distances, of their squares and of the squares of the last polynomial."""
    centres = {g: s.centre for g, s in series.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, x, w in _class_rows(batches):
            to = [j for j in series if (n[i], i) <= (n[j], j)]
            at, d = nearest(x, i, centres), np.zeros((2, len(n), len(x)))
            for g, s in series.items():
                for some, itself in ((at == g, (i, w[at == g])), (at != g, None)):
                    d[:, :, some] += s.distances(x[some], itself, whole=g in to)
            d = d[:, to]
            yield pa.RecordBatch.from_pydict(
                {"c": pa.array([i] * len(to), pa.int32()), "other": pa.array(to, pa.int32()), "s": d[0] @ w, "squares": d[0] ** 2 @ w, "last": d[1] ** 2 @ w}
            )

    return run


def _series_to_classes(series: dict[int, Series]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _vectors(batch.column("x"))
                d = sum(s.distances(x) for s in series.values())
                yield pa.RecordBatch.from_pydict({name: batch.column(name) for name in "hgw"} | {f"{name}{i}": d[at, i] for i in series for at, name in enumerate("dl")})

    return run


def _for_all_tasks(written: DataFrame, tasks: int) -> DataFrame:
    """A small table in as many parts as there are tasks; a large one has them anyway."""
    return written if written.rdd.getNumPartitions() >= written.sparkSession.sparkContext.defaultParallelism else stage(written.repartition(tasks), "spread-vectors")


def energy_distance(train: DataFrame, bags: DataFrame, keys: list[str], features: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Class shares whose mixture has least energy distance to the bag.

    Mean distances are those over all training rows: between the rows of two classes (of a class, between different
    rows), and from each row of a bag to the rows of a class. Equal vectors are counted and measured once. Distances
    to the vectors of classes beyond ``SERIES_ROWS`` rows come from a series (``distance_series``), so the work grows
    with the rows; where its last polynomial still counts, and for small classes and frequent vectors, from all pairs.
    Vectors whose pairs are measured are sent to the tasks in passes of bounded size; a pass adds up distances to its
    block from each distinct vector of the bags, from the training vectors of this block and the blocks before it, and
    from those in a series. Classes without training rows get a share of 0.
    """
    spark, k = train.sparkSession, len(labels)
    index = (F.array_position(F.array(*map(F.lit, labels)), F.col("y")) - 1).cast("int")
    vector = F.col(features).cast("array<double>")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = train.where(F.col("y").isin(*labels) & F.col(features).isNotNull())
    counted = rows.groupBy(index.alias("c"), vector.alias("x")).agg(F.count("*").cast("double").alias("w"))
    trained = _for_all_tasks(stage(counted, "train-vectors"), tasks)
    name = [F.xxhash64("x").alias("h"), F.xxhash64(F.lit(1), "x").alias("g")]  # 128 bits that stand for a vector in joins
    given = bags.where(F.col(features).isNotNull()).select(*keys, vector.alias("x"))
    asked = given.select(*keys, *name).groupBy(*keys, "h", "g").agg(F.count("*").alias("n"))
    units = _for_all_tasks(stage(given.groupBy("x").agg(F.count("*").cast("double").alias("w")).select(*name, "x", "w"), "test-vectors"), tasks)
    n = np.zeros(k)
    for r in trained.groupBy("c").agg(F.sum("w").alias("n")).collect():
        n[r["c"]] = r["n"]
    paired = F.col("w") * SERIES_ROWS >= F.element_at(F.array(*(F.lit(float(v)) for v in n)), F.col("c") + 1)
    series = class_series(trained.where(~paired), k)
    sums, squares, last, far = np.zeros((k, k)), np.zeros((k, k)), np.zeros((k, k)), None
    if series:
        for r in (
            trained.where(~paired & F.col("c").isin(*series))
            .mapInArrow(_series_between(series, n), "c int, other int, s double, squares double, last double")
            .groupBy("c", "other")
            .agg(F.sum("s").alias("s"), F.sum("squares").alias("squares"), F.sum("last").alias("last"))
            .collect()
        ):
            i, j = r["c"], r["other"]
            sums[i, j] = sums[j, i] = r["s"]
            squares[i, j], last[i, j] = r["squares"], r["last"]
        far = stage(units.mapInArrow(_series_to_classes(series), ", ".join(["h long, g long, w double", *(f"d{i} double, l{i} double" for i in series)])), "series-distances")
        of = far.agg(*(F.coalesce(F.sum(F.col("w") * F.col(f"{name}{i}") ** 2), F.lit(0.0)).alias(f"{name}{i}") for i in series for name in "dl")).first()
        loose = lambda part, whole: part > LAST_PART**2 * whole
        kept = [i for i in series if not loose(of[f"l{i}"], of[f"d{i}"]) and not loose(last[:, i], squares[:, i]).any()]
        dropped = [i for i in range(k) if i not in kept]
        sums[dropped] = sums[:, dropped] = 0
        far = far.select("h", "g", *(F.col(f"d{i}") if i in kept else F.lit(0.0).alias(f"d{i}") for i in range(k))) if kept else None
        paired = paired | ~F.col("c").isin(*kept)
    else:
        paired = F.lit(True)
    size = int(trained.where(paired).agg(F.coalesce(F.sum(F.size("x")), F.lit(0))).first()[0]) * 8
    part = F.when(paired, F.pmod(F.xxhash64("c", "x"), F.lit(1 + size // PASS_BYTES))).otherwise(-1)
    for at in range(1 + size // PASS_BYTES if size or far is None else 0):
        block = trained.where(part == at).toArrow().combine_chunks()
        c, w = block["c"].to_numpy(), block["w"].to_numpy()
        x = np.vstack([_vectors(chunk) for chunk in block["x"].chunks if len(chunk)]) if len(block) else np.zeros((0, 0))
        points = [(x[c == i], w[c == i]) for i in range(k)]
        seen = trained.where(part <= at).withColumn("below", part < at).mapInArrow(_between_classes(points), "c int, other int, s double")
        for r in seen.groupBy("c", "other").agg(F.sum("s").alias("s")).collect():
            sums[r["c"], r["other"]] += r["s"]
        away = stage(units.mapInArrow(_to_classes(points), ", ".join(["h long, g long", *(f"d{i} double" for i in range(k))])), "distances")
        far = away if far is None else far.unionByName(away)
    between = sums / np.maximum(np.outer(n, n) - np.diag(n), 1)
    held = np.flatnonzero(n)

    def solve(q: np.ndarray) -> np.ndarray:
        p = np.zeros((len(q), k)) if len(held) else np.full((len(q), k), 1 / k)
        if len(held):
            p[:, held] = solvers.energy_shares(between[np.ix_(held, held)], q[:, held])
        return p

    total = far.groupBy("h", "g").agg(*(F.sum(f"d{i}").alias(f"d{i}") for i in range(k)))
    mean = F.array(*(F.sum(F.col("n") * F.col(f"d{i}")) / F.sum("n") / F.lit(float(max(n[i], 1))) for i in range(k)))
    return solved_means(asked.join(total, ["h", "g"]).groupBy(*keys).agg(mean.alias("q")), keys, solve, labels)
