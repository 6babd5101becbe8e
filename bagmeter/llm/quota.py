"""Samples whose category shares match targets, drawn top-down over a category tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagmeter.functions.rng import uniform
from bagmeter.sources.scratch import stage

#: Rows per salt bucket when a leaf's pool is ranked.
RANK_BUCKET = 50_000
#: The leaves' supply is broadcast up to so many rows.
BROADCAST_LEAVES = 200_000
#: Primes above any pool size; steps through a pool of n ranks visit every rank once.
STRIDES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def allocate(quotas: DataFrame, supply: DataFrame, sample: list[str], pool: list[str], path: list[str]) -> DataFrame:
    """How many rows each leaf of the category tree gives to each sample.

    ``quotas``: ``sample`` and ``pool`` columns, ``path`` (from the top category to
    the leaf), ``quota``. ``supply``: ``pool`` columns, ``path``, ``available``; leaves
    without a quota may lend. Each level hands its amount to its children: first
    what a child asked for and can supply itself, then the rest to children with
    rows to spare, in order of spare rows and name. So unmet quota of a leaf goes
    to its siblings, and only what they can't supply to cousins.

    Returns ``sample``, ``pool``, ``path``, ``quota``, ``available``, ``allotted`` (what the walk leaves at the leaf),
    ``own`` (that part of it that meets the leaf's own quota, not what it lends to others) and ``shortfall``, the quota without ``own``.
    A null quota is 0, a sample whose pool has no rows gets nothing; rows of one
    sample and leaf add up. No input gives no rows.
    """
    leaf = path[-1]
    asked = quotas.groupBy(*sample, *pool, *path).agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("quota"))
    held = stage(supply.groupBy(*pool, *path).agg(F.sum("available").alias("available")), "supply")
    if held.count() <= BROADCAST_LEAVES:  # else AQE splits pools that many samples ask
        held = F.broadcast(held)
    samples = asked.select(*sample, *pool).distinct()
    lent = samples.join(held, pool).withColumn("quota", F.lit(0))
    nodes = (
        asked.withColumn("available", F.lit(0))
        .unionByName(lent)
        .groupBy(*sample, *pool, *path)
        .agg(F.sum("quota").alias("quota"), F.sum("available").alias("available"))
    )
    whole = Window.partitionBy(*sample, *pool)
    out = nodes.withColumn("_amount", F.least(F.sum("quota").over(whole), F.sum("available").over(whole)))
    for depth in range(len(path)):
        parent, child = [*sample, *pool, *path[:depth]], [*sample, *pool, *path[: depth + 1]]
        in_child = Window.partitionBy(*child)
        # one row of each child stands for it in its parent's sums
        out = (
            out.withColumn("_rep", (F.row_number().over(in_child.orderBy(leaf)) == 1).cast("int"))
            .withColumn("_q", F.sum("quota").over(in_child))
            .withColumn("_a", F.sum("available").over(in_child))
            .withColumn("_base", F.least("_q", "_a"))
            .withColumn("_spare", F.col("_a") - F.col("_base"))
        )
        in_parent = Window.partitionBy(*parent)
        named = F.struct((-F.col("_spare")).alias("s"), F.col(path[depth]).alias("c"), (1 - F.col("_rep")).alias("r"))
        upto = in_parent.orderBy(named).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = (
            out.withColumn("_named", named)
            .withColumn("_rest", F.col("_amount") - F.sum(F.col("_base") * F.col("_rep")).over(in_parent))
            .withColumn("_before", F.sum(F.col("_spare") * F.col("_rep")).over(upto) - F.col("_spare"))
            .withColumn("_take", F.greatest(F.lit(0), F.least(F.col("_spare"), F.col("_rest") - F.col("_before"))))
            .withColumn("_amount", F.col("_base") + F.col("_take"))
        )
    # what the walk hands to a leaf beyond its own quota is lent to others
    out = out.withColumn("own", F.col("_amount") - F.col("_take"))
    return out.select(
        *sample, *pool, *path, "quota", "available", "own", F.col("_amount").alias("allotted"), (F.col("quota") - F.col("own")).alias("shortfall")
    )


def ranked_pool(rows: DataFrame, leaf: list[str], unit: str, seed: int = 0) -> DataFrame:
    """``leaf``, ``unit``, ``rank``, ``size``: a random dense rank from 0 in each leaf, by md5 numbers.

    Leaves are cut into buckets by the random number that orders their units; buckets
    are ranked apart and shifted by the units in buckets before, so no task holds a
    whole leaf, even one with a third of all rows. Units of a leaf count once,
    null units not at all.
    """
    units = rows.select(*leaf, unit).where(F.col(unit).isNotNull()).distinct()
    buckets = 1 + units.count() // RANK_BUCKET
    placed = units.withColumn("_order", uniform(seed, "rank", F.col(unit))).withColumn("_bucket", F.floor(F.col("_order") * buckets))
    counts = placed.groupBy(*leaf, "_bucket").agg(F.count("*").alias("_n"))
    in_leaf = Window.partitionBy(*leaf)
    before = in_leaf.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        *leaf, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"), F.sum("_n").over(in_leaf).alias("size")
    )
    within = Window.partitionBy(*leaf, "_bucket").orderBy("_order", unit)
    return (
        placed.withColumn("_at", F.row_number().over(within) - 1)
        .join(shifts, [*leaf, "_bucket"])
        .select(*leaf, unit, (F.col("_at") + F.col("_shift")).alias("rank"), "size")
    )


def draw(allotted: DataFrame, ranked: DataFrame, sample: list[str], leaf: list[str], unit: str, seed: int = 0) -> DataFrame:
    """The drawn units: ``sample``, ``leaf``, ``unit``, without repeats within a sample.

    A sample starts at a random rank of each leaf and walks through the ranks with a
    random stride that is prime to the pool's size.
    """
    wanted = allotted.where("allotted > 0")
    sizes = ranked.groupBy(*leaf).agg(F.max("size").alias("size"))
    key = [F.col(c) for c in (*sample, *leaf)]
    strides = F.array(*(F.lit(s).cast("long") for s in STRIDES))
    stride = F.element_at(strides, (F.floor(uniform(seed, "stride", *key) * len(STRIDES)) + 1).cast("int"))
    places = (
        wanted.join(sizes, leaf)
        .withColumn("_start", F.floor(uniform(seed, "start", *key) * F.col("size")))
        .withColumn("_stride", F.pmod(stride, F.col("size")))
        .select(*sample, *leaf, "size", "_start", "_stride", F.explode(F.sequence(F.lit(0), (F.col("allotted") - 1).cast("int"))).alias("_i"))
        .select(*sample, *leaf, F.pmod(F.col("_start") + F.col("_i") * F.col("_stride"), F.col("size")).alias("rank"))
    )
    return places.join(ranked.select(*leaf, "rank", unit), [*leaf, "rank"]).select(*sample, *leaf, unit)


def whole_count(n: Column, share: Column, size: Column, least: Column) -> Column:
    """The count asked of a label: ``n``, else ``share`` x ``size`` to the nearest integer, and ``least`` at least."""
    asked = F.coalesce(n, F.floor(share * size + 0.5).cast("long"))
    return F.greatest(F.coalesce(asked, F.lit(0)), F.coalesce(least, F.lit(0)))
