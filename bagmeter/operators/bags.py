"""Bag protocols: which class counts a bag has, and which instances it draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagmeter.config import CLINICAL, LABELS, BagConfig
from bagmeter.functions.ranks import ranked
from bagmeter.functions.rng import uniform
from bagmeter.sources.scratch import stage

BAG = ["bag_size", "bag_index"]


def _bag_key() -> list[Column]:
    return [F.col("bag_size"), F.col("bag_index")]


def largest_remainder(df: DataFrame, keys: list[str], label: str, share: str, size: str) -> DataFrame:
    """``df`` with ``n``: whole counts that add up to ``size``; ties of the remainders go to the later label."""
    raw = F.col(share) * F.col(size)
    group = Window.partitionBy(*keys)
    spare = F.col(size) - F.sum(F.floor(raw)).over(group)
    place = F.row_number().over(group.orderBy((raw - F.floor(raw)).desc(), F.col(label).desc()))
    return df.withColumns({"_spare": spare, "_place": place}).withColumn(
        "n", (F.floor(raw) + (F.col("_place") <= F.col("_spare")).cast("int")).cast("int")
    ).drop("_spare", "_place")


def zone_picks(bags: DataFrame, config: BagConfig = CLINICAL) -> DataFrame:
    """``bag_size``, ``bag_index``, ``label``, ``zone``, ``p_raw``: a band for each label by its weight, and a share in it."""
    bands = []
    for label in sorted(config.ranges):
        weights = config.weights.get(label, [1.0] * len(config.ranges[label]))
        upto = 0.0
        for zone, ((lo, hi), w) in enumerate(zip(config.ranges[label], weights)):
            last = zone == len(weights) - 1
            bands.append((label, zone, lo, hi, upto, 1.0 if last else upto + w / sum(weights)))
            upto += w / sum(weights)
    rows = F.array(
        *(
            F.struct(*(F.lit(v).alias(n) for n, v in zip(("label", "zone", "lo", "hi", "from_w", "to_w"), band)))
            for band in bands
        )
    )
    pick = uniform(config.seed, "z", F.col("b.label"), *_bag_key())
    place = uniform(config.seed, "p", F.col("b.label"), *_bag_key())
    return (
        bags.select(*BAG, F.explode(rows).alias("b"))
        .where((F.col("b.from_w") <= pick) & (pick < F.col("b.to_w")))
        .select(*BAG, "b.label", "b.zone", (F.col("b.lo") + (F.col("b.hi") - F.col("b.lo")) * place).alias("p_raw"))
    )


def capp_truth(bags: DataFrame, config: BagConfig = CLINICAL, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``bag_size``, ``bag_index``, ``label``, ``zone``, ``n``, ``prevalence`` of bags within risk bands.

    Shares that exceed one together are scaled down; the base label gets the rest. Where the base
    isn't among ``labels`` the rest is spread over labels without bands, or over all of them.
    Prevalence is the realized count over the bag size.
    """
    group = Window.partitionBy(*BAG)
    picked = zone_picks(bags, config).withColumn("_tot", F.sum("p_raw").over(group))
    scaled = picked.withColumn("p", F.when(F.col("_tot") > 1, F.col("p_raw") / F.col("_tot")).otherwise(F.col("p_raw")))
    rest = scaled.groupBy(*BAG).agg(F.greatest(F.lit(0.0), 1 - F.sum("p")).alias("_rest"))
    if config.base_label in labels:
        heirs = [config.base_label]
    else:
        heirs = [x for x in labels if x not in config.ranges] or list(labels)
    share = rest.select(*BAG, F.explode(F.array(*map(F.lit, heirs))).alias("label"), (F.col("_rest") / len(heirs)).alias("p"))
    every = (
        scaled.select(*BAG, "label", "zone", "p")
        .unionByName(share.withColumn("zone", F.lit(None).cast("int")))
        .groupBy(*BAG, "label")
        .agg(F.max("zone").alias("zone"), F.sum("p").alias("p"))
    )
    counted = largest_remainder(every, BAG, "label", "p", "bag_size")
    return counted.select(*BAG, "label", "zone", "n", (F.col("n") / F.col("bag_size")).alias("prevalence"))


def app_truth(bags: DataFrame, seed: int = 7, positive: int = 1) -> DataFrame:
    """``bag_size``, ``bag_index``, ``label`` (0 or 1), ``n``, ``prevalence``: a uniform share of positives, cut to a whole count."""
    n_pos = F.floor(uniform(seed, "app", *_bag_key()) * F.col("bag_size")).cast("int")
    sides = F.array(
        F.struct(F.lit(positive).alias("label"), F.col("_pos").alias("n")),
        F.struct(F.lit(1 - positive).alias("label"), (F.col("bag_size") - F.col("_pos")).alias("n")),
    )
    return (
        bags.select(*BAG, n_pos.alias("_pos"))
        .select(*BAG, F.explode(sides).alias("s"))
        .select(*BAG, "s.label", "s.n", (F.col("s.n") / F.col("bag_size")).alias("prevalence"))
    )


#: A class with so few instances is sent to all tasks: many draws share each of them.
SMALL_POOL = 10_000


def ranked_pool(pool: DataFrame, label: str, unit: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``label``, ``unit``, ``carry``, ``rank``, ``pool_n``: dense ranks from 0 in the order of ``unit`` within each class."""
    return ranked(pool.select(label, unit, *carry), [label], F.col(unit), [], "rank", "pool_n")


def members(truth: DataFrame, pool: DataFrame, unit: str, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """``bag_size``, ``bag_index``, ``label``, ``pos``, ``unit``, ``carry``: draws with replacement, as many per class as the truth says.

    ``pool``: ``label``, ``unit`` and ``carry``, columns that come with the drawn instance, one row per instance. A class that is asked for and
    has no pool raises an error. Draws of large classes are joined by shuffle on the rank, which is spread evenly; those of small ones by broadcast.
    """
    ranks = stage(ranked_pool(pool, "label", unit, carry), "pool")  # read for the sizes and for the draws
    sizes = ranks.groupBy("label").agg(F.max("pool_n").alias("pool_n"))
    wanted = truth.where("n > 0")
    lost = [r["label"] for r in wanted.select("label").distinct().join(sizes, "label", "left_anti").limit(100).collect()]
    if lost:
        raise ValueError(f"no instances to draw for {sorted(map(str, lost))}")
    draw = uniform(seed, "m", *_bag_key(), F.col("label"), F.col("pos"))
    places = (
        wanted.join(F.broadcast(sizes), "label")  # one row per class
        .withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .withColumn("rank", F.floor(draw * F.col("pool_n")))
    )
    few, columns = F.col("pool_n") <= SMALL_POOL, ["label", "rank", unit, *carry]
    small = places.where(few).select(*BAG, "label", "pos", "rank").join(F.broadcast(ranks.where(few).select(*columns)), ["label", "rank"])
    large = places.where(~few).select(*BAG, "label", "pos", "rank").join(ranks.where(~few).select(*columns), ["label", "rank"])
    return small.unionByName(large).select(*BAG, "label", "pos", unit, *carry)
