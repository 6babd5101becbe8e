"""Exact percentiles of huge columns by bisection, and summaries of parts that add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagmeter.functions.ranks import order_bits
from bagmeter.sources.scratch import drop, stage

#: A pass cuts an interval into at most 2 ** WAYS parts.
WAYS = 7
#: Intervals are broadcast up to so many rows (about 100 bytes each), else joined by shuffle.
BROADCAST_INTERVALS = 200_000
#: Parts into which a group is cut for the shuffled join.
SALTS = 64


def _counted(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Finite values with their number of rows and their place in the order, spread over tasks by group *and* value."""
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    counts = df.where(finite).select(*groups, (v + F.lit(0.0)).alias("v")).groupBy(*groups, "v").agg(F.count("*").alias("n"))
    return counts.withColumn("at", order_bits(F.col("v")))


def percentiles(df: DataFrame, groups: list[str], value: str, probs: list[float], ways: int = WAYS) -> DataFrame:
    """``groups``, ``prob``, ``n``, ``value``: percentiles with linear interpolation, without error.

    Each percentile is one or two ranks. For each group and rank an interval is kept, of the whole numbers that stand for
    doubles in their order; a pass counts the rows in up to 2 ** ``ways`` equal parts of it, keeps the part
    with the rank, and shrinks it to the least and greatest number that occur there, so
    a rank is resolved once both are equal. An interval loses ``ways - 1`` of its 64 bits at least, so there are 64 / (ways - 1) passes
    at most (11), whatever the values. Counts of parts of the data (partitions,
    days) are added before a part is chosen, nothing is sorted and no group is gathered. Values outside the open intervals are left
    behind after each pass.

    Null, NaN and infinite values don't count; groups without other values are left
    out; null group keys are groups. No input gives no rows.
    """
    counted = stage(_counted(df, groups, value), "bisect-values")
    ends = counted.groupBy(*groups).agg(
        F.sum("n").alias("n_all"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.min("v").alias("v")
    )
    at = F.col("prob") * (F.col("n_all") - 1)
    wanted = (
        ends.withColumn("prob", F.explode(F.array(*(F.lit(float(p)) for p in probs))))
        .withColumn("ranks", F.array_distinct(F.array(F.floor(at).cast("long"), F.ceil(at).cast("long"))))
        .withColumn("rank", F.explode("ranks"))
    )
    wanted = stage(wanted, "bisect-wanted")
    intervals = stage(
        wanted.select(*groups, "n_all", "rank", "lo", "hi", "v").distinct().withColumn("below", F.lit(0).cast("long")), "bisect-intervals"
    )
    ranks, old = None, [counted, intervals]
    while True:
        done = intervals.where("lo = hi")
        ranks = done if ranks is None else ranks.unionByName(done)
        open_ = intervals.where("lo < hi")
        n_open = open_.count()
        if not n_open:
            break
        intervals = stage(_narrow(counted, open_, groups, n_open, ways), "bisect-intervals")
        counted = stage(_within(counted, intervals.where("lo < hi"), groups, n_open), "bisect-values")
        drop(old[0])
        old = [counted, intervals]
    key = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]
    found = ranks.select(*(F.col(g).alias(f"_{g}") for g in groups), F.col("rank").alias("_rank"), F.col("v").alias("_v"))
    joined = wanted.drop("v").join(found, [*key, F.col("rank") == F.col("_rank")])
    frac = F.max(F.col("prob") * (F.col("n_all") - 1) - F.floor(F.col("prob") * (F.col("n_all") - 1)))
    low, high = F.min("_v"), F.max("_v")
    # the difference of far values is infinite
    between = F.when(high - low < float("inf"), low + (high - low) * frac).otherwise(low * (1 - frac) + high * frac)
    return joined.groupBy(*groups, "prob").agg(F.max("n_all").alias("n"), between.alias("value"))


def _matched(counted: DataFrame, intervals: DataFrame, groups: list[str], n_open: int, how: str) -> DataFrame:
    """Values joined with the intervals they lie in."""
    on = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]
    inside = (F.col("at") >= F.col("lo")) & (F.col("at") <= F.col("hi"))
    renamed = intervals.select(*(F.col(g).alias(f"_{g}") for g in groups), "n_all", "rank", "lo", "hi", "below")
    if n_open <= BROADCAST_INTERVALS:
        return counted.join(F.broadcast(renamed), [*on, inside], how)
    salted = counted.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    copies = renamed.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, F.col("_salt") == F.col("_copy"), inside], how).drop("_salt", "_copy")


def _within(counted: DataFrame, intervals: DataFrame, groups: list[str], n_open: int) -> DataFrame:
    """The values in any of the intervals."""
    return _matched(counted, intervals, groups, n_open, "left_semi").select(*groups, "v", "n", "at")


def _narrow(counted: DataFrame, intervals: DataFrame, groups: list[str], n_open: int, ways: int) -> DataFrame:
    """One pass: the part of each open interval that holds its rank."""
    pairs = _matched(counted, intervals, groups, n_open, "inner")
    # parts are all numbers with the same leading bits; halves, as the length of an interval may need 65 bits
    bits = F.ceil(F.log2(F.shiftright("hi", 1) - F.shiftright("lo", 1) + F.lit(2.0))).cast("int") + 1
    part = F.call_function("shiftright", F.col("at"), F.greatest(F.lit(0), bits - ways))
    id_ = [*groups, "n_all", "rank", "below"]
    counts = pairs.groupBy(*id_, part.alias("part")).agg(
        F.sum("n").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.min("v").alias("v")
    )
    upto = Window.partitionBy(*groups, "rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("below") + F.coalesce(F.sum("n").over(upto), F.lit(0))
    return (
        counts.withColumn("_before", before)
        .where((F.col("_before") <= F.col("rank")) & (F.col("rank") < F.col("_before") + F.col("n")))
        .select(*groups, "n_all", "rank", "lo", "hi", "v", F.col("_before").alias("below"))
    )


def summarise(df: DataFrame, groups: list[str], part: str, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """``groups``, ``part``, ``bin``, ``n``: rows per equal bin of [lo, hi]; summaries of any parts add up.

    At most ``bins`` rows per group and part. Null, NaN and values outside don't count.
    """
    v = F.col(value)
    cell = F.least(F.lit(bins - 1), F.floor((v - lo) / (hi - lo) * bins)).cast("int")
    return df.where((v >= lo) & (v <= hi) & ~F.isnan(v)).groupBy(*groups, part, cell.alias("bin")).agg(F.count("*").alias("n"))


def merged_percentiles(summaries: DataFrame, groups: list[str], probs: list[float], lo: float, hi: float, bins: int) -> DataFrame:
    """``groups``, ``prob``, ``n``, ``value``, ``error``: percentiles of summaries put together.

    ``value`` is the middle of the bin with rank floor(prob x (n - 1)), so it is at most ``error``,
    half a bin, from the value of that rank.
    """
    total = summaries.groupBy(*groups, "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*groups)
    upto = group.orderBy("bin")
    width = (hi - lo) / bins
    return (
        total.withColumn("upto", F.sum("n").over(upto))
        .withColumn("all", F.sum("n").over(group))
        .withColumn("prob", F.explode(F.array(*(F.lit(float(p)) for p in probs))))
        .withColumn("rank", F.floor(F.col("prob") * (F.col("all") - 1)))
        .where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        .select(
            *groups, "prob", F.col("all").alias("n"), (F.lit(lo) + (F.col("bin") + 0.5) * width).alias("value"), F.lit(width / 2).alias("error")
        )
    )


def unit_interval(c: Column) -> Column:
    """Whether a value is finite and from 0 to 1."""
    return (c >= 0) & (c <= 1) & ~F.isnan(c)
