"""Ranks and running sums of groups that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagmeter.sources.scratch import stage

#: Layout of a double (mantissa bits, exponent of the least normal number, exponent offset).
_MANTISSA, _LEAST_EXPONENT, _OFFSET = 52, -1022, 1023


def order_bits(value: Column) -> Column:
    """A whole number for each double, in the same order and different for different doubles; 0.0 and -0.0 are one.

    It is the number that the bits of the absolute value make, with the sign of the value, so infinite values lie
    beyond all others and equal steps are equal relative steps. Null and NaN give null.
    """
    x = F.abs(value)
    guess = F.greatest(F.floor(F.log2(F.when((x > 0) & (x < float("inf")), x).otherwise(F.lit(1.0)))), F.lit(_LEAST_EXPONENT))
    # the logarithm may be off by one at a power of two
    guess = guess - (x < F.pow(F.lit(2.0), guess)).cast("long") + (x / 2 >= F.pow(F.lit(2.0), guess)).cast("long")
    exponent = F.greatest(guess, F.lit(_LEAST_EXPONENT))
    # in steps, as 2 ** 1074 is no double
    mantissa = (x / F.pow(F.lit(2.0), exponent) * F.lit(float(2**_MANTISSA))).cast("long")
    bits = (exponent + (_OFFSET - 1)) * F.lit(2**_MANTISSA) + mantissa
    bits = F.when(x == float("inf"), F.lit((2 * _OFFSET + 1) << _MANTISSA)).when(x == 0, F.lit(0)).otherwise(bits)
    return F.when(~F.isnan(value), F.when(value < 0, -bits).otherwise(bits)).cast("long")


def ranked(
    df: DataFrame, keys: list[str], value: Column, ties: list[str], rank: str = "rank", size: str | None = None, buckets: int | None = None
) -> DataFrame:
    """``df`` with the position (from 0) of each row of its group in the order of ``value`` and ``ties``.

    Rows are range partitioned on keys, value and ties by Spark's sampled quantiles, so a group that holds most rows, or a burst of
    near values, is spread over partitions; each is ranked apart and shifted by the rows of the group's earlier ones.
    The partitioned rows are written, so that all later steps see the same borders. Null keys are groups; columns named _rk_... are reserved.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.withColumn("_rk_v", value).repartitionByRange(buckets, *keys, "_rk_v", *ties)
    placed = stage(ordered.withColumn("_rk_b", F.spark_partition_id()), "ranked")
    counts = placed.groupBy(*keys, "_rk_b").agg(F.count("*").alias("_rk_n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_rk_b").rowsBetween(Window.unboundedPreceding, -1)
    named = [f"_rk_k{i}" for i in range(len(keys))]
    shifts = counts.select(
        *(F.col(k).alias(n) for k, n in zip(keys, named)), F.col("_rk_b").alias("_rk_at"),
        F.coalesce(F.sum("_rk_n").over(before), F.lit(0)).alias("_rk_s"), F.sum("_rk_n").over(whole).alias("_rk_size"),
    )
    within = F.row_number().over(Window.partitionBy(*keys, "_rk_b").orderBy("_rk_v", *ties)) - 1
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, named)]
    joined = placed.withColumn("_rk_r", within).join(shifts, [*on, F.col("_rk_b") == F.col("_rk_at")])
    out = joined.withColumn(rank, F.col("_rk_r") + F.col("_rk_s"))
    out = out.withColumn(size, F.col("_rk_size")) if size else out
    return out.drop("_rk_v", "_rk_b", "_rk_r", "_rk_at", "_rk_s", "_rk_size", *named)


def percentiles(df: DataFrame, keys: list[str], value: Column, probs: list[float]) -> DataFrame:
    """``keys``, ``prob``, ``value``: percentiles with linear interpolation, exact, however many values a group has.

    Equal values are counted, ranges of distinct values are added up apart and shifted, so no task holds the values of a group. Null and
    NaN values don't count; groups without others are left out; null keys are groups.
    """
    v = value.cast("double")
    counted = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_pc_v")).groupBy(*keys, "_pc_v").agg(F.count("*").alias("_pc_n"))
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(counted.repartitionByRange(buckets, *keys, "_pc_v").withColumn("_pc_b", F.spark_partition_id()), "percentiles")
    whole = Window.partitionBy(*keys)
    named = [f"_pc_k{i}" for i in range(len(keys))]
    sums = placed.groupBy(*keys, "_pc_b").agg(F.sum("_pc_n").alias("_pc_w"))
    before = whole.orderBy("_pc_b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(
        *(F.col(k).alias(n) for k, n in zip(keys, named)), F.col("_pc_b").alias("_pc_at"),
        F.coalesce(F.sum("_pc_w").over(before), F.lit(0)).alias("_pc_s"), F.sum("_pc_w").over(whole).alias("_pc_all"),
    )
    within = Window.partitionBy(*keys, "_pc_b").orderBy("_pc_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, named)]
    upto = placed.withColumn("_pc_u", F.sum("_pc_n").over(within)).join(shifts, [*on, F.col("_pc_b") == F.col("_pc_at")])
    upto = upto.withColumn("_pc_u", F.col("_pc_u") + F.col("_pc_s")).withColumn("prob", F.explode(F.array(*(F.lit(float(p)) for p in probs))))
    at = F.col("prob") * (F.col("_pc_all") - 1)
    holds = lambda r: (r < F.col("_pc_u")) & (r >= F.col("_pc_u") - F.col("_pc_n"))
    low, high = F.max(F.when(holds(F.floor(at)), F.col("_pc_v"))), F.max(F.when(holds(F.ceil(at)), F.col("_pc_v")))
    near = upto.where(holds(F.floor(at)) | holds(F.ceil(at)))
    return near.groupBy(*keys, "prob").agg((low + (high - low) * F.max(at - F.floor(at))).alias("value"))


def running_sum(df: DataFrame, keys: list[str], at: str, value: str, name: str, chunk: int = 10_000) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group up to position ``at`` (whole, from 0, unique in the group)."""
    placed = df.withColumn("_rk_c", F.floor(F.col(at) / chunk))
    sums = placed.groupBy(*keys, "_rk_c").agg(F.sum(value).alias("_rk_w"))
    named = [f"_rk_k{i}" for i in range(len(keys))]
    before = Window.partitionBy(*keys).orderBy("_rk_c").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(*(F.col(k).alias(n) for k, n in zip(keys, named)), F.col("_rk_c").alias("_rk_at"), F.sum("_rk_w").over(before).alias("_rk_s"))
    upto = Window.partitionBy(*keys, "_rk_c").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, named)]
    joined = placed.withColumn(name, F.sum(value).over(upto)).join(shifts, [*on, F.col("_rk_c") == F.col("_rk_at")])
    return joined.withColumn(name, F.col(name) + F.coalesce("_rk_s", F.lit(0.0))).drop("_rk_c", "_rk_at", "_rk_s", *named)
