"""Summaries, ranks and tests over result tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagmeter.functions.ranks import percentiles


def summary(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean and sample deviation of each value; the deviation of one row is null."""
    return df.groupBy(*keys).agg(
        *(e for v in values for e in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std")))
    )


def rank_within(df: DataFrame, groups: list[str], value: str, tie: str, name: str) -> DataFrame:
    """Place from 1 by ascending value, then by ``tie``; groups are bounded by the number of estimators."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(F.col(value).asc(), F.col(tie).asc())))


def rank_shift(df: DataFrame, groups: list[str], item: str, protocol: str, value: str, first: str, second: str) -> DataFrame:
    """``groups``, ``item``, ``first_rank``, ``second_rank``, ``shift`` of items ranked under both protocols."""
    side = lambda p, name: rank_within(df.where(F.col(protocol) == p), groups, value, item, name).select(*groups, item, name)
    both = side(first, "first_rank").join(side(second, "second_rank"), [*groups, item])
    return both.withColumn("shift", F.col("first_rank") - F.col("second_rank"))


def spearman(df: DataFrame, groups: list[str], a: str, b: str) -> DataFrame:
    """``groups``, ``rho``: correlation of two rank columns, which are ranked anew among the rows they share."""
    again = lambda c: F.rank().over(Window.partitionBy(*groups).orderBy(c))
    return df.select(*groups, again(a).alias("_a"), again(b).alias("_b")).groupBy(*groups).agg(F.corr("_a", "_b").alias("rho"))


def mid_rank(value: Column, groups: list[str], others: str) -> Column:
    """Average rank of equal values."""
    group = Window.partitionBy(*groups).orderBy(value)
    same = Window.partitionBy(*groups, others)
    return F.rank().over(group) + (F.count("*").over(same) - 1) / 2.0


def wilcoxon(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """``groups``, ``n``, ``w_plus``, ``w_minus``, ``statistic`` of the signed-rank test; zeros are dropped, ties get middle ranks."""
    signed = df.where(F.col(value) != 0).withColumn("_abs", F.abs(value))
    ranked = signed.withColumn("_r", mid_rank(F.col("_abs"), groups, "_abs"))
    plus, minus = F.sum(F.when(F.col(value) > 0, F.col("_r")).otherwise(0.0)), F.sum(F.when(F.col(value) < 0, F.col("_r")).otherwise(0.0))
    return ranked.groupBy(*groups).agg(
        F.count("*").alias("n"), plus.alias("w_plus"), minus.alias("w_minus"), F.least(plus, minus).alias("statistic")
    )


def box_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles by linear interpolation, and the last values within 1.5 interquartile ranges of them."""
    each = percentiles(df, keys, F.col(value), [0.25, 0.5, 0.75])
    quartiles = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("prob", "value")))["value"].alias("q"))  # three values
    q1, q3 = F.element_at("q", 1), F.element_at("q", 3)
    at = df.join(quartiles, keys)
    reach = 1.5 * (q3 - q1)
    inside = F.when((F.col(value) >= q1 - reach) & (F.col(value) <= q3 + reach), F.col(value))
    return at.groupBy(*keys).agg(
        F.min(q1).alias("q1"), F.min(F.element_at("q", 2)).alias("median"), F.min(q3).alias("q3"), F.min(inside).alias("low"), F.max(inside).alias("high")
    )


def histogram(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """``keys``, ``bin``, ``n``: equal bins of the range from the least to the greatest value, the last one closed."""
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    place = F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins), F.lit(0))
    return df.join(span, keys).groupBy(*keys, F.least(F.lit(bins - 1), place).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def right_closed_bin(value: Column, bins: int) -> Column:
    """Bin of a share with right-closed bins; 0 belongs to the first."""
    edges = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    return F.size(F.filter(edges, lambda e: e < value))


def wilcoxon_p(n: int, w_plus: float) -> float:
    """Two-sided normal approximation for the sum of positive ranks of ``n`` differences; 1 without any."""
    if not n:
        return 1.0
    z = (w_plus - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return math.erfc(abs(z) / math.sqrt(2))


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p-value of a rank correlation of ``n`` items by Student's t, integrated numerically."""
    if n < 3 or abs(rho) >= 1:
        return 1.0 if n < 3 else 0.0
    df = n - 2
    t = abs(rho) * math.sqrt(df / (1 - rho * rho))
    # P(|T| > t) over angles: the density of T at sqrt(df) tan(a) is proportional to cos(a)^(df - 1)
    lo, half, steps = math.atan(t / math.sqrt(df)), math.pi / 2, 20_000
    area = lambda a, b: sum(math.cos(a + (i + 0.5) * (b - a) / steps) ** (df - 1) for i in range(steps)) * (b - a) / steps
    return area(lo, half) / area(0.0, half)
