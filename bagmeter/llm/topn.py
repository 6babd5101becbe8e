"""The N best rows of every group, with a fixed order of ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagmeter.functions.ranks import order_bits
from bagmeter.sources.scratch import stage

#: Lowest bits of a score's order that a histogram leaves out: bins are sixteenths of a power of two.
BIN_BITS = 48
#: Slots that tell apart the rows of one bin.
SLOTS = 64
#: Limits are broadcast for up to so many groups (about 100 bytes each), else joined by shuffle.
BROADCAST_GROUPS = 200_000
#: Rows of one group that are ranked in one task.
RANK_ROWS = 10_000


def _bin(score: Column) -> Column:
    """A bin number that never falls as the score rises; bins are as fine near 0 as they are far off."""
    return F.shiftright(order_bits(score), BIN_BITS).cast("int")


def limits(rows: DataFrame, groups: list[str], score: str, row_hash: Column, n: int) -> DataFrame:
    """``groups``, ``bin``, ``kept``: for each group the lowest bin by which at least ``n`` different rows have come, and the rows up to it.

    A histogram counts for each bin the rows, and how many of :data:`SLOTS` hash values they have. Equal rows have
    one, so that is a number of different rows that is never too high, and counts of parts of the data add up
    before the shuffle. A group with fewer rows has its last bin.
    """
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(row_hash, F.lit(SLOTS)).cast("int"))
    histogram = rows.groupBy(*groups, _bin(F.col(score)).alias("bin")).agg(F.bit_count(F.bit_or(mark)).alias("_n"), F.count("*").alias("_rows"))
    upto = Window.partitionBy(*groups).orderBy("bin")
    running = histogram.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_kept", F.sum("_rows").over(upto))
    reached = F.min(F.when(F.col("_upto") >= n, F.struct("bin", "_kept")))
    chosen = running.groupBy(*groups).agg(F.coalesce(reached, F.max(F.struct("bin", "_kept"))).alias("_c"))
    return chosen.select(*groups, F.col("_c.bin").alias("bin"), F.col("_c._kept").alias("kept"))


def top_n(df: DataFrame, groups: list[str], score: str, ties: list[str], n: int) -> DataFrame:
    """The rows of ``df`` with the ``n`` lowest scores of each group, and their ``place`` from 1.

    Histograms give for each group a bin of scores by which at least ``n`` rows have come (:func:`limits`); rows
    in later bins can't be among the first n and are dropped before anything else. What is left is made distinct and ranked exactly
    by score, then ``ties``; where many rows of a group come up to that bin, salted parts of the group are ranked first and give n rows each.

    Null and NaN scores are left out, infinite ones are ordinary values; repeated rows count
    once; null group keys are groups and null ties come first. Groups with fewer rows
    come out whole. Names that begin with _rank are reserved; a column of ``df`` called place is
    replaced. No input gives no rows.
    """
    s = F.col(score)
    rows = df.where(s.isNotNull() & ~F.isnan(s)).withColumn(score, s + F.lit(0.0))
    row_hash = F.xxhash64(*(F.col(c) for c in df.columns))
    named = [f"_rank_{i}" for i in range(len(groups))]
    most = limits(rows, groups, score, row_hash, n).select(
        *(F.col(g).alias(k) for g, k in zip(groups, named)), F.col("bin").alias("_rank_bin"), F.col("kept").alias("_rank_kept")
    )
    most = stage(most, "topn-limits")
    if most.count() <= BROADCAST_GROUPS:  # then rows are dropped where they are read
        most = F.broadcast(most)
    on = [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(groups, named)]
    kept = rows.join(most, on).where(_bin(s) <= F.col("_rank_bin"))
    salt = F.pmod(row_hash, F.ceil(F.col("_rank_kept") / RANK_ROWS))
    order = [F.col(score).asc(), *(F.col(t).asc_nulls_first() for t in ties)]
    first = (
        kept.withColumn("_rank_salt", salt).drop(*named, "_rank_bin", "_rank_kept").dropDuplicates()
        .withColumn("_rank_at", F.row_number().over(Window.partitionBy(*groups, "_rank_salt").orderBy(*order)))
        .where(F.col("_rank_at") <= n)
    )
    return (
        first.withColumn("_rank_place", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
        .where(F.col("_rank_place") <= n)
        .select(*(c for c in df.columns if c != "place"), F.col("_rank_place").alias("place"))
    )
