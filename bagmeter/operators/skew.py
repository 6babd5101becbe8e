"""Per-key results when a few keys hold most rows.

Rows are range partitioned on the key *and* a secondary order, so that Spark's
sampled quantiles split a heavy key over as many partitions as it deserves. Each
partition then counts its runs in one ordered pass and leaves small partial
states; states that meet at a partition boundary are stitched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bagmeter.sources.scratch import stage

_STATE = "kind string, pid int, at int, {keys}, rec string, unit long, n_rows long, n_units long, n_records long"


def _changes(columns: list[np.ndarray], before: list) -> np.ndarray:
    """Whether each row differs from the row before it in any column; ``before`` precedes row 0."""
    out = np.zeros(len(columns[0]), dtype=bool)
    for c, b in zip(columns, before):
        out[0] |= c[0] != b
        out[1:] |= c[1:] != c[:-1]
    return out


def _run_states(names: list[str]):
    """The ordered pass over one range partition; rows come sorted by keys, rec, unit."""
    start = object()  # equal to no value

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        before = [start] * (len(names) + 2)
        first = last = None
        seen_key: tuple = ()
        seen: set = set()
        for batch in batches:
            if not len(batch):
                continue
            keys = [batch[n].to_numpy(dtype=object) for n in names]
            rec, unit = batch["rec"].to_numpy(dtype=object), batch["unit"].to_numpy()
            new_key = _changes(keys, before[: len(names)])
            new_rec = new_key | _changes([rec], [before[-2]])
            new_unit = new_rec | _changes([unit], [before[-1]])
            has_rec = np.array([r is not None for r in rec])
            starts = np.flatnonzero(new_key | (np.arange(len(batch)) == 0))
            out = pd.DataFrame({n: k[starts] for n, k in zip(names, keys)})
            out["n_rows"] = np.diff(np.append(starts, len(batch)))
            out["n_units"] = np.add.reduceat(new_unit.astype(np.int64), starts)
            out["n_records"] = np.add.reduceat((new_rec & has_rec).astype(np.int64), starts)
            yield _shaped(out.assign(kind="part"), pid, names)
            members = batch[[*names, "member"]].drop_duplicates()
            fresh = []
            for row in members.itertuples(index=False, name=None):
                if row[:-1] != seen_key:
                    seen_key, seen = row[:-1], set()
                if row[-1] is not None and row[-1] not in seen:
                    seen.add(row[-1])
                    fresh.append(row)
            if fresh:
                yield _shaped(pd.DataFrame(fresh, columns=[*names, "rec"]).assign(kind="member"), pid, names)
            before = [*(k[-1] for k in keys), rec[-1], unit[-1]]
            last = before
            first = first or [*(k[0] for k in keys), rec[0], unit[0]]
        if first:
            edges = pd.DataFrame([first, last], columns=[*names, "rec", "unit"])
            yield _shaped(edges.assign(kind="edge", at=[0, 1]), pid, names)

    return states


def _shaped(pdf: pd.DataFrame, pid: int, names: list[str]) -> pd.DataFrame:
    pdf = pdf.assign(pid=pid)
    for c in ("at", "unit", "n_rows", "n_units", "n_records"):
        pdf[c] = pdf[c].fillna(0).astype("int64") if c in pdf else 0
    for c in ("rec",):
        pdf[c] = pdf[c] if c in pdf else None
    return pdf[["kind", "pid", "at", *names, "rec", "unit", "n_rows", "n_units", "n_records"]]


def balanced_key_stats(
    df: DataFrame, keys: list[str], unit: str, record: str, member: str, partitions: int | None = None
) -> DataFrame:
    """Per key: rows, distinct units, distinct records, distinct members.

    ``keys``, ``record`` and ``member`` are string columns, ``unit`` is an integer
    column. Only these columns are read, so extra columns with any name do no harm.
    A null key is a key of its own; a null record or member isn't counted; rows
    with a null unit are left out. Equal units of a key must have equal records
    (repeated rows do). An empty input gives no rows.

    No partition holds more than its quantile share, however heavy a key is: the
    range bounds come from a sample of the composite key ``keys, record, unit``.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"k{i}" for i in range(len(keys))]
    narrow = df.where(F.col(unit).isNotNull()).select(
        *(F.col(k).cast("string").alias(n) for k, n in zip(keys, names)),
        F.col(record).cast("string").alias("rec"),
        F.col(unit).cast("long").alias("unit"),
        F.col(member).cast("string").alias("member"),
    )
    order = [*names, "rec", "unit"]
    ordered = narrow.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    schema = _STATE.format(keys=", ".join(f"{n} string" for n in names))
    states = stage(ordered.mapInPandas(_run_states(names), schema), "skew-states")

    # one row per partition: far fewer than the rows, whatever the input
    nearest = Window.orderBy("pid", "at")
    same = F.lit(True)
    for n in [*names, "rec"]:
        same = same & F.col(n).eqNullSafe(F.lag(n).over(nearest))
    same_unit = same & (F.col("unit") == F.lag("unit").over(nearest))
    stitched = (
        states.where("kind = 'edge'")
        .withColumns({"meets": same, "meets_unit": same_unit})
        .where("at = 0 and meets")
        .select(
            *names,
            F.lit(0).alias("n_rows"),
            (-F.col("meets_unit").cast("int")).alias("n_units"),
            (-F.col("rec").isNotNull().cast("int")).alias("n_records"),
            F.lit(0).alias("n_members"),
        )
    )
    parts = states.where("kind = 'part'").select(*names, "n_rows", "n_units", "n_records", F.lit(0).alias("n_members"))
    members = (
        states.where("kind = 'member'")
        .select(*names, "rec")
        .distinct()
        .select(*names, *(F.lit(0).alias(c) for c in ("n_rows", "n_units", "n_records")), F.lit(1).alias("n_members"))
    )
    return (
        parts.unionByName(stitched)
        .unionByName(members)
        .groupBy(*names)
        .agg(*(F.sum(c).cast("long").alias(c) for c in ("n_rows", "n_units", "n_records", "n_members")))
        .select(*(F.col(n).alias(k) for n, k in zip(names, keys)), "n_rows", "n_units", "n_records", "n_members")
    )


def dominant_keys(stats: DataFrame, group: str, key: str, share: float) -> DataFrame:
    """Keys that hold more than ``share`` of the units of their group; a null key counts only in the total."""
    total = stats.groupBy(F.col(group).alias("_g")).agg(F.sum("n_units").alias("_total"))
    return (
        stats.where(F.col(key).isNotNull())
        .join(total, F.col(group).eqNullSafe(F.col("_g")))
        .where(F.col("n_units") > F.lit(share) * F.col("_total"))
        .select(group, key, "n_units", (F.col("n_units") / F.col("_total")).alias("share"))
    )
