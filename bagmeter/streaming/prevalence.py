"""Prevalence over event time, an extension: windows with a watermark, and totals kept per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_shares(events: DataFrame, ts: str, key: str, label: str, classes: tuple[str, ...], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``window``, ``key``, ``n`` and the share of each class in event-time windows.

    Works on a stream and on a table. Rows later than the watermark are dropped by a stream;
    rows without a time or with labels of other classes don't count.
    """
    kept = events.where(F.col(ts).isNotNull() & F.col(label).isin(*classes)).withWatermark(ts, late)
    shares = [F.avg((F.col(label) == c).cast("double")).alias(f"share_{c}") for c in classes]
    return kept.groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), *shares)


def running_counts(events: DataFrame, key: str, label: str, positive: str) -> DataFrame:
    """``key``, ``n``, ``n_positive``: totals per key so far, updated with every batch of a stream.

    A key's events of one batch arrive in Arrow batches; only the two totals are kept.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, hits = state.get if state.exists else (0, 0)
        for batch in batches:
            n += len(batch)
            hits += int((batch["label"] == positive).sum())
        state.update((n, hits))
        yield pd.DataFrame({"key": [k[0]], "n": [n], "n_positive": [hits]})

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(label).cast("string").alias("label"))
    out = rows.groupBy("key").applyInPandasWithState(
        update, "key string, n long, n_positive long", "n long, n_positive long", "update", GroupStateTimeout.NoTimeout
    )
    return out
