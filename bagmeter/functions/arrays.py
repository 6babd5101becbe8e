"""Row-wise operations on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: added to a spread before division.
EPSILON = 1e-8


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _with(value: Column, f) -> Column:
    """``f(value)`` with the value computed once per row, not once per element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def zscore(a: Column) -> Column:
    """(x - mean) / (population deviation + 1e-8)."""
    centred = _with(mean(a), lambda m: F.transform(a, lambda x: x - m))
    spread = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x) / F.size(c))
    return _with(centred, lambda c: _with(spread(c) + EPSILON, lambda d: F.transform(c, lambda x: x / d)))


def minmax(a: Column) -> Column:
    """(x - min) / (max - min + 1e-8)."""
    return _with(F.array_min(a), lambda lo: _with(F.array_max(a) - lo + EPSILON, lambda d: F.transform(a, lambda x: (x - lo) / d)))


def pad(a: Column, width: int) -> Column:
    """Zeros on the right up to ``width``."""
    return F.concat(a, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), width - F.size(a))))


def interpolate(a: Column, width: int) -> Column:
    """Linear resampling to ``width`` points; both ends are kept. A single value is repeated."""
    last = F.size(a) - 1

    def at(j: Column) -> Column:
        x = j * last / F.lit(float(width - 1))
        i = F.least(F.floor(x).cast("int"), last)
        here, there = F.element_at(a, i + 1), F.element_at(a, F.least(i + 1, last) + 1)
        return here + (there - here) * (x - i)

    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), at)


def bin_of(value: Column, edges: Column) -> Column:
    """Left-closed bin of a value, the last one closed; values outside go to the end bins."""
    reached = F.size(F.filter(edges, lambda e: e <= value)) - 1
    return F.greatest(F.lit(0), F.least(reached, F.size(edges) - 2))


def uniform_edges(bins: int) -> Column:
    return F.array(*(F.lit(i / bins) for i in range(bins + 1)))
