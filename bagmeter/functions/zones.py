"""Prevalence bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bagmeter.config import CLINICAL_RANGES


def find_zone(label: Column, value: Column, ranges: dict | None = None) -> Column:
    """Band of ``value`` among the bands of ``label``; null for a label without bands.

    Below the first band is band 0, above the last one is the last: with bands that touch, the
    number of inner lower bounds that the value reaches.
    """
    out = F.lit(None).cast("int")
    for name, bands in (ranges or CLINICAL_RANGES).items():
        zone = sum(((value >= F.lit(lo)).cast("int") for lo, _ in bands[1:]), F.lit(0))
        out = F.when(label == name, zone).otherwise(out)
    return F.when(value.isNotNull(), out)


def band_count(label: Column, ranges: dict | None = None) -> Column:
    """Number of bands of a label, 0 for others."""
    out = F.lit(0)
    for name, bands in (ranges or CLINICAL_RANGES).items():
        out = F.when(label == name, F.lit(len(bands))).otherwise(out)
    return out


def zone_sql(label: str, value: str, ranges: dict | None = None) -> str:
    """:func:`find_zone` in SQL."""
    cases = []
    for name, bands in (ranges or CLINICAL_RANGES).items():
        steps = " + ".join(["0", *(f"({value} >= {lo}::double)::int" for lo, _ in bands[1:])])
        cases.append(f"when {label} = '{name}' then {steps}")
    return f"case when {value} is null then null {' '.join(cases)} end"
