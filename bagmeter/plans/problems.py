"""Queries of the general problem 6 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagmeter.functions.text import canonical_id, strip_blanks
from bagmeter.operators.skew import balanced_key_stats, dominant_keys
from bagmeter.sources.tables import table

#: A label that holds more than this share of its split is dominant.
DOMINANT_SHARE = 0.1


def _label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = (
        table(spark, sf_dir, "instances")
        .where(F.col("split").isin("train", "valid", "test"))
        .select(
            "split", strip_blanks(F.col("y")).alias("y"), "instance_id", canonical_id(F.col("record_id")).alias("record"), "source"
        )
    )
    return balanced_key_stats(beats, ["split", "y"], "instance_id", "record", "source")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominant_keys(_label_stats(spark, sf_dir), "split", "y", DOMINANT_SHARE).select("split", "y")


def p6_label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _label_stats(spark, sf_dir).select(
        "split",
        "y",
        F.col("n_units").alias("beats"),
        F.col("n_records").alias("records"),
        F.col("n_members").alias("sources"),
    )


QUERIES = {"p6_found": p6_found, "p6_label_stats": p6_label_stats}

_BEATS = r"""
beats as (
  select distinct split, trim(y, chr(32) || chr(9)) as y, instance_id, source,
    regexp_extract(regexp_replace(lower(record_id), '[^a-z0-9]+', '', 'g'), '^([a-z]+)0*([0-9]+)$', 1) || '-' ||
    lpad(regexp_extract(regexp_replace(lower(record_id), '[^a-z0-9]+', '', 'g'), '^([a-z]+)0*([0-9]+)$', 2), 7, '0') as record
  from instances where split in ('train', 'valid', 'test')
)"""

SQL = {
    "p6_found": f"""
with {_BEATS},
totals as (select split, count(distinct instance_id) as total from beats group by split)
select b.split, b.y from beats b join totals t on b.split = t.split where b.y is not null
group by b.split, b.y, t.total having count(distinct b.instance_id) > {DOMINANT_SHARE} * t.total""",
    "p6_label_stats": f"""
with {_BEATS}
select split, y, count(distinct instance_id) as beats, count(distinct record) as records, count(distinct source) as sources
from beats group by split, y""",
}
