"""Filters, encodings and counts of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagmeter.config import BASE_LABEL, LABELS


def keep_symbols(df: DataFrame, symbol: str, mode: str = "multiclass") -> DataFrame:
    """Rows whose symbol belongs to the problem: all of them in binary mode, else those of :data:`LABELS`."""
    if mode not in ("binary", "multiclass"):
        raise ValueError(f"unknown label mode: {mode}")
    return df if mode == "binary" else df.where(F.col(symbol).isin(*LABELS))


def binary_label(symbol: Column) -> Column:
    """1 for the healthy class, else 0; a null symbol is 0."""
    return F.coalesce((symbol == BASE_LABEL).cast("int"), F.lit(0))


def class_distribution(df: DataFrame, groups: list[str], label: str) -> DataFrame:
    """Rows per label and their share of the group."""
    counts = df.groupBy(*groups, label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*groups)))


def patient_diversity(df: DataFrame, groups: list[str], label: str, patient: str, least: int = 3) -> DataFrame:
    """Distinct patients per label; ``few`` marks labels with less than ``least``."""
    out = df.groupBy(*groups, label).agg(F.countDistinct(patient).alias("patients"))
    return out.withColumn("few", F.col("patients") < least)


def balance_report(df: DataFrame, group: str, label: str, least: int = 30, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """For each group and expected label: rows, percentage, and whether they are few or missing."""
    counts = df.where(F.col(label).isin(*labels)).groupBy(group).agg(*(F.sum((F.col(label) == x).cast("long")).alias(f"_{x}") for x in labels))
    parts = F.array(*(F.struct(F.lit(x).alias("label"), F.col(f"_{x}").alias("n")) for x in labels))
    total = sum((F.col(f"_{x}") for x in labels), F.lit(0))
    return (
        counts.select(group, total.alias("_total"), F.explode(parts).alias("_p"))
        .select(group, F.col("_p.label").alias("label"), F.col("_p.n").alias("n"), (F.col("_p.n") * 100.0 / F.col("_total")).alias("percent"))
        .withColumns({"low": F.col("n") < least, "missing": F.col("n") == 0})
    )


def burden(df: DataFrame, keys: list[str], label: str, prevalence: str, base: str = BASE_LABEL) -> DataFrame:
    """1 minus the prevalence of the base label; a group without that label has no burden and is left out."""
    return (
        df.groupBy(*keys)
        .agg(F.max(F.when(F.col(label) == base, F.col(prevalence))).alias("_base"))
        .where("_base is not null")
        .select(*keys, (F.lit(1.0) - F.col("_base")).alias("burden"))
    )
