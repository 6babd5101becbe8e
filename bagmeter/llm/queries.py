"""Queries of the numbered problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagmeter.functions.text import canonical_id, known_id, plain_name, strip_blanks
from bagmeter.llm import groups, leaks, near_copies, quality, quantiles, quota, tokens, topn
from bagmeter.llm.sql import SQL  # noqa: F401
from bagmeter.sources.scratch import new_path, stage
from bagmeter.sources.tables import table

# ---- 1: samples that match target shares -------------------------------------------------

#: The five beat classes of the ANSI/AAMI EC57 standard and their beat symbols.
BEAT_CLASSES = {
    "N": ("N", "L", "R", "e", "j"),
    "S": ("A", "a", "J", "S"),
    "V": ("V", "E"),
    "F": ("F",),
    "Q": ("/", "f", "Q"),
}
_BAG = ["protocol", "bag_size", "bag_index"]


def _beat_class(label):
    out = label
    for name, symbols in BEAT_CLASSES.items():
        out = F.when(label.isin(*symbols), F.lit(name)).otherwise(out)
    return out


def _test_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "instances")
        .where("split = 'test' and source is not null and instance_id is not null")
        .select("source", strip_blanks(F.col("y")).alias("label"), "instance_id")
        .where("label is not null")
    )


def _allotments(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "bag_prevalences")
    count = quota.whole_count(F.col("n"), F.col("prevalence"), F.col("bag_size"), F.col("min_n"))
    quotas = (
        asked.withColumn("label", strip_blanks(F.col("label")))
        .withColumn("quota", count)
        .groupBy(*_BAG, "source", "label")
        .agg(F.max("quota").alias("quota"))
        .withColumn("beat_class", _beat_class(F.col("label")))
    )
    supply = (
        _test_beats(spark, sf_dir)
        .distinct()
        .groupBy("source", "label")
        .agg(F.count("*").alias("available"))
        .withColumn("beat_class", _beat_class(F.col("label")))
    )
    return quota.allocate(quotas, supply, _BAG, ["source"], ["beat_class", "label"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _allotments(spark, sf_dir).where("shortfall > 0").select(*_BAG, "label")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _allotments(spark, sf_dir).select(*_BAG, "label", "quota", "available", "own", "allotted", "shortfall")


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = quota.ranked_pool(_test_beats(spark, sf_dir), ["source", "label"], "instance_id")
    return quota.draw(_allotments(spark, sf_dir), ranked, _BAG, ["source", "label"], "instance_id")


# ---- 2: same or near-same beats across splits --------------------------------------------


_COPIES = ("instance_id", "split", "features", "train", ["valid", "test"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(table(spark, sf_dir, "instances"), *_COPIES).select(
        F.least("train_id", "other_id").alias("instance_a"), F.greatest("train_id", "other_id").alias("instance_b")
    )


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.copy_report(table(spark, sf_dir, "instances"), *_COPIES, ["split", "source"]).withColumnRenamed("units", "beats")


# ---- 3: percentiles ----------------------------------------------------------------------

_RUN = ["method", "classifier", "bag_size"]
PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]
#: Bins of a day's summary over [0, 1]; a percentile of merged days is at most 1/2048 off.
DAY_BINS = 1024


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "baselines_2")
        .dropDuplicates()
        .where(quantiles.unit_interval(F.col("mae")))
        .select(plain_name(F.col("method")).alias("method"), plain_name(F.col("classifier")).alias("classifier"), "bag_size", "mae", "run_day")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.percentiles(_errors(spark, sf_dir), _RUN, "mae", [0.5]).where("value > 0.30").select(*_RUN)


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.percentiles(_errors(spark, sf_dir), _RUN, "mae", PROBS).select(*_RUN, "prob", "n", F.round("value", 9).alias("value"))


def p3_merged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = quantiles.summarise(_errors(spark, sf_dir), _RUN, "run_day", "mae", 0.0, 1.0, DAY_BINS)
    return quantiles.merged_percentiles(days, _RUN, PROBS, 0.0, 1.0, DAY_BINS)


# ---- 4: splits that keep related records together ----------------------------------------

#: Proportions asked.
SHARES = {"train": 0.7, "valid": 0.1, "test": 0.2}


def _record_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, edges to patients, edges by links, and beats per node. Patients' nodes sort after all records."""
    records = table(spark, sf_dir, "records").select(canonical_id(F.col("record_id")).alias("node"), known_id(F.col("patient_id")).alias("patient"))
    patients = records.where("patient is not null").select(F.col("node").alias("a"), F.concat(F.lit("~"), "patient").alias("b"))
    links = table(spark, sf_dir, "record_links").select(canonical_id(F.col("record_a")).alias("a"), canonical_id(F.col("record_b")).alias("b"))
    beats = (
        table(spark, sf_dir, "instances")
        .where("instance_id is not null")
        .select("record_id", "y", "split", "instance_id")
        .distinct()
        .groupBy("record_id", "y", "split")
        .agg(F.count("*").alias("n"))
        .groupBy(canonical_id(F.col("record_id")).alias("node"), strip_blanks(F.col("y")).alias("label"), "split")
        .agg(F.sum("n").alias("n"))
        .where("node is not null")
    )
    return records.select("node"), patients, links, beats


def _presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node``, ``split``, ``n``: whether a record has beats in a split; the count isn't needed, so no beat is shuffled."""
    return (
        table(spark, sf_dir, "instances")
        .where("split is not null and instance_id is not null")
        .select("record_id", "split")
        .distinct()
        .select(canonical_id(F.col("record_id")).alias("node"), "split", F.lit(1).alias("n"))
        .where("node is not null")
    )


def _component_table(spark: SparkSession, nodes: DataFrame, patients: DataFrame, links: DataFrame) -> groups.ComponentTable:
    """Two batches: records with their patients, then the links."""
    kept = groups.ComponentTable(spark, new_path(spark, "p4-components"))
    kept.add(nodes, patients)
    kept.add(nodes.where("false"), links)
    return kept


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, patients, links, _ = _record_graph(spark, sf_dir)
    components = _component_table(spark, nodes, patients, links).at(-1)
    torn = groups.small(groups.in_conflict(groups.component_splits(components, _presence(spark, sf_dir))).select("root"))
    return (
        components.join(nodes.distinct(), "node", "left_semi")
        .join(torn, "root")
        .select(F.col("node").alias("record_id"), F.col("root").alias("group_id"))
    )


def _assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, patients, links, beats = _record_graph(spark, sf_dir)
    kept, beats = _component_table(spark, nodes, patients, links), stage(beats, "held")
    return kept.at(-1), groups.assign_splits(kept.at(-2), kept.at(-1), beats, SHARES), beats


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, splits, _ = _assigned(spark, sf_dir)
    return (
        after.where("node not like '~%'")
        .join(splits, "root")
        .select(F.col("node").alias("record_id"), F.col("root").alias("group_id"), "split", "status")
    )


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, splits, beats = _assigned(spark, sf_dir)
    return groups.reached_shares(after, splits, beats, SHARES).withColumn("reached", F.round("reached", 9))


# ---- 5: top N ----------------------------------------------------------------------------

#: Places reported.
PLACES = 5


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.upper("protocol"), "[^A-Z]+", "")
    protocol = F.when(bare == "CAPP", "C-APP").otherwise(bare)
    means = table(spark, sf_dir, "summary_table").where("mae_mean >= 0").withColumn("protocol", protocol)
    return topn.top_n(means, ["run_id", "protocol", "bag_size"], "mae_mean", ["quantifier"], PLACES).select(
        "run_id", "protocol", "bag_size", "place", "quantifier"
    )


# ---- 7: token ids ------------------------------------------------------------------------


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "ids")


# ---- 8: evaluation texts in the corpus ---------------------------------------------------


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "item_text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return leaks.without_leaks(docs, "doc_id", _leaks(spark, sf_dir)).select("doc_id", "source")


# ---- 9: text quality ---------------------------------------------------------------------


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.no_prose(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", table(spark, sf_dir, "common_words")).select("doc_id")


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    common = quality.common_by_language(table(spark, sf_dir, "common_words"))
    return quality.text_stats(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", common)


def p9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).select(F.col("id").alias("doc_id"), "lang", *(F.round(c, 9).alias(c) for c in quality.TAILS if c != "outside_share"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.outlier_scores(_stats(spark, sf_dir)).select(F.col("id").alias("doc_id"), "lang", F.round("score", 6).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_report, p1_sample, p2_found, p2_report, p3_found, p3_percentiles, p3_merged_days, p4_found, p4_splits, p4_shares,
        p5_found, p7_ids, p8_found, p8_longest, p8_clean, p9_found, p9_stats, p9_scores,
    )
}
