"""Queries on result tables: summaries, ranks, tests, profiles, pending work, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagmeter.config import LABELS
from bagmeter.functions.text import plain_name, strip_blanks
from bagmeter.operators import stats
from bagmeter.sources.tables import table

PROTOCOLS = ("APP", "C-APP")
#: Estimators that don't correct for the classifier's errors, and those that do.
NAIVE, CORRECTED = ("CC", "PCC"), ("ACC", "PACC", "EMQ", "HDy")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag results with plain names and errors from 0 to 1, each once."""
    return (
        table(spark, sf_dir, "baselines_2")
        .dropDuplicates()
        .where("mae >= 0 and mae <= 1 and not isnan(mae)")
        .withColumns({"method": plain_name(F.col("method")), "classifier": plain_name(F.col("classifier"))})
    )


def means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean errors per run with protocols as APP or C-APP, each once."""
    bare = F.regexp_replace(F.upper("protocol"), "[^A-Z]+", "")
    return (
        table(spark, sf_dir, "summary_table")
        .dropDuplicates()
        .where("mae_mean >= 0 and not isnan(mae_mean)")
        .withColumn("protocol", F.when(bare == "CAPP", "C-APP").otherwise(bare))
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def summary_by_quantifier(spark, sf_dir):
    return _rounded(stats.summary(results(spark, sf_dir), ["method", "classifier", "bag_size"], ["mae"]), "mae_mean", "mae_std")


def _protocol_means(spark, sf_dir) -> DataFrame:
    return _rounded(means(spark, sf_dir).groupBy("quantifier", "protocol", "bag_size").agg(F.avg("mae_mean").alias("mae"), F.stddev_samp("mae_mean").alias("std")), "mae", "std")


def protocol_summary(spark, sf_dir):
    return _protocol_means(spark, sf_dir)


def _shifts(spark, sf_dir) -> DataFrame:
    return stats.rank_shift(_protocol_means(spark, sf_dir), ["bag_size"], "quantifier", "protocol", "mae", *PROTOCOLS)


def protocol_rank_shift(spark, sf_dir):
    return _shifts(spark, sf_dir).select("bag_size", "quantifier", F.col("first_rank").alias("app_rank"), F.col("second_rank").alias("capp_rank"), F.col("shift").alias("rank_shift"))


def _method(c: str = "quantifier"):
    """The part after the first hyphen; names without one are methods."""
    parts = F.split(c, "-", 2)
    return F.when(F.size(parts) == 2, F.element_at(parts, 2)).otherwise(F.element_at(parts, 1))


def rank_shift_by_method(spark, sf_dir):
    by = _shifts(spark, sf_dir).groupBy(_method().alias("method")).agg(F.avg("shift").alias("mean_shift"), F.stddev_samp("shift").alias("std_shift"))
    return _rounded(by, "mean_shift", "std_shift")


def method_groups(spark, sf_dir):
    group = F.when(_method().isin(*NAIVE), "naive").when(_method().isin(*CORRECTED), "corrected").otherwise("other")
    out = means(spark, sf_dir).groupBy(group.alias("method_group"), "protocol").agg(F.count("*").alias("n"), F.avg("mae_mean").alias("mae"))
    return _rounded(out, "mae")


def spearman_by_bag_size(spark, sf_dir):
    return _rounded(stats.spearman(_shifts(spark, sf_dir), ["bag_size"], "first_rank", "second_rank"), "rho")


def wilcoxon_statistic(spark, sf_dir):
    shifts = _shifts(spark, sf_dir).withColumn("method", _method())
    return stats.wilcoxon(shifts, ["method"], "shift")


def best_per_bag_size(spark, sf_dir):
    best = F.min_by("quantifier", F.struct("mae", "quantifier"))
    return _protocol_means(spark, sf_dir).groupBy("protocol", "bag_size").agg(best.alias("quantifier"), F.min("mae").alias("mae"))


def topk_per_protocol(spark, sf_dir):
    ranked = stats.rank_within(_protocol_means(spark, sf_dir), ["protocol", "bag_size"], "mae", "quantifier", "place")
    return ranked.where("place <= 5").select("protocol", "bag_size", "place", "quantifier", "mae")


def pivot_metrics(spark, sf_dir):
    out = means(spark, sf_dir).groupBy("quantifier").pivot("protocol", list(PROTOCOLS)).agg(F.avg("mae_mean"))
    return out.select("quantifier", F.round("APP", 9).alias("app"), F.round("C-APP", 9).alias("capp"))


def mean_by_exact_truth(spark, sf_dir):
    out = results(spark, sf_dir).where("pred_pos is not null").groupBy("method", "true_pos").agg(F.avg("pred_pos").alias("pred_pos"))
    return _rounded(out, "pred_pos")


def rounded_truth_profile(spark, sf_dir):
    out = (
        results(spark, sf_dir).where("pred_pos is not null").groupBy("method", (F.rint(F.col("true_pos") * 100) / 100).alias("true_pos"))
        .agg(F.avg("pred_pos").alias("pred_mean"), F.coalesce(F.stddev_samp("pred_pos"), F.lit(0.0)).alias("pred_std"))
    )
    return _rounded(out, "pred_mean", "pred_std")


def binned_truth_profile(spark, sf_dir):
    out = (
        results(spark, sf_dir).where("true_pos between 0 and 1").groupBy("method", stats.right_closed_bin(F.col("true_pos"), 10).alias("bin"))
        .agg(F.avg("mae").alias("mae_mean"), F.stddev_samp("mae").alias("mae_std"), F.count("*").alias("n")).where("n >= 5")
    )
    return _rounded(out, "mae_mean", "mae_std")


def error_box_stats(spark, sf_dir):
    return _rounded(stats.box_stats(results(spark, sf_dir).select("method", "bag_size", "mae"), ["method", "bag_size"], "mae"), "q1", "median", "q3", "low", "high")


def slice_stats(spark, sf_dir):
    out = results(spark, sf_dir).where("bag_size = 100 and method in ('ACC', 'PACC')").groupBy("classifier").agg(F.stddev_samp("mae").alias("std"), F.avg("mae").alias("mean"))
    return _rounded(out, "std", "mean")


def named_results(spark, sf_dir):
    """Mean error by "method - classifier"."""
    out = results(spark, sf_dir).groupBy(F.concat_ws(" - ", "method", "classifier").alias("name")).agg(F.avg("mae").alias("mae"))
    return out.withColumn("mae", F.round("mae", 12))  # nine decimals would end in halves


def histogram_prevalence(spark, sf_dir):
    asked = table(spark, sf_dir, "bag_prevalences").distinct().where("n is not null")
    shares = asked.select(strip_blanks(F.col("label")).alias("label"), (F.col("n") / F.col("bag_size")).alias("share"))
    return stats.histogram(shares, ["label"], "share", 50)


def work_list(spark, sf_dir):
    """Every combination of the methods, classifiers and bag sizes that occur: three short lists, not a join of rows."""
    lists = results(spark, sf_dir).agg(*(F.sort_array(F.collect_set(c)).alias(c) for c in ("method", "classifier", "bag_size")))
    out = lists.withColumn("method", F.explode("method")).withColumn("classifier", F.explode("classifier"))
    return out.withColumn("bag_size", F.explode("bag_size"))


def resume_pending_units(spark, sf_dir):
    """Units of the work list without any result of a bag yet that asks for at least half positives."""
    done = results(spark, sf_dir).where("true_pos >= 0.9").select("method", "classifier", "bag_size").distinct()
    return work_list(spark, sf_dir).join(done, ["method", "classifier", "bag_size"], "left_anti")


def bundle_results_union(spark, sf_dir):
    """Results of both tables as one long table; columns that one lacks are null."""
    bags = results(spark, sf_dir).select("bag_size", F.col("method").alias("quantifier"), F.col("mae").alias("error"), "true_pos")
    runs = means(spark, sf_dir).select("bag_size", "quantifier", F.col("mae_mean").alias("error"), "protocol")
    return bags.unionByName(runs, allowMissingColumns=True).select("bag_size", "quantifier", F.round("error", 9).alias("error"), "true_pos", "protocol")


def first_match(spark, sf_dir):
    """Mean error of each quantifier and bag size from the first protocol that has it; C-APP comes first."""
    priority = F.when(F.col("protocol") == "C-APP", 0).otherwise(1)
    pick = F.min_by(F.struct("protocol", "mae"), priority)
    return _protocol_means(spark, sf_dir).groupBy("quantifier", "bag_size").agg(pick.alias("m")).select("quantifier", "bag_size", "m.protocol", "m.mae")


def verify_bag_export(spark, sf_dir):
    """Per bag: the greatest difference of the asked counts and those of its earlier draw, for labels asked by count."""
    key = ["protocol", "bag_size", "bag_index"]
    asked = table(spark, sf_dir, "bag_prevalences").where("n is not null").groupBy(*key, strip_blanks(F.col("label")).alias("label")).agg(F.max("n").alias("n"))
    labels = table(spark, sf_dir, "instances").select("instance_id", strip_blanks(F.col("y")).alias("label")).distinct()
    drawn = table(spark, sf_dir, "bag_members").where("instance_id is not null").distinct().join(labels, "instance_id")
    counts = drawn.groupBy(*key, "label").agg(F.count("*").alias("m"))
    gap = F.abs(F.col("n") - F.coalesce("m", F.lit(0)))
    return asked.join(counts, [*key, "label"], "left").groupBy(*key).agg(F.max(gap).alias("gap"))


def content_fingerprint(spark, sf_dir):
    """Fingerprint of each split that doesn't depend on the order of rows."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("instance_id").cast("string"), "y")), 1, 8), 16, 10).cast("long")
    rows = table(spark, sf_dir, "instances").where("split is not null").select("instance_id", "split", "y").distinct()
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.sum(digest).alias("fingerprint"))


_FNS = (
    summary_by_quantifier, protocol_summary, protocol_rank_shift, rank_shift_by_method, method_groups, spearman_by_bag_size, wilcoxon_statistic,
    best_per_bag_size, topk_per_protocol, pivot_metrics, mean_by_exact_truth, rounded_truth_profile, binned_truth_profile, error_box_stats,
    slice_stats, named_results, histogram_prevalence, work_list, resume_pending_units, bundle_results_union, first_match, verify_bag_export,
    content_fingerprint,
)
QUERIES = {f.__name__: f for f in _FNS}

_T = "trim({}, chr(32) || chr(9))"
_RESULTS = f"""
results as (
  select distinct * replace (upper({_T.format('method')}) as method, upper({_T.format('classifier')}) as classifier)
  from (select distinct * from baselines_2) where mae between 0 and 1 and not isnan(mae)
)"""
# rows that become equal by their plain names stay apart: only rows equal in every delivered column are repeats
_RESULTS = _RESULTS.replace("select distinct * replace", "select * replace")
_MEANS = """
means as (
  select * replace (case regexp_replace(upper(protocol), '[^A-Z]+', '', 'g') when 'CAPP' then 'C-APP' else 'APP' end as protocol)
  from (select distinct * from summary_table) where mae_mean >= 0 and not isnan(mae_mean)
)"""
_PROTOCOL = f"""{_MEANS},
by_protocol as (
  select quantifier, protocol, bag_size, round(avg(mae_mean), 9) as mae, round(stddev_samp(mae_mean), 9) as std from means group by all
)"""
_SHIFT = f"""{_PROTOCOL},
app as (select bag_size, quantifier, row_number() over (partition by bag_size order by mae, quantifier)::int as app_rank from by_protocol where protocol = 'APP'),
capp as (select bag_size, quantifier, row_number() over (partition by bag_size order by mae, quantifier)::int as capp_rank from by_protocol where protocol = 'C-APP'),
shifts as (
  select bag_size, quantifier, app_rank, capp_rank, app_rank - capp_rank as shift,
    case when contains(quantifier, '-') then substr(quantifier, strpos(quantifier, '-') + 1) else quantifier end as method
  from app join capp using (bag_size, quantifier)
)"""

SQL = {
    "summary_by_quantifier": f"""with {_RESULTS}
select method, classifier, bag_size, round(avg(mae), 9) as mae_mean, round(stddev_samp(mae), 9) as mae_std from results group by all""",
    "protocol_summary": f"with {_PROTOCOL} select * from by_protocol",
    "protocol_rank_shift": f"with {_SHIFT} select bag_size, quantifier, app_rank, capp_rank, shift as rank_shift from shifts",
    "rank_shift_by_method": f"with {_SHIFT} select method, round(avg(shift), 9) as mean_shift, round(stddev_samp(shift), 9) as std_shift from shifts group by method",
    "method_groups": f"""with {_MEANS},
named as (select *, case when contains(quantifier, '-') then substr(quantifier, strpos(quantifier, '-') + 1) else quantifier end as method from means)
select case when method in ('CC', 'PCC') then 'naive' when method in ('ACC', 'PACC', 'EMQ', 'HDy') then 'corrected' else 'other' end as method_group,
  protocol, count(*) as n, round(avg(mae_mean), 9) as mae from named group by all""",
    "spearman_by_bag_size": f"""with {_SHIFT},
again as (select bag_size, rank() over (partition by bag_size order by app_rank) as a, rank() over (partition by bag_size order by capp_rank) as b from shifts)
select bag_size, round(corr(a, b), 9) as rho from again group by bag_size""",
    "wilcoxon_statistic": f"""with {_SHIFT},
signed as (
  select method, shift, rank() over (partition by method order by abs(shift)) + (count(*) over (partition by method, abs(shift)) - 1) / 2.0::double as r
  from shifts where shift <> 0
)
select method, count(*) as n, sum(case when shift > 0 then r else 0.0::double end) as w_plus, sum(case when shift < 0 then r else 0.0::double end) as w_minus,
  least(sum(case when shift > 0 then r else 0.0::double end), sum(case when shift < 0 then r else 0.0::double end)) as statistic from signed group by method""",
    "best_per_bag_size": f"""with {_PROTOCOL}
select protocol, bag_size, quantifier, mae from (
  select *, row_number() over (partition by protocol, bag_size order by mae, quantifier) as r from by_protocol) where r = 1""",
    "topk_per_protocol": f"""with {_PROTOCOL}
select protocol, bag_size, place, quantifier, mae from (
  select *, row_number() over (partition by protocol, bag_size order by mae, quantifier)::int as place from by_protocol) where place <= 5""",
    "pivot_metrics": f"""with {_MEANS}
select quantifier, round(avg(mae_mean) filter (protocol = 'APP'), 9) as app, round(avg(mae_mean) filter (protocol = 'C-APP'), 9) as capp from means group by quantifier""",
    "mean_by_exact_truth": f"with {_RESULTS} select method, true_pos, round(avg(pred_pos), 9) as pred_pos from results where pred_pos is not null group by all",
    "rounded_truth_profile": f"""with {_RESULTS}
select method, round_even(true_pos * 100, 0) / 100.0::double as true_pos, round(avg(pred_pos), 9) as pred_mean, round(coalesce(stddev_samp(pred_pos), 0), 9) as pred_std
from results where pred_pos is not null group by method, round_even(true_pos * 100, 0)""",
    "binned_truth_profile": f"""with {_RESULTS}
select method, len(list_filter([{', '.join(f'{i / 10}' for i in range(1, 10))}]::double[], lambda e: e < true_pos))::int as bin,
  round(avg(mae), 9) as mae_mean, round(stddev_samp(mae), 9) as mae_std, count(*) as n
from results where true_pos between 0 and 1 group by all having count(*) >= 5""",
    "error_box_stats": f"""with {_RESULTS},
q as (select method, bag_size, quantile_cont(mae, 0.25) as q1, quantile_cont(mae, 0.5) as m, quantile_cont(mae, 0.75) as q3 from results group by all)
select method, bag_size, round(any_value(q1), 9) as q1, round(any_value(m), 9) as median, round(any_value(q3), 9) as q3,
  round(min(mae) filter (mae >= q1 - 1.5::double * (q3 - q1) and mae <= q3 + 1.5::double * (q3 - q1)), 9) as low,
  round(max(mae) filter (mae >= q1 - 1.5::double * (q3 - q1) and mae <= q3 + 1.5::double * (q3 - q1)), 9) as high
from results join q using (method, bag_size) group by method, bag_size""",
    "slice_stats": f"""with {_RESULTS}
select classifier, round(stddev_samp(mae), 9) as std, round(avg(mae), 9) as mean from results where bag_size = 100 and method in ('ACC', 'PACC') group by classifier""",
    "named_results": f"with {_RESULTS} select method || ' - ' || classifier as name, round(avg(mae), 12) as mae from results group by all",
    "histogram_prevalence": f"""with shares as (
  select {_T.format('label')} as label, n / bag_size::double as share from (select distinct * from bag_prevalences) where n is not null
),
spans as (select label, min(share) as lo, max(share) as hi from shares group by label)
select label, least(49, coalesce(floor((share - lo) / nullif(hi - lo, 0) * 50), 0))::int as bin, count(*) as n from shares join spans using (label) group by all""",
    "work_list": f"""with {_RESULTS}
select method, classifier, bag_size from (select distinct method from results), (select distinct classifier from results), (select distinct bag_size from results)""",
    "resume_pending_units": f"""with {_RESULTS},
units as (select method, classifier, bag_size from (select distinct method from results), (select distinct classifier from results), (select distinct bag_size from results))
select * from units except select method, classifier, bag_size from results where true_pos >= 0.9::double""",
    "bundle_results_union": f"""with {_RESULTS}, {_MEANS}
select bag_size, method as quantifier, round(mae, 9) as error, true_pos, null as protocol from results
union all select bag_size, quantifier, round(mae_mean, 9), null, protocol from means""",
    "first_match": f"""with {_PROTOCOL}
select quantifier, bag_size, protocol, mae from (
  select *, row_number() over (partition by quantifier, bag_size order by case when protocol = 'C-APP' then 0 else 1 end) as r from by_protocol) where r = 1""",
    "verify_bag_export": f"""with asked as (
  select protocol, bag_size, bag_index, {_T.format('label')} as label, max(n) as n from bag_prevalences where n is not null group by all
),
beats as (select distinct instance_id, {_T.format('y')} as label from instances),
counts as (
  select protocol, bag_size, bag_index, label, count(*) as m from (select distinct * from bag_members where instance_id is not null) join beats using (instance_id) group by all
)
select protocol, bag_size, bag_index, max(abs(n - coalesce(m, 0)))::bigint as gap from asked left join counts using (protocol, bag_size, bag_index, label) group by all""",
    "content_fingerprint": """
select split, count(*) as n, sum(cast('0x' || substr(md5(concat_ws('|', cast(instance_id as varchar), y)), 1, 8) as bigint))::bigint as fingerprint
from (select distinct instance_id, split, y from instances where split is not null) group by split""",
}
