"""Queries on bags, scores and prevalence estimates, and their SQL.

Scores are those of the centroid classifier with 6 decimals, so both engines agree on every
comparison with a threshold. Bags are the draws of ``bag_members``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagmeter.config import CLINICAL_RANGES, LABELS
from bagmeter.functions.arrays import uniform_edges
from bagmeter.functions.text import strip_blanks
from bagmeter.functions.zones import zone_sql
from bagmeter.operators import estimators as est
from bagmeter.operators import metrics, scoring
from bagmeter.sources.scratch import stage
from bagmeter.sources.shared import shared
from bagmeter.sources.tables import table

BAG = ["protocol", "bag_size", "bag_index"]
_IN = "', '".join(LABELS)


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole beats of the five symbols with a split (and a fold, in training), each once, as a written table that queries share.

    Deliveries of a beat agree in all columns read here, so any of them may stay.
    """
    return shared(spark, sf_dir, ("instances",), "whole-beats", lambda: _whole_beats(spark, sf_dir))


def _whole_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "instances")
        .where(F.col("split").isin("train", "valid", "test") & ((F.col("split") != "train") | F.col("fold").isNotNull()))
        .where(scoring.is_whole(F.col("features")))
        .select("instance_id", "record_id", "split", "fold", strip_blanks(F.col("y")).alias("y"), "features")
        .where(F.col("y").isin(*LABELS))
        .dropDuplicates(["instance_id"])
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``instance_id``, ``split``, ``fold``, ``y``, ``p``, ``pred``, as a written table that queries share."""

    def make() -> DataFrame:
        rows = instances(spark, sf_dir)
        models = scoring.centroids(rows.where("split = 'train'").select("fold", "y", "features"))
        return scoring.centroid_scores(rows, models).select("instance_id", "record_id", "split", "fold", "y", "p", "pred")

    return shared(spark, sf_dir, ("instances",), "scores", make)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = lambda: table(spark, sf_dir, "bag_members").where("instance_id is not null").select(*BAG, "pos", "instance_id").distinct()
    return shared(spark, sf_dir, ("bag_members",), "members", drawn)


def bag_rows(spark: SparkSession, sf_dir: str, scored: DataFrame) -> DataFrame:
    """Members of bags with their score rows; beats that aren't test beats don't count."""
    tested = scored.where("split = 'test'").select("instance_id", "y", "p", "pred")
    return members(spark, sf_dir).join(tested, "instance_id")


def long_bags(rows: DataFrame) -> DataFrame:
    return scoring.long_scores(rows, [*BAG, "y", "pred"]).select(
        *BAG, "label", "p", (F.col("pred") == F.col("label")).cast("int").alias("is_pred"), (F.col("y") == F.col("label")).cast("int").alias("is_true")
    )


def out_of_fold(scored: DataFrame) -> DataFrame:
    return scoring.long_scores(scored.where("split = 'train'"), ["y", "pred"]).select(
        "label", "p", (F.col("pred") == F.col("label")).cast("int").alias("is_pred"), (F.col("y") == F.col("label")).cast("int").alias("is_true")
    )


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scored = scores(spark, sf_dir)
    return long_bags(bag_rows(spark, sf_dir, scored)), out_of_fold(scored)


def _out(df: DataFrame) -> DataFrame:
    return df.select(*BAG, "label", F.round("p_pred", 9).alias("p_pred"))


def cc_estimate(spark, sf_dir):
    return _out(est.cc(_inputs(spark, sf_dir)[0], BAG))


def pcc_estimate(spark, sf_dir):
    # means of 6-decimal scores end in halves of the 9th decimal, so 12 are kept
    return est.pcc(_inputs(spark, sf_dir)[0], BAG).select(*BAG, "label", F.round("p_pred", 12).alias("p_pred"))


def acc_estimate(spark, sf_dir):
    return _out(est.acc(*_inputs(spark, sf_dir), BAG))


def pacc_estimate(spark, sf_dir):
    return _out(est.pacc(*_inputs(spark, sf_dir), BAG))


def ovr_normalize(spark, sf_dir):
    return _out(est.normalized(est.acc(*_inputs(spark, sf_dir), BAG), BAG))


def threshold_x(spark, sf_dir):
    return _out(est.threshold(*_inputs(spark, sf_dir), BAG, "x"))


def threshold_max(spark, sf_dir):
    return _out(est.threshold(*_inputs(spark, sf_dir), BAG, "max"))


def threshold_t50(spark, sf_dir):
    return _out(est.threshold(*_inputs(spark, sf_dir), BAG, "t50"))


def median_sweep(spark, sf_dir):
    return _out(est.median_sweep(*_inputs(spark, sf_dir), BAG))


def hdy_grid(spark, sf_dir):
    return _out(est.hdy(*_inputs(spark, sf_dir), BAG))


def dys_grid(spark, sf_dir):
    return _out(est.matched(*_inputs(spark, sf_dir), BAG, "topsoe", 10))


def forman_mm(spark, sf_dir):
    return _out(est.matched(*_inputs(spark, sf_dir), BAG, "cdf", 20))


def _evaluated(spark, sf_dir) -> DataFrame:
    """True and estimated prevalence (classify and count, rounded) of each bag and label."""
    long = _inputs(spark, sf_dir)[0]
    return stage(long.groupBy(*BAG, "label").agg(F.avg("is_true").alias("p_true"), F.avg("is_pred").alias("p_pred")), "evaluated")


def bag_truth(spark, sf_dir):
    return _evaluated(spark, sf_dir).select(*BAG, "label", F.round("p_true", 9).alias("prevalence"))


def abs_error_by_bag(spark, sf_dir):
    return metrics.absolute_error(_evaluated(spark, sf_dir), BAG).withColumn("ae", F.round("ae", 9))


def zone_crossing_error(spark, sf_dir):
    return metrics.zone_crossing_error(_evaluated(spark, sf_dir), BAG).withColumn("zce", F.round("zce", 9))


def zone_report(spark, sf_dir):
    return metrics.zone_report(_evaluated(spark, sf_dir), BAG).select(*BAG, "label", "true_zone", "pred_zone", "crossed")


_KEYS = ["split"]


def _scored(spark, sf_dir) -> DataFrame:
    return scores(spark, sf_dir).withColumns({"conf": F.array_max("p"), "hit": F.col("pred") == F.col("y")})


def brier_score(spark, sf_dir):
    names = F.array(*map(F.lit, LABELS))
    return metrics.brier(_scored(spark, sf_dir), _KEYS, "y", "p", names).withColumn("brier", F.round("brier", 9))


def ece_uniform(spark, sf_dir):
    curve = metrics.reliability(_scored(spark, sf_dir), _KEYS, F.col("conf"), F.col("hit"), uniform_edges(15))
    return metrics.calibration_error(curve, _KEYS).withColumn("ece", F.round("ece", 9))


def ece_quantile(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    edges = metrics.quantile_edges(scored, _KEYS, "conf", 15)
    curve = metrics.reliability(scored.join(F.broadcast(edges), "split"), _KEYS, F.col("conf"), F.col("hit"), F.col("edges"))
    return metrics.calibration_error(curve, _KEYS).withColumn("ece", F.round("ece", 9))


def _by_label(spark, sf_dir) -> DataFrame:
    long = scoring.long_scores(scores(spark, sf_dir), ["split", "y"])
    return long.withColumn("hit", F.col("y") == F.col("label"))


def classwise_ece(spark, sf_dir):
    curve = metrics.reliability(_by_label(spark, sf_dir), ["split", "label"], F.col("p"), F.col("hit"), uniform_edges(15))
    return metrics.calibration_error(curve, ["split", "label"]).withColumn("ece", F.round("ece", 9))


def reliability_curve(spark, sf_dir):
    curve = metrics.reliability(_scored(spark, sf_dir), _KEYS, F.col("conf"), F.col("hit"), uniform_edges(15))
    return curve.select("split", "bin", "n", *(F.round(c, 9).alias(c) for c in ("confidence", "accuracy")))


def log_loss_accuracy(spark, sf_dir):
    scored = _scored(spark, sf_dir).withColumn("p_true", F.element_at("p", F.array_position(F.array(*map(F.lit, LABELS)), F.col("y")).cast("int")))
    out = metrics.log_loss_accuracy(scored, _KEYS, F.col("p_true"), F.col("hit"))
    return out.select("split", *(F.round(c, 9).alias(c) for c in ("log_loss", "accuracy")))


def f1_accuracy(spark, sf_dir):
    scored = scores(spark, sf_dir)
    out = metrics.f1_accuracy(scored, _KEYS, (F.col("y") == "N").cast("int"), (F.col("pred") == "N").cast("int"))
    return out.select("split", *(F.round(c, 9).alias(c) for c in ("f1", "accuracy")))


def bag_instances(spark, sf_dir):
    """Members of every bag with record, truth, prediction and one column per score."""
    scored = scores(spark, sf_dir)
    columns = [F.element_at("p", i + 1).alias(f"p_{x}") for i, x in enumerate(LABELS)]
    return members(spark, sf_dir).join(scored.where("split = 'test'"), "instance_id").select(*BAG, "pos", "instance_id", "record_id", "y", "pred", *columns)


def flat_outputs(spark, sf_dir):
    """One row per instance with prediction and scores."""
    columns = [F.element_at("p", i + 1).cast("float").alias(f"CENTROID_p_{x}") for i, x in enumerate(LABELS)]
    return scores(spark, sf_dir).select("instance_id", "split", F.col("pred").alias("CENTROID_pred"), *columns)


def align_proba(spark, sf_dir):
    """Scores in the order of a longer label list; labels the model doesn't know get 0."""
    wanted = ("A", "F", "L", "N", "R", "V")
    aligned = scoring.align_scores(F.col("p"), list(LABELS), wanted)
    out = scores(spark, sf_dir).where("split = 'test'").select("instance_id", aligned.alias("p"))
    return scoring.long_scores(out, ["instance_id"], wanted)


_FNS = (
    cc_estimate, pcc_estimate, acc_estimate, pacc_estimate, ovr_normalize, threshold_x, threshold_max, threshold_t50, median_sweep,
    hdy_grid, dys_grid, forman_mm, bag_truth, abs_error_by_bag, zone_crossing_error, zone_report, brier_score, ece_uniform, ece_quantile,
    classwise_ece, reliability_curve, log_loss_accuracy, f1_accuracy, bag_instances, flat_outputs, align_proba,
)
QUERIES = {f.__name__: f for f in _FNS}

SCORES_SQL = f"""
inst as (
  select distinct on (instance_id) instance_id, record_id, split, fold, trim(y, chr(32) || chr(9)) as y, features from instances
  where trim(y, chr(32) || chr(9)) in ('{_IN}') and split in ('train', 'valid', 'test') and (split <> 'train' or fold is not null)
    and len(features) = 20 and len(list_filter(features, lambda v: v is not null and not isnan(v))) = 20
),
trainv as (select fold, y, unnest(features) as v, generate_subscripts(features, 1) as i from inst where split = 'train'),
folds as (select distinct fold as m from inst where split = 'train' union all select -1),
cents as (select m, y as label, i, avg(v) as c from trainv, folds where m <> fold group by all),
models as (select m, label, list(c order by i) as c from cents group by all),
weights as (
  select instance_id, record_id, split, fold, y, label,
    exp(-0.5 * list_sum(list_transform(list_zip(features, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as w
  from inst join models on m = case when split = 'train' then fold else -1 end
),
shares as (select *, round(w / sum(w) over (partition by instance_id), 6) as p from weights),
scores as (
  select instance_id, record_id, split, fold, y, label, p,
    first_value(label) over (partition by instance_id order by p desc, label) as pred,
    max(p) over (partition by instance_id) as conf
  from shares
)"""
BAGS_SQL = f"""{SCORES_SQL},
members as (select distinct protocol, bag_size, bag_index, pos, instance_id from bag_members where instance_id is not null),
bags as (
  select protocol, bag_size, bag_index, label, p, (pred = label)::int as is_pred, (y = label)::int as is_true
  from members join scores using (instance_id) where split = 'test'
),
oof as (select label, p, (pred = label)::int as is_pred, (y = label)::int as is_true from scores where split = 'train'),
rates as (
  select label, avg(is_pred) filter (is_true = 1) as tpr, avg(is_pred) filter (is_true = 0) as fpr,
    avg(p) filter (is_true = 1) as mu_pos, avg(p) filter (is_true = 0) as mu_neg from oof group by label
),
cc as (select protocol, bag_size, bag_index, label, avg(is_pred) as raw from bags group by all),
pcc as (select protocol, bag_size, bag_index, label, avg(p) as raw from bags group by all)"""


def _adjusted(raw: str, high: str, low: str) -> str:
    return f"case when {high} <> {low} then greatest(0.0::double, least(1.0::double, ({raw} - {low}) / ({high} - {low}))) else {raw} end"


_ROC = f"""{BAGS_SQL},
steps as (select label, floor(round(p * 100, 6))::int as s, is_true from oof),
grid as (select label, unnest(range(0, 101))::int as step from rates),
roc as (
  select g.label, g.step, count(*) filter (s.s >= g.step and s.is_true = 1) / nullif(count(*) filter (s.is_true = 1), 0)::double as tpr,
    count(*) filter (s.s >= g.step and s.is_true = 0) / nullif(count(*) filter (s.is_true = 0), 0)::double as fpr
  from grid g join steps s on g.label = s.label group by all
),
bag_steps as (select protocol, bag_size, bag_index, label, floor(round(p * 100, 6))::int as s from bags)"""


def _threshold(cost: str) -> str:
    return f"""
with {_ROC},
chosen as (select * from (select *, row_number() over (partition by label order by round({cost}, 9), step) as r from roc) where r = 1),
raw as (
  select protocol, bag_size, bag_index, b.label, avg((b.s >= c.step)::int) as raw, any_value(tpr) as tpr, any_value(fpr) as fpr
  from bag_steps b join chosen c on b.label = c.label group by all
)
select protocol, bag_size, bag_index, label, round({_adjusted('raw', 'tpr', 'fpr')}, 9) as p_pred from raw"""


def _match(bins: int, distance: str, n: str) -> str:
    """CTEs mix<n> (bag, label, alpha in hundredths, distance) over ``bins`` equal bins."""
    cell = f"least({bins - 1}, floor(round(p * {bins}, 6)))::int"
    source = {
        "cdf": f"""
cdf{n} as (
  select h.protocol, h.bag_size, h.bag_index, h.label, h.b, sum(k.t) as t, sum(k.pos) as pos, sum(k.neg) as neg from hist{n} h
  join hist{n} k on h.protocol = k.protocol and h.bag_size = k.bag_size and h.bag_index = k.bag_index and h.label = k.label and k.b <= h.b
  group by all
),"""
    }.get(distance, "")
    mixed = "(a / 100.0::double * pos + (1 - a / 100.0::double) * neg)"
    term = {
        "hellinger": f"-sqrt(t * {mixed})",
        "topsoe": f"case when t > 0 then t * ln(2 * t / (t + {mixed})) else 0 end + case when {mixed} > 0 then {mixed} * ln(2 * {mixed} / (t + {mixed})) else 0 end",
        "cdf": f"abs(t - {mixed})",
    }[distance]
    return f"""
cells{n} as (select unnest(range(0, {bins}))::int as b),
pn{n} as (
  select r.label, c.b, count(*) filter ({cell} = c.b and is_true = 1) / count(*) filter (is_true = 1)::double as pos,
    count(*) filter ({cell} = c.b and is_true = 0) / count(*) filter (is_true = 0)::double as neg
  from oof r, cells{n} c group by all
),
hist{n} as (
  select protocol, bag_size, bag_index, g.label, c.b, count(*) filter ({cell} = c.b) / count(*)::double as t, any_value(pos) as pos, any_value(neg) as neg
  from bags g join pn{n} c on g.label = c.label group by all
),{source}
mix{n} as (
  select protocol, bag_size, bag_index, label, a, round(sum({term}), 9) as d
  from {'cdf' if distance == 'cdf' else 'hist'}{n}, (select unnest(range(0, 101)) as a) group by all
),
best{n} as (
  select protocol, bag_size, bag_index, label, a / 100.0::double as p_pred from (
    select *, row_number() over (partition by protocol, bag_size, bag_index, label order by d, a) as r from mix{n}) where r = 1
)"""


_EVAL = f"""
with {BAGS_SQL},
evaluated as (select protocol, bag_size, bag_index, label, avg(is_true) as p_true, avg(is_pred) as p_pred from bags group by all)"""
_BANDS = "case label " + " ".join(f"when '{k}' then {len(v)}" for k, v in CLINICAL_RANGES.items()) + " else 0 end"
_ZONES = f"""{_EVAL},
zones as (
  select protocol, bag_size, bag_index, label, {zone_sql('label', 'p_true')} as true_zone, {zone_sql('label', 'p_pred')} as pred_zone, {_BANDS} as bands
  from evaluated where {_BANDS} >= 2
)"""
_ONE = f"with {SCORES_SQL}, one as (select * from scores where label = pred)"


def _uniform_bin(v: str, bins: int) -> str:
    edges = "[" + ", ".join(repr(i / bins) for i in range(bins + 1)) + "]::double[]"
    return f"greatest(0, least(len(list_filter({edges}, lambda e: e <= {v})) - 1, {bins - 1}))::int"


def _ece(source: str, keys: str, conf: str, hit: str, cell: str) -> str:
    return f"""{source},
curve as (select {keys}, {cell} as bin, count(*) as n, avg({conf}) as confidence, avg(({hit})::int) as accuracy from {{rows}} group by all)
select {keys}, round(sum(n * abs(accuracy - confidence)) / sum(n), 9) as ece from curve group by all"""


SQL = {
    "cc_estimate": f"with {BAGS_SQL} select protocol, bag_size, bag_index, label, round(raw, 9) as p_pred from cc",
    "pcc_estimate": f"with {BAGS_SQL} select protocol, bag_size, bag_index, label, round(raw, 12) as p_pred from pcc",
    "acc_estimate": f"""with {BAGS_SQL}
select protocol, bag_size, bag_index, label, round({_adjusted('raw', 'tpr', 'fpr')}, 9) as p_pred from cc join rates using (label)""",
    "pacc_estimate": f"""with {BAGS_SQL}
select protocol, bag_size, bag_index, label, round({_adjusted('raw', 'mu_pos', 'mu_neg')}, 9) as p_pred from pcc join rates using (label)""",
    "ovr_normalize": f"""with {BAGS_SQL},
raw as (select protocol, bag_size, bag_index, label, {_adjusted('raw', 'tpr', 'fpr')} as p from cc join rates using (label)),
sums as (select *, sum(p) over bag as s, count(*) over bag as k from raw window bag as (partition by protocol, bag_size, bag_index))
select protocol, bag_size, bag_index, label, round(case when s > 0 then p / s else 1.0::double / k end, 9) as p_pred from sums""",
    "threshold_x": _threshold("abs(fpr - (1 - tpr))"),
    "threshold_max": _threshold("fpr - tpr"),
    "threshold_t50": _threshold("abs(tpr - 0.5::double)"),
    "median_sweep": f"""
with {_ROC},
usable as (select * from roc where tpr - fpr > 0.25::double),
raw as (
  select protocol, bag_size, bag_index, b.label, u.step, avg((b.s >= u.step)::int) as raw, any_value(tpr) as tpr, any_value(fpr) as fpr
  from bag_steps b join usable u on b.label = u.label group by all
),
each as (select protocol, bag_size, bag_index, label, {_adjusted('raw', 'tpr', 'fpr')} as p from raw)
select protocol, bag_size, bag_index, c.label, round(coalesce(quantile_cont(e.p, 0.5), 0), 9) as p_pred
from cc c left join each e using (protocol, bag_size, bag_index, label) group by all""",
    "hdy_grid": f"""
with {BAGS_SQL}, {_match(5, 'hellinger', '5')}, {_match(10, 'hellinger', '10')}, {_match(20, 'hellinger', '20')},
every as (select * from best5 union all select * from best10 union all select * from best20)
select protocol, bag_size, bag_index, label, round(quantile_cont(p_pred, 0.5), 9) as p_pred from every group by all""",
    "dys_grid": f"with {BAGS_SQL}, {_match(10, 'topsoe', '')} select protocol, bag_size, bag_index, label, round(p_pred, 9) as p_pred from best",
    "forman_mm": f"with {BAGS_SQL}, {_match(20, 'cdf', '')} select protocol, bag_size, bag_index, label, round(p_pred, 9) as p_pred from best",
    "bag_truth": f"{_EVAL} select protocol, bag_size, bag_index, label, round(p_true, 9) as prevalence from evaluated",
    "abs_error_by_bag": f"{_EVAL} select protocol, bag_size, bag_index, round(avg(abs(p_true - p_pred)), 9) as ae from evaluated group by all",
    "zone_crossing_error": f"{_ZONES} select protocol, bag_size, bag_index, round(avg(abs(true_zone - pred_zone) / (bands - 1)::double), 9) as zce from zones group by all",
    "zone_report": f"{_ZONES} select protocol, bag_size, bag_index, label, true_zone, pred_zone, true_zone <> pred_zone as crossed from zones",
    "brier_score": f"""with {SCORES_SQL},
each as (select instance_id, split, sum((p - (y = label)::int) * (p - (y = label)::int)) as b from scores group by all)
select split, round(avg(b), 9) as brier from each group by split""",
    "ece_uniform": _ece(_ONE, "split", "conf", "y = pred", _uniform_bin("conf", 15)).format(rows="one"),
    "ece_quantile": f"""{_ONE},
edges as (
  select split, list_sort(list_distinct([0.0::double] || quantile_cont(conf, [{', '.join(f'{i}/15.0::double' for i in range(1, 15))}]) || [1.0::double])) as e
  from one group by split
),
curve as (
  select split, greatest(0, least(len(list_filter(e, lambda x: x <= conf)) - 1, len(e) - 2)) as bin, count(*) as n, avg(conf) as confidence, avg((y = pred)::int) as accuracy
  from one join edges using (split) group by all
)
select split, round(sum(n * abs(accuracy - confidence)) / sum(n), 9) as ece from curve group by split""",
    "classwise_ece": _ece(f"with {SCORES_SQL}", "split, label", "p", "y = label", _uniform_bin("p", 15)).format(rows="scores"),
    "reliability_curve": f"""{_ONE}
select split, {_uniform_bin('conf', 15)} as bin, count(*) as n, round(avg(conf), 9) as confidence, round(avg((y = pred)::int), 9) as accuracy from one group by all""",
    "log_loss_accuracy": f"""with {SCORES_SQL}
select split, round(avg(-ln(greatest(p, 1e-15::double))), 9) as log_loss, round(avg((pred = y)::int), 9) as accuracy from scores where label = y group by split""",
    "f1_accuracy": f"""{_ONE}
select split, round(2.0::double * sum((y = 'N' and pred = 'N')::int) / (2 * sum((y = 'N' and pred = 'N')::int) + sum((y <> 'N' and pred = 'N')::int)
  + sum((y = 'N' and pred <> 'N')::int)), 9) as f1, round(avg(((y = 'N') = (pred = 'N'))::int), 9) as accuracy from one group by split""",
    "bag_instances": f"""with {BAGS_SQL},
wide as (
  select instance_id, any_value(record_id) as record_id, any_value(y) as y, any_value(pred) as pred,
    {', '.join(f"max(p) filter (label = '{x}') as p_{x}" for x in LABELS)} from scores where split = 'test' group by instance_id
)
select protocol, bag_size, bag_index, pos, instance_id, record_id, y, pred, {', '.join(f'p_{x}' for x in LABELS)} from members join wide using (instance_id)""",
    "flat_outputs": f"""with {SCORES_SQL}
select instance_id, split, any_value(pred) as CENTROID_pred, {', '.join(f"(max(p) filter (label = '{x}'))::float as CENTROID_p_{x}" for x in LABELS)}
from scores group by instance_id, split""",
    "align_proba": f"""with {SCORES_SQL}
select instance_id, label, p from scores where split = 'test' union all
select distinct instance_id, 'F' as label, 0.0::double as p from scores where split = 'test'""",
}
