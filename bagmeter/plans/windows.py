"""Queries on timelines, segmentation and group splits, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from bagmeter.config import LABELS
from bagmeter.functions.ranks import running_sum
from bagmeter.functions.rng import uniform_sql
from bagmeter.functions.text import canonical_id
from bagmeter.operators import segment, split, timeline
from bagmeter.plans.protocols import BEATS_SQL, beats, id_sql
from bagmeter.plans.quantify import SCORES_SQL, scores
from bagmeter.sources.tables import table

#: Event types in the role of beat symbols.
SYMBOLS = {"view": "N", "purchase": "V", "click": "A", "error": "L", "signup": "R"}
#: Rows of a tumbling window; width of a cut window; least height of a peak.
WINDOW, WIDTH, PEAK = 30, 16, 0.8


def _micros():
    return F.unix_micros(F.col("ts").cast("timestamp"))


def _events(spark, sf_dir):
    symbol = F.lit(None).cast("string")
    for k, v in SYMBOLS.items():
        symbol = F.when(F.col("event_type") == k, F.lit(v)).otherwise(symbol)
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", symbol.alias("symbol"), "value")


def tumbling_window_prevalence(spark, sf_dir):
    rows = timeline.tumbling(_events(spark, sf_dir), "user_id", _micros(), ["event_id"], WINDOW)
    return timeline.window_share(rows, ["user_id", "window_at"], F.col("symbol") == "N").withColumn("share", F.round("share", 9))


def cumulative_error(spark, sf_dir):
    """Running sum of |true - estimated| share of N over tumbling windows of each record's beats."""
    held = scores(spark, sf_dir).where("split = 'test'").select(canonical_id(F.col("record_id")).alias("record"), "instance_id", "y", "pred")
    rows = timeline.tumbling(held, "record", F.col("instance_id"), [], WINDOW)
    truth, guess = F.avg((F.col("y") == "N").cast("double")), F.avg((F.col("pred") == "N").cast("double"))
    errors = rows.groupBy("record", "window_at").agg(F.round(F.abs(truth - guess), 9).alias("ae"))
    out = running_sum(errors, ["record"], "window_at", "ae", "total")
    return out.withColumn("total", F.round("total", 9))


def most_diverse_window(spark, sf_dir):
    return timeline.most_diverse_window(_events(spark, sf_dir), "user_id", _micros(), ["event_id"], "symbol", list(LABELS), WINDOW).withColumns(
        {c: F.col(c).cast("int") for c in ("first_at", "last_at")}
    )


def _peaks(spark, sf_dir):
    records = table(spark, sf_dir, "records").where("signal is not null and size(signal) >= 3 and forall(signal, v -> v is not null and not isnan(v))")
    return records.select("record_id", "signal", segment.peaks(F.col("signal"), PEAK).alias("samples"))


def signal_peaks(spark, sf_dir):
    return _peaks(spark, sf_dir).select("record_id", F.posexplode("samples").alias("ann_idx", "sample"))


def beat_segment_bounds(spark, sf_dir):
    rows = _peaks(spark, sf_dir).select("record_id", F.size("signal").alias("length"), F.explode("samples").alias("sample"))
    return timeline.segment_bounds(rows, "record_id", "sample", "length", 8)


def _segments(spark, sf_dir, length, normalize):
    rows = segment.windows(_peaks(spark, sf_dir), ["record_id"], "signal", "samples", WIDTH, length, normalize)
    return rows.select("record_id", "ann_idx", F.posexplode("segment").alias("i", "v")).select("record_id", "ann_idx", "i", F.round("v", 9).alias("v"))


def segment_pad(spark, sf_dir):
    return _segments(spark, sf_dir, "pad", "none")


def segment_interpolate(spark, sf_dir):
    return _segments(spark, sf_dir, "interpolate", "none")


def segment_zscore(spark, sf_dir):
    return _segments(spark, sf_dir, "pad", "zscore")


def segment_minmax(spark, sf_dir):
    return _segments(spark, sf_dir, "pad", "minmax")


def group_split_hash(spark, sf_dir):
    return split.hash_split(beats(spark, sf_dir), "record", 0.3)


def _labelled(spark, sf_dir):
    return beats(spark, sf_dir).where(F.col("y").isin(*LABELS))


def group_split_stratified(spark, sf_dir):
    return split.stratified_split(_labelled(spark, sf_dir), "record", "y", 0.3, seed=0)


def group_folds_stratified(spark, sf_dir):
    return split.stratified_folds(_labelled(spark, sf_dir), "record", "y", 5, seed=0)


def group_split_guaranteed(spark, sf_dir):
    sides, seed = split.guaranteed_split(_labelled(spark, sf_dir), "record", "y", 0.3)
    return sides.withColumn("seed", F.lit(seed))


def row_folds_hash(spark, sf_dir):
    """Folds of single rows by hash; records leak across them, which is what this form is for."""
    from bagmeter.functions.rng import uniform

    return beats(spark, sf_dir).select("instance_id", F.floor(uniform(42, "fold", F.col("instance_id")) * 5).cast("int").alias("fold"))


def class_block_folds(spark, sf_dir):
    rows = _labelled(spark, sf_dir).where("split = 'train'")
    return split.class_folds(rows, "y", "instance_id", 10).select("instance_id", "y", "fold")


_FNS = (
    tumbling_window_prevalence, cumulative_error, most_diverse_window, signal_peaks, beat_segment_bounds, segment_pad, segment_interpolate,
    segment_zscore, segment_minmax, group_split_hash, group_split_stratified, group_folds_stratified, group_split_guaranteed, row_folds_hash,
    class_block_folds,
)
QUERIES = {f.__name__: f for f in _FNS}

_SYMBOL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in SYMBOLS.items()) + " end"
_EVENTS = f"events_ as (select user_id, event_id, ts, {_SYMBOL} as symbol from events)"
_PEAKS = f"""
recs as (
  select record_id, signal, range(1, len(signal) - 1) as inner_at from records
  where signal is not null and len(signal) >= 3 and len(list_filter(signal, lambda v: v is not null and not isnan(v))) = len(signal)
),
samples as (
  select record_id, signal, list_filter(inner_at, lambda i: signal[i + 1] > {PEAK}::double and signal[i + 1] > signal[i] and signal[i + 1] >= signal[i + 2]) as samples
  from recs
),
ann as (
  select record_id, signal, unnest(samples)::int as sample, generate_subscripts(samples, 1)::int - 1 as ann_idx from samples
),
raw as (
  select record_id, ann_idx, sample, signal[greatest(sample - {WIDTH // 2}, 0) + 1 : greatest(sample - {WIDTH // 2}, 0) + {WIDTH}] as seg from ann
),
padded as (select record_id, ann_idx, seg || list_resize([]::double[], {WIDTH} - len(seg), 0.0::double) as seg from raw)"""
_CLASSES = [f"count(*) filter (symbol = '{c}') over frame as n{i}" for i, c in enumerate(LABELS)]
_TOTAL = "(" + " + ".join(f"n{i}" for i in range(len(LABELS))) + ")"
_ENTROPY = " + ".join(f"case when n{i} > 0 then n{i} / {_TOTAL}::double * ln(n{i} / {_TOTAL}::double + 1e-12::double) else 0.0::double end" for i in range(len(LABELS)))
_DISTINCT = " + ".join(f"(n{i} > 0)::int" for i in range(len(LABELS)))
_UNNEST = "unnest(seg) as v, generate_subscripts(seg, 1)::int - 1 as i"

SQL = {
    "tumbling_window_prevalence": f"""with {_EVENTS},
placed as (select user_id, symbol, floor((row_number() over (partition by user_id order by ts, event_id) - 1) / {WINDOW})::int as window_at from events_)
select user_id, window_at, count(*) as n, round(avg((symbol = 'N')::int), 9) as share from placed group by all""",
    "cumulative_error": f"""with {SCORES_SQL},
held as (select {id_sql('record_id')} as record, instance_id, y, pred from scores where split = 'test' and label = pred),
placed as (select *, floor((row_number() over (partition by record order by instance_id) - 1) / {WINDOW})::int as window_at from held),
errors as (select record, window_at, round(abs(avg((y = 'N')::int) - avg((pred = 'N')::int)), 9) as ae from placed group by all)
select record, window_at, ae, round(sum(ae) over (partition by record order by window_at), 9) as total from errors""",
    "most_diverse_window": f"""with {_EVENTS},
counts as (
  select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, count(*) over frame as k, {', '.join(_CLASSES)}
  from events_ window frame as (partition by user_id order by ts, event_id rows between current row and {WINDOW - 1} following)
),
scored as (
  select user_id, pos, case when {_TOTAL} > 0 then round({_DISTINCT} - ({_ENTROPY}) / {math.log(WINDOW)!r}::double, 9) else -1.0::double end as score from counts where k = {WINDOW}
)
select user_id, pos::int as first_at, (pos + {WINDOW - 1})::int as last_at, score from (
  select *, row_number() over (partition by user_id order by score desc, pos) as r from scored) where r = 1""",
    "signal_peaks": f"with {_PEAKS} select record_id, ann_idx, sample from ann",
    "beat_segment_bounds": f"""with {_PEAKS}
select record_id, len(signal)::int as length, sample,
  coalesce(floor((lag(sample) over rec + sample) / 2.0::double), greatest(0, sample - 8))::int as seg_start,
  coalesce(floor((sample + lead(sample) over rec) / 2.0::double), least(len(signal), sample + 8))::int as seg_end
from ann window rec as (partition by record_id order by sample)""",
    "segment_pad": f"with {_PEAKS} select record_id, ann_idx, i, round(v, 9) as v from (select record_id, ann_idx, {_UNNEST} from padded)",
    "segment_interpolate": f"""with {_PEAKS},
points as (select record_id, ann_idx, seg, unnest(range(0, {WIDTH}))::int as i from raw),
places as (select *, i * (len(seg) - 1) / {float(WIDTH - 1)}::double as x from points),
near as (select *, least(floor(x)::int, len(seg) - 1) as f from places)
select record_id, ann_idx, i, round(seg[f + 1] + (seg[least(f + 1, len(seg) - 1) + 1] - seg[f + 1]) * (x - f), 9) as v from near""",
    "segment_zscore": f"""with {_PEAKS},
flat as (select record_id, ann_idx, {_UNNEST} from padded)
select record_id, ann_idx, i, round((v - avg(v) over seg) / (stddev_pop(v) over seg + 1e-8::double), 9) as v from flat window seg as (partition by record_id, ann_idx)""",
    "segment_minmax": f"""with {_PEAKS},
flat as (select record_id, ann_idx, {_UNNEST} from padded)
select record_id, ann_idx, i, round((v - min(v) over seg) / (max(v) over seg - min(v) over seg + 1e-8::double), 9) as v from flat window seg as (partition by record_id, ann_idx)""",
    "group_split_hash": f"""with {BEATS_SQL},
groups as (select distinct record, {uniform_sql(42, "'group'", 'record')} as u from beats where record is not null)
select record, case when row_number() over (order by u, record) <= ceil(0.3::double * count(*) over ()) then 'test' else 'train' end as side from groups""",
    "row_folds_hash": f"with {BEATS_SQL} select instance_id, floor({uniform_sql(42, chr(39) + 'fold' + chr(39), 'instance_id')} * 5)::int as fold from beats",
    "class_block_folds": f"""with {BEATS_SQL}
select instance_id, y, (ntile(10) over (partition by y order by instance_id) - 1)::int as fold from beats where split = 'train' and y in ('{"', '".join(LABELS)}')""",
}
