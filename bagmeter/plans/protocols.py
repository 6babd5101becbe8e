"""Queries on labels and bag protocols, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagmeter.config import CLINICAL, CLINICAL_RANGES, LABELS
from bagmeter.functions.rng import uniform_sql
from bagmeter.functions.text import canonical_id, known_id, strip_blanks
from bagmeter.functions.zones import find_zone, zone_sql
from bagmeter.operators import bags, labels, metrics, stats
from bagmeter.operators import scoring
from bagmeter.plans.quantify import SCORES_SQL, scores
from bagmeter.sources.scratch import stage
from bagmeter.sources.tables import table

SEED = CLINICAL.seed
_IN = "', '".join(LABELS)


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``instance_id``, ``record``, ``split``, ``source``, ``y`` of every beat, each once."""
    return (
        table(spark, sf_dir, "instances")
        .select("instance_id", canonical_id(F.col("record_id")).alias("record"), "split", "source", strip_blanks(F.col("y")).alias("y"))
        .dropDuplicates(["instance_id"])
    )


def symbol_filter(spark, sf_dir):
    return labels.keep_symbols(beats(spark, sf_dir), "y").select("instance_id", "record", "y")


def label_encode_binary(spark, sf_dir):
    return beats(spark, sf_dir).select("instance_id", labels.binary_label(F.col("y")).alias("y_bin"))


def label_index(spark, sf_dir):
    """Codes of the symbols in ascending order, from 0."""
    index = F.array_position(F.array(*map(F.lit, LABELS)), F.col("y")) - 1
    return symbol_filter(spark, sf_dir).select("instance_id", index.alias("code"))


def ovr_relabel(spark, sf_dir):
    """Number of beats and positives of each one-against-the-rest view."""
    views = F.explode(F.array(*map(F.lit, LABELS))).alias("target")
    kept = symbol_filter(spark, sf_dir).select("y", views)
    return kept.groupBy("target").agg(F.count("*").alias("n"), F.sum((F.col("y") == F.col("target")).cast("int")).alias("positives"))


def class_distribution(spark, sf_dir):
    out = labels.class_distribution(beats(spark, sf_dir).where("split is not null"), ["split"], "y")
    return out.withColumn("share", F.round("share", 9))


def patient_diversity(spark, sf_dir):
    patients = table(spark, sf_dir, "records").select(canonical_id(F.col("record_id")).alias("record"), known_id(F.col("patient_id")).alias("patient"))
    joined = beats(spark, sf_dir).where("split is not null and y is not null").join(patients, "record")
    return labels.patient_diversity(joined, ["split"], "y", "patient")


def class_balance_report(spark, sf_dir):
    out = labels.balance_report(beats(spark, sf_dir).where("split is not null"), "split", "y")
    return out.withColumn("percent", F.round("percent", 9))


def burden_from_prevalence(spark, sf_dir):
    truth = _truth(spark, sf_dir)
    return labels.burden(truth, ["protocol", "bag_size", "bag_index"], "label", "prevalence").withColumn("burden", F.round("burden", 9))


def label_coverage(spark, sf_dir):
    """Symbols that training or test lacks though the other has them."""
    held = beats(spark, sf_dir).where("y is not null")
    side = lambda s: held.where(F.col("split") == s).select("y").distinct()
    train, test = side("train"), side("test")
    lacks = lambda a, b, name: a.join(b, "y", "left_anti").withColumn("missing_in", F.lit(name))
    return lacks(train, test, "test").unionByName(lacks(test, train, "train"))


def leakage_check(spark, sf_dir):
    """Records with beats in training and in test."""
    held = beats(spark, sf_dir).where("record is not null")
    return held.where("split = 'train'").select("record").intersect(held.where("split = 'test'").select("record"))


def union_classes(spark, sf_dir):
    """Distinct symbols of training and test together."""
    held = beats(spark, sf_dir).where("y is not null")
    return held.where("split = 'train'").select("y").union(held.where("split = 'test'").select("y")).distinct()


def integrity_anti_join(spark, sf_dir):
    """Records that lack one of their companions: a signal, or any beat."""
    known = table(spark, sf_dir, "records").select(canonical_id(F.col("record_id")).alias("record"), F.col("signal").isNotNull().alias("has_signal"))
    no_beats = known.join(beats(spark, sf_dir).select("record").distinct(), "record", "left_anti").select("record", F.lit("beats").alias("lacks"))
    return known.where("not has_signal").select("record", F.lit("signal").alias("lacks")).unionByName(no_beats)


def record_listing(spark, sf_dir):
    """The first 100 records by name and their number of beats (the feature is the limit)."""
    first = table(spark, sf_dir, "records").select(canonical_id(F.col("record_id")).alias("record")).distinct().orderBy("record").limit(100)
    counts = beats(spark, sf_dir).groupBy("record").agg(F.count("*").alias("n"))
    return first.join(counts, "record", "left").select("record", F.coalesce("n", F.lit(0)).alias("n"))


def _truth(spark, sf_dir) -> DataFrame:
    """Asked prevalence of each bag and label, each once."""
    return (
        table(spark, sf_dir, "bag_prevalences")
        .withColumn("label", strip_blanks(F.col("label")))
        .withColumn("prevalence", F.coalesce("prevalence", F.col("n") / F.col("bag_size")))
        .groupBy("protocol", "bag_size", "bag_index", "label")
        .agg(F.max("prevalence").alias("prevalence"))
    )


def band_lookup(spark, sf_dir):
    return _truth(spark, sf_dir).select("protocol", "bag_size", "bag_index", "label", find_zone(F.col("label"), F.col("prevalence")).alias("band")).where("band is not null")


def largest_remainder(spark, sf_dir):
    """Whole counts of the asked shares, which are first made to add up to one and cut to 9 decimals."""
    keys = ["protocol", "bag_size", "bag_index"]
    truth = _truth(spark, sf_dir)
    total = truth.groupBy(*keys).agg(F.round(F.sum(F.round("prevalence", 6)), 6).alias("total")).where("total > 0")
    shares = truth.join(total, keys).withColumn("share", F.round(F.round("prevalence", 6) / F.col("total"), 9))
    return bags.largest_remainder(shares, keys, "label", "share", "bag_size").select(*keys, "label", "n")


def _bags(spark, sf_dir, protocol: str) -> DataFrame:
    """The bags that the table names for a protocol."""
    return table(spark, sf_dir, "bag_prevalences").where(F.col("protocol") == protocol).select("bag_size", "bag_index").distinct()


def capp_zone_pick(spark, sf_dir):
    return bags.zone_picks(_bags(spark, sf_dir, "C-APP")).withColumn("p_raw", F.round("p_raw", 9))


def capp_bag_truth(spark, sf_dir):
    return bags.capp_truth(_bags(spark, sf_dir, "C-APP")).withColumn("prevalence", F.round("prevalence", 9))


def app_bag_truth(spark, sf_dir):
    return bags.app_truth(_bags(spark, sf_dir, "APP")).withColumn("prevalence", F.round("prevalence", 9))


def _pool(spark, sf_dir) -> DataFrame:
    return symbol_filter_test(spark, sf_dir).select(F.col("y").alias("label"), "instance_id")


def symbol_filter_test(spark, sf_dir) -> DataFrame:
    return labels.keep_symbols(beats(spark, sf_dir).where("split = 'test'"), "y")


def bag_members_gather(spark, sf_dir):
    truth = bags.capp_truth(_bags(spark, sf_dir, "C-APP"))
    return bags.members(truth, _pool(spark, sf_dir), "instance_id")


def app_members_gather(spark, sf_dir):
    truth = bags.app_truth(_bags(spark, sf_dir, "APP"))
    pool = symbol_filter_test(spark, sf_dir).select(labels.binary_label(F.col("y")).alias("label"), "instance_id")
    return bags.members(truth, pool, "instance_id")


def capp_cc_summary(spark, sf_dir):
    """Flagship: draw bags within risk bands, classify and count, and report errors by bag size."""
    scored = scores(spark, sf_dir).where("split = 'test'").select("instance_id", "y", "pred")
    truth = bags.capp_truth(_bags(spark, sf_dir, "C-APP"))
    rows = bags.members(truth, scored.select(F.col("y").alias("label"), "instance_id", "pred"), "instance_id", carry=("pred",))
    sizes = [F.avg((F.col("pred") == x).cast("double")).alias(x) for x in LABELS]
    wide = rows.groupBy("bag_size", "bag_index").agg(*sizes)
    parts = F.array(*(F.struct(F.lit(x).alias("label"), F.col(x).alias("p_pred")) for x in LABELS))
    guess = wide.select("bag_size", "bag_index", F.explode(parts).alias("e")).select("bag_size", "bag_index", "e.label", "e.p_pred")
    true = truth.select("bag_size", "bag_index", "label", F.col("prevalence").alias("p_true"))
    both = stage(guess.join(true, ["bag_size", "bag_index", "label"]), "evaluated")  # read by both errors
    errors = metrics.absolute_error(both, bags.BAG).join(metrics.zone_crossing_error(both, bags.BAG), bags.BAG)
    out = stats.summary(errors.withColumnRenamed("ae", "mae"), ["bag_size"], ["mae", "zce"])
    return out.select("bag_size", *(F.round(c, 9).alias(c) for c in out.columns[1:]))


_FNS = (
    symbol_filter, label_encode_binary, label_index, ovr_relabel, class_distribution, patient_diversity, class_balance_report,
    burden_from_prevalence, label_coverage, leakage_check, union_classes, integrity_anti_join, record_listing, band_lookup, largest_remainder,
    capp_zone_pick, capp_bag_truth, app_bag_truth, bag_members_gather, app_members_gather, capp_cc_summary,
)
QUERIES = {f.__name__: f for f in _FNS}


def id_sql(c: str) -> str:
    bare, pattern = f"regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')", "'^([a-z]+)0*([0-9]+)$'"
    return (
        f"case when regexp_matches({bare}, {pattern}) then regexp_extract({bare}, {pattern}, 1) || '-' || "
        f"lpad(regexp_extract({bare}, {pattern}, 2), greatest(7, length(regexp_extract({bare}, {pattern}, 2))::int), '0') end"
    )


BEATS_SQL = f"""
beats as (
  select distinct on (instance_id) instance_id, {id_sql('record_id')} as record, split, source, trim(y, chr(32) || chr(9)) as y from instances
)"""
_TRUTH = """
truth as (
  select protocol, bag_size, bag_index, trim(label, chr(32) || chr(9)) as label, max(coalesce(prevalence, n / bag_size::double)) as prevalence
  from bag_prevalences group by all
)"""


def _band_rows() -> str:
    rows = []
    for label, bands in CLINICAL_RANGES.items():
        weights = CLINICAL.weights[label]
        upto = 0.0
        for zone, ((lo, hi), w) in enumerate(zip(bands, weights)):
            end = 1.0 if zone == len(bands) - 1 else upto + w / sum(weights)
            rows.append(f"('{label}', {zone}, {lo}::double, {hi}::double, {upto!r}::double, {end!r}::double)")
            upto += w / sum(weights)
    return "values " + ", ".join(rows)


_PICKS = f"""
bands(label, zone, lo, hi, from_w, to_w) as ({_band_rows()}),
bags as (select distinct bag_size, bag_index from bag_prevalences where protocol = 'C-APP'),
picks as (
  select bag_size, bag_index, label, zone, lo + (hi - lo) * {uniform_sql(SEED, "'p'", 'label', 'bag_size', 'bag_index')} as p_raw
  from bags, bands where from_w <= {uniform_sql(SEED, "'z'", 'label', 'bag_size', 'bag_index')} and {uniform_sql(SEED, "'z'", 'label', 'bag_size', 'bag_index')} < to_w
)"""
_CAPP = f"""{_PICKS},
capp_scaled as (
  select bag_size, bag_index, label, zone, case when sum(p_raw) over bag > 1 then p_raw / sum(p_raw) over bag else p_raw end as p
  from picks window bag as (partition by bag_size, bag_index)
),
capp_shares as (
  select * from capp_scaled union all
  select bag_size, bag_index, 'N', null, greatest(0.0::double, 1 - sum(p)) from capp_scaled group by bag_size, bag_index
),
capp_floors as (select *, floor(p * bag_size) as fl, p * bag_size - floor(p * bag_size) as frac from capp_shares),
capp as (
  select bag_size, bag_index, label, zone, (fl + (row_number() over (partition by bag_size, bag_index order by frac desc, label desc)
    <= bag_size - sum(fl) over (partition by bag_size, bag_index))::int)::int as n from capp_floors
)"""
_APP = f"""
app_bags as (
  select bag_size, bag_index, floor({uniform_sql(SEED, "'app'", 'bag_size', 'bag_index')} * bag_size)::int as pos
  from (select distinct bag_size, bag_index from bag_prevalences where protocol = 'APP')
),
app as (select bag_size, bag_index, 1 as label, pos as n from app_bags union all select bag_size, bag_index, 0, bag_size - pos from app_bags)"""


def _draw(truth: str, pool: str) -> str:
    """CTEs drawn(bag_size, bag_index, label, pos, instance_id)."""
    return f"""
pool as (
  select label, instance_id, row_number() over (partition by label order by instance_id) - 1 as rank, count(*) over (partition by label) as pool_n from ({pool})
),
places as (select bag_size, bag_index, label, unnest(range(0, n))::int as pos from {truth} where n > 0),
sizes as (select distinct label, pool_n from pool),
picked as (
  select bag_size, bag_index, label, pos, floor({uniform_sql(SEED, "'m'", 'bag_size', 'bag_index', 'label', 'pos')} * pool_n)::bigint as rank
  from places join sizes using (label)
),
drawn as (select bag_size, bag_index, label, pos, instance_id from picked join pool using (label, rank))"""


_TEST_POOL = f"select y as label, instance_id from beats where split = 'test' and y in ('{_IN}')"
_BANDS = "case label " + " ".join(f"when '{k}' then {len(v)}" for k, v in CLINICAL_RANGES.items()) + " else 0 end"

SQL = {
    "symbol_filter": f"with {BEATS_SQL} select instance_id, record, y from beats where y in ('{_IN}')",
    "label_encode_binary": f"with {BEATS_SQL} select instance_id, coalesce((y = 'N')::int, 0) as y_bin from beats",
    "label_index": f"with {BEATS_SQL} select instance_id, list_position(['{_IN}'], y) - 1 as code from beats where y in ('{_IN}')",
    "ovr_relabel": f"""with {BEATS_SQL}
select target, count(*) as n, sum((y = target)::int)::bigint as positives from beats, (select unnest(['{_IN}']) as target) where y in ('{_IN}') group by target""",
    "class_distribution": f"""with {BEATS_SQL}
select split, y, count(*) as n, round(count(*) / sum(count(*)) over (partition by split)::double, 9) as share from beats where split is not null group by split, y""",
    "patient_diversity": f"""with {BEATS_SQL},
recs as (select {id_sql('record_id')} as record, {id_sql('patient_id')} as patient from records)
select split, y, count(distinct case when not regexp_matches(patient, '-(0+|9999999)$') then patient end) as patients,
  count(distinct case when not regexp_matches(patient, '-(0+|9999999)$') then patient end) < 3 as few
from beats join recs using (record) where split is not null and y is not null group by split, y""",
    "class_balance_report": f"""with {BEATS_SQL},
expected as (select distinct split, unnest(['{_IN}']) as label from beats where split is not null),
counts as (select split, y as label, count(*) as n from beats where y in ('{_IN}') group by all)
select e.split, e.label, coalesce(n, 0) as n, round(coalesce(n, 0) * 100.0::double / sum(coalesce(n, 0)) over (partition by e.split), 9) as percent,
  coalesce(n, 0) < 30 as low, coalesce(n, 0) = 0 as missing from expected e left join counts c on e.split = c.split and e.label = c.label""",
    "burden_from_prevalence": f"""with {_TRUTH}
select protocol, bag_size, bag_index, round(1 - max(prevalence), 9) as burden from truth where label = 'N' group by all""",
    "label_coverage": f"""with {BEATS_SQL},
tr as (select distinct y from beats where split = 'train' and y is not null), te as (select distinct y from beats where split = 'test' and y is not null)
select y, 'test' as missing_in from (select y from tr except select y from te) union all select y, 'train' from (select y from te except select y from tr)""",
    "leakage_check": f"""with {BEATS_SQL}
select record from beats where split = 'train' and record is not null intersect select record from beats where split = 'test'""",
    "union_classes": f"with {BEATS_SQL} select distinct y from beats where split in ('train', 'test') and y is not null",
    "integrity_anti_join": f"""with {BEATS_SQL}, recs as (select {id_sql('record_id')} as record, signal from records)
select record, 'signal' as lacks from recs where signal is null union all
select record, 'beats' from recs where record not in (select record from beats where record is not null)""",
    "record_listing": f"""with {BEATS_SQL}, recs as (select distinct {id_sql('record_id')} as record from records order by 1 limit 100)
select r.record, count(b.instance_id) as n from recs r left join beats b on r.record = b.record group by r.record""",
    "band_lookup": f"""with {_TRUTH}
select * from (select protocol, bag_size, bag_index, label, {zone_sql('label', 'prevalence')} as band from truth) where band is not null""",
    "largest_remainder": f"""with {_TRUTH},
rounded as (select protocol, bag_size, bag_index, label, round(prevalence, 6) as q from truth),
shares as (
  select *, round(q / round(sum(q) over bag, 6), 9) as share from rounded
  window bag as (partition by protocol, bag_size, bag_index) qualify round(sum(q) over bag, 6) > 0
),
floors as (select *, floor(share * bag_size) as fl, share * bag_size - floor(share * bag_size) as frac from shares)
select protocol, bag_size, bag_index, label, (fl + (row_number() over (partition by protocol, bag_size, bag_index order by frac desc, label desc)
  <= bag_size - sum(fl) over (partition by protocol, bag_size, bag_index))::int)::int as n from floors""",
    "capp_zone_pick": f"with {_PICKS} select bag_size, bag_index, label, zone, round(p_raw, 9) as p_raw from picks",
    "capp_bag_truth": f"with {_CAPP} select bag_size, bag_index, label, zone, n, round(n / bag_size::double, 9) as prevalence from capp",
    "app_bag_truth": f"with {_APP} select bag_size, bag_index, label, n, round(n / bag_size::double, 9) as prevalence from app",
    "bag_members_gather": f"with {BEATS_SQL}, {_CAPP}, {_draw('capp', _TEST_POOL)} select * from drawn",
    "app_members_gather": f"""with {BEATS_SQL}, {_APP},
{_draw('app', f"select (y = 'N')::int as label, instance_id from beats where split = 'test' and y in ('{_IN}')")} select * from drawn""",
    "capp_cc_summary": f"""
with {SCORES_SQL}, {_CAPP},
{_draw('capp', "select distinct y as label, instance_id from scores where split = 'test'")},
preds as (select distinct instance_id, pred from scores where split = 'test'),
labels as (select unnest(['{_IN}']) as label),
guess as (
  select bag_size, bag_index, l.label, avg((pred = l.label)::int) as p_pred from drawn d join preds using (instance_id), labels l group by all
),
paired as (select g.*, n / bag_size::double as p_true from guess g join capp using (bag_size, bag_index, label)),
ae as (select bag_size, bag_index, avg(abs(p_true - p_pred)) as mae from paired group by all),
zce as (
  select bag_size, bag_index, avg(abs(({zone_sql('label', 'p_true')}) - ({zone_sql('label', 'p_pred')})) / ({_BANDS} - 1)::double) as zce
  from paired where {_BANDS} >= 2 group by all
)
select bag_size, round(avg(mae), 9) as mae_mean, round(stddev_samp(mae), 9) as mae_std, round(avg(zce), 9) as zce_mean, round(stddev_samp(zce), 9) as zce_std
from ae join zce using (bag_size, bag_index) group by bag_size""",
}
