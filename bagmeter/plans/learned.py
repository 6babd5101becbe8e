"""Queries on iterative estimators, trained classifiers and calibration, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagmeter.config import LABELS
from bagmeter.operators import calibration as cal
from bagmeter.operators import estimators as est
from bagmeter.operators import iterative, metrics, scoring
from bagmeter.plans.quantify import BAG, BAGS_SQL, SCORES_SQL, _ece, _uniform_bin, bag_rows, instances, long_bags, members, out_of_fold, scores
from bagmeter.sources.scratch import stage

#: Rounds of the EM that is compared with SQL.
ROUNDS = 10
FOLDS = [0, 1, 2, 3, 4]


def _parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    scored = scores(spark, sf_dir)
    return scored.where("split = 'train'"), bag_rows(spark, sf_dir, scored)


def _featured(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Training rows and bag members with their feature vectors."""
    rows = instances(spark, sf_dir).select("instance_id", "split", "fold", "y", "features")
    return rows.where("split = 'train'"), members(spark, sf_dir).join(rows.where("split = 'test'").select("instance_id", "features"), "instance_id")


def _rounded(df: DataFrame) -> DataFrame:
    """Solvers stop within a tolerance, so five decimals are kept."""
    return df.withColumn("p_pred", F.round("p_pred", 5))


def gac(spark, sf_dir):
    return _rounded(iterative.mixture(*_parts(spark, sf_dir), BAG, "hard"))


def gpac(spark, sf_dir):
    return _rounded(iterative.mixture(*_parts(spark, sf_dir), BAG, "soft"))


def fm(spark, sf_dir):
    return _rounded(iterative.mixture(*_parts(spark, sf_dir), BAG, "prior"))


def emq(spark, sf_dir):
    return _rounded(iterative.emq(*_parts(spark, sf_dir), BAG))


def emq_fixed_iterations(spark, sf_dir):
    train, bags = _parts(spark, sf_dir)
    prior = iterative.class_matrix(train, "p")[1]
    return iterative.emq_fixed(bags, BAG, list(prior), ROUNDS).withColumn("p_pred", F.round("p_pred", 9))


def cde(spark, sf_dir):
    scored = scores(spark, sf_dir)
    rates = est.rates(out_of_fold(scored)).select("label", "prior", "tpr", "fpr")
    return iterative.cde(long_bags(bag_rows(spark, sf_dir, scored)).select(*BAG, "label", "p"), rates, BAG).withColumn("p_pred", F.round("p_pred", 6))


def hdx(spark, sf_dir):
    return _rounded(iterative.hdx(*_featured(spark, sf_dir), BAG, "features", scoring.WIDTH))


def readme(spark, sf_dir):
    return _rounded(iterative.readme(*_featured(spark, sf_dir), BAG, "features", scoring.WIDTH))


def energy_distance(spark, sf_dir):
    return _rounded(iterative.energy_distance(*_featured(spark, sf_dir), BAG, "features"))


def discretized_features(spark, sf_dir):
    """Rows per quantile bin of each feature; the edges come from the training rows only."""
    rows = instances(spark, sf_dir).select("split", "features")
    edges = iterative.feature_edges(rows.where("split = 'train'"), "features", scoring.WIDTH, 8)
    binned = rows.select("split", F.posexplode(iterative.discretized("features", edges)).alias("feature", "bin"))
    return binned.groupBy("split", "feature", "bin").agg(F.count("*").alias("n"))


def _trained(kind: str, label: str = "N"):
    def query(spark, sf_dir):
        rows = instances(spark, sf_dir)
        return scoring.one_vs_rest_scores(rows, kind, label, len(FOLDS), ["instance_id", "split", "y"])

    return query


def oof_scores_multinomial(spark, sf_dir):
    out = scoring.multinomial_scores(instances(spark, sf_dir), LABELS, len(FOLDS), ["instance_id", "split", "y"])
    return out.withColumn("pred", scoring.argmax("p"))


def scores_knn(spark, sf_dir):
    return scoring.knn_scores(instances(spark, sf_dir), ["instance_id", "split", "y"])


def _calibration_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    scored = scores(spark, sf_dir)
    long = scoring.long_scores(scored, ["instance_id", "split", "fold", "y"]).withColumn("is_true", (F.col("y") == F.col("label")).cast("int"))
    return long.where("split = 'train'"), long.where("split = 'test'")


def _calibrated_error(df: DataFrame) -> DataFrame:
    """Classwise calibration error of the mapped scores."""
    from bagmeter.functions.arrays import uniform_edges

    curve = metrics.reliability(df, ["label"], F.col("q"), F.col("is_true"), uniform_edges(15))
    return metrics.calibration_error(curve, ["label"]).withColumn("ece", F.round("ece", 6))


def platt(spark, sf_dir):
    train, test = _calibration_rows(spark, sf_dir)
    return _calibrated_error(cal.normalized_scores(cal.apply_platt(test, ["label"], cal.fit_platt(train, ["label"])), "instance_id"))


def isotonic(spark, sf_dir):
    train, test = _calibration_rows(spark, sf_dir)
    out = None
    for label in LABELS:
        part = cal.isotonic(train, test, label)
        out = part if out is None else out.unionByName(part)
    return _calibrated_error(cal.normalized_scores(out, "instance_id"))


def temperature(spark, sf_dir):
    scored = scores(spark, sf_dir)
    place = F.array_position(F.array(*map(F.lit, LABELS)), F.col("y")).cast("int")
    t = cal.fit_temperature(scored.where("split = 'train'"), "p", place)
    out = scored.where("split = 'test'").withColumn("p", cal.tempered(F.col("p"), t))
    long = scoring.long_scores(out, ["y"]).select("label", F.col("p").alias("q"), (F.col("y") == F.col("label")).cast("int").alias("is_true"))
    return _calibrated_error(long).withColumn("temperature", F.lit(round(float(t), 6)))


def cross_fit(spark, sf_dir):
    train, _ = _calibration_rows(spark, sf_dir)
    return _calibrated_error(cal.normalized_scores(cal.cross_fitted(train, FOLDS), "instance_id"))


def fold_average(spark, sf_dir):
    """Test scores averaged over the models that leave out one fold each."""
    rows = instances(spark, sf_dir)
    models = stage(scoring.centroids(rows.where("split = 'train'").select("fold", "y", "features")), "models")
    folds = [r["fold"] for r in models.where("fold >= 0").select("fold").collect()]
    each = rows.where("split = 'test'").select("instance_id", F.lit("train").alias("split"), F.explode(F.array(*map(F.lit, sorted(folds)))).alias("fold"), "features")
    long = scoring.long_scores(scoring.centroid_scores(each, models), ["instance_id", "fold"])
    return cal.fold_average(long, ["instance_id", "label"], "p").withColumn("p", F.round("p", 9))


_FNS = (
    gac, gpac, fm, emq, emq_fixed_iterations, cde, hdx, readme, energy_distance, discretized_features, oof_scores_multinomial, scores_knn, platt, isotonic,
    temperature, cross_fit, fold_average,
)
QUERIES = {f.__name__: f for f in _FNS} | {f"oof_scores_{k.lower()}": _trained(k) for k in scoring.CLASSIFIERS}

_ROUNDS = ",\n".join(
    f"""
w{r} as (
  select u.*, u.p * g / greatest(prior, 1e-12::double) as w from units u join g{r - 1} using (protocol, bag_size, bag_index, label)
),
t{r} as (select *, w / sum(w) over (partition by protocol, bag_size, bag_index, pos, instance_id) as s from w{r}),
g{r} as (select protocol, bag_size, bag_index, label, avg(s) as g from t{r} group by all)"""
    for r in range(1, ROUNDS + 1)
)
SQL = {
    "emq_fixed_iterations": f"""
with {SCORES_SQL},
priors as (select y as label, count(*) / sum(count(*)) over () as prior from (select distinct instance_id, y from scores where split = 'train') group by y),
drawn as (select distinct protocol, bag_size, bag_index, pos, instance_id from bag_members where instance_id is not null),
units as (
  select protocol, bag_size, bag_index, pos, instance_id, label, p, prior from drawn join scores using (instance_id) join priors using (label) where split = 'test'
),
g0 as (select distinct protocol, bag_size, bag_index, label, prior as g from units),
{_ROUNDS}
select protocol, bag_size, bag_index, label, round(g, 9) as p_pred from g{ROUNDS}""",
    "discretized_features": f"""
with {SCORES_SQL},
flat as (select split, unnest(features) as v, generate_subscripts(features, 1)::int - 1 as feature from inst),
edges as (
  select feature, list_distinct(quantile_cont(v, [{', '.join(f'{i / 8}' for i in range(1, 8))}])) as e from flat where split = 'train' group by feature
)
select split, feature, len(list_filter(e, lambda x: x <= v))::int as bin, count(*) as n from flat join edges using (feature) group by all""",
    "fold_average": f"""
with {SCORES_SQL},
each as (
  select instance_id, m, label, exp(-0.5 * list_sum(list_transform(list_zip(features, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as w
  from inst join models on m >= 0 where split = 'test'
),
parts as (select instance_id, m, label, round(w / sum(w) over (partition by instance_id, m), 6) as p from each)
select instance_id, label, round(avg(p), 9) as p from parts group by instance_id, label""",
}

SQL["emq"] = f"""
with recursive {SCORES_SQL},
priors as (select y as label, greatest(count(*) / sum(count(*)) over (), 1e-12::double) as prior from (select distinct instance_id, y from scores where split = 'train') group by y),
prior as (select list(label order by label) as names, list(prior order by label) as safe from priors),
drawn as (select distinct protocol, bag_size, bag_index, pos, instance_id from bag_members where instance_id is not null),
vectors as (select instance_id, list(p order by label) as p from scores where split = 'test' and label in (select label from priors) group by instance_id),
bags as (select protocol, bag_size, bag_index, list(p) as ps from drawn join vectors using (instance_id) group by all),
rounds as (
  select protocol, bag_size, bag_index, ps, list_transform(safe, lambda x: x / list_sum(safe)) as g, 0 as i, false as done from bags, prior
  union all
  select protocol, bag_size, bag_index, ps, f, i + 1, list_max(list_transform(list_zip(f, g), lambda z: abs(z[1] - z[2]))) < 1e-8::double
  from (
    select r.*, list_transform(range(1, len(safe) + 1), lambda j: list_avg(list_transform(ps, lambda v:
      v[j] * g[j] / safe[j] / list_sum(list_transform(range(1, len(safe) + 1), lambda k: v[k] * g[k] / safe[k]))))) as f
    from rounds r, prior where not done and i < 1000
  )
),
last as (select * from rounds qualify row_number() over (partition by protocol, bag_size, bag_index order by i desc) = 1)
select protocol, bag_size, bag_index, unnest(names) as label, round(unnest(g), 5) as p_pred from last, prior"""
SQL["cde"] = f"""
with recursive {BAGS_SQL},
priors as (select label, avg(is_true) as prior from oof group by label),
held as (select protocol, bag_size, bag_index, label, list(p) as ps from bags group by all),
start as (select h.*, prior, coalesce(tpr, 0) as tpr, coalesce(fpr, 0) as fpr from held h join rates using (label) join priors using (label)),
rounds as (
  select *, prior::double as share, 0 as i, false as done from start
  union all
  select protocol, bag_size, bag_index, label, ps, prior, tpr, fpr, fresh, i + 1, abs(fresh - share) < 1e-6::double
  from (
    select *, 0.5::double * (share + case when tpr <> fpr then least(1::double, greatest(0::double, (above - fpr) / (tpr - fpr))) else above end) as fresh
    from (
      select *, len(list_filter(ps, lambda x: x >= ratio / (1 + ratio))) / len(ps)::double as above
      from (select *, (1 - share) / greatest(share, 1e-12::double) * prior / greatest(1 - prior, 1e-12::double) as ratio from rounds where not done and i < 100)
    )
  )
)
select protocol, bag_size, bag_index, label, round(share, 6) as p_pred from rounds
qualify row_number() over (partition by protocol, bag_size, bag_index, label order by i desc) = 1"""


def _platt_sql(keys: str, fit: str) -> str:
    """CTEs ending in fits (keys, a, b): Newton steps, short ones first, on counts per score cell; ``fit`` has keys, p, is_true."""
    each = lambda term: f"list_sum(list_transform(cells, lambda z: {term}))"
    q = "(1 / (1 + exp(a * z.p + b)))"
    d1, d2 = f"((z.pos * hi + z.neg * lo) - (z.pos + z.neg) * {q})", f"((z.pos + z.neg) * {q} * (1 - {q}))"
    return f"""
reduced as (select {keys}, round(p * 4000) / 4000 as p, sum(is_true)::double as pos, sum(1 - is_true)::double as neg from ({fit}) group by {keys}, round(p * 4000) / 4000),
packed as (
  select {keys}, list({{'p': p, 'pos': pos, 'neg': neg}}) as cells, (sum(pos) + 1) / (sum(pos) + 2) as hi, 1 / (sum(neg) + 2) as lo, ln((sum(neg) + 1) / (sum(pos) + 1)) as b0
  from reduced group by {keys}
),
steps as (
  select {keys}, cells, hi, lo, 0::double as a, b0 as b, 0 as i from packed
  union all
  select {keys}, cells, hi, lo, a - pace * (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b - pace * (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12), i + 1
  from (
    select *, case when i < 40 then 0.25::double else 1 end as pace, {each(f'z.p * {d1}')} as g1, {each(d1)} as g2, {each(f'z.p * z.p * {d2}')} + 1e-12::double as h11, {each(f'z.p * {d2}')} as h12, {each(d2)} + 1e-12::double as h22
    from steps where i < 50
  )
),
fits as (select {keys}, a, b from steps where i = 50),"""


_TRUTH = "(y = label)::int as is_true"
_MAPPED = "mapped as (select m.*, 1 / (1 + exp(a * p + b)) as raw from ({rows}) m join fits using ({keys}))"
_NORMAL = "normal as (select *, case when sum(raw) over unit > 0 then raw / sum(raw) over unit else 1 / count(*) over unit end as q from mapped window unit as (partition by instance_id))"


def _calibrated_sql(keys: str, fit: str, rows: str) -> str:
    before = f"with recursive {SCORES_SQL}," + _platt_sql(keys, fit) + _MAPPED.format(rows=rows, keys=keys) + ", " + _NORMAL
    return _ece(before, "label", "q", "is_true = 1", _uniform_bin("q", 15)).replace("{rows}", "normal").replace(", 9) as ece", ", 6) as ece")


SQL["platt"] = _calibrated_sql("label", f"select label, p, {_TRUTH} from scores where split = 'train'", f"select instance_id, label, p, {_TRUTH} from scores where split = 'test'")
SQL["cross_fit"] = _calibrated_sql(
    "fold, label",
    f"select f.m as fold, label, p, {_TRUTH} from scores s join (select m from folds where m >= 0) f on s.fold <> f.m where split = 'train'",
    f"select instance_id, fold, label, p, {_TRUTH} from scores where split = 'train'",
)

_POWERS = "list_transform(ps, lambda x: pow(greatest(x, 1e-12::double), exp(-t)))"
_TRIES = ""
for _r in range(1, 6):
    _TRIES += f"""
tried{_r} as (select i, lo, hi, lo + i * (hi - lo) / 14::double as t from span{_r - 1}, (select unnest(range(15)) as i)),
loss{_r} as (
  select i, any_value(lo) as lo, any_value(hi) as hi, any_value(t) as t, avg(-ln(greatest(w[k] / list_sum(w), 1e-15::double))) as l
  from (select i, lo, hi, t, k, {_POWERS} as w from whole, tried{_r}) group by i
),
span{_r} as (select t - (hi - lo) / 14::double as lo, t + (hi - lo) / 14::double as hi, t from loss{_r} order by l, i limit 1),"""
_TEMPERED = f"""
with {SCORES_SQL},
whole as (
  select list(p order by label) as ps, list_position(list(label order by label), any_value(y)) as k from scores where split = 'train' group by instance_id
),
span0 as (select ln(0.05::double) as lo, ln(20.0::double) as hi),{_TRIES}
cooled as (select instance_id, label, y, pow(greatest(p, 1e-12::double), 1 / exp(t)) as w, round(exp(t), 6) as temperature from scores, span5 where split = 'test'),
normal as (select label, y, temperature, w / sum(w) over (partition by instance_id) as q from cooled)"""
SQL["temperature"] = (
    _ece(_TEMPERED, "label, temperature", "q", "y = label", _uniform_bin("q", 15)).replace("{rows}", "normal").replace(", 9) as ece", ", 6) as ece")
)

_K = f"range(1, {len(LABELS) + 1})"
_KEY = "protocol, bag_size, bag_index"
_TESTED = f"""
drawn as (select distinct {_KEY}, pos, instance_id from bag_members where instance_id is not null),
prior as (select list(coalesce(n, 0) / total::double order by label) as g from (
  select l.label, count(s.instance_id) as n, sum(count(s.instance_id)) over () as total
  from (select unnest(['{"', '".join(sorted(LABELS))}']) as label) l left join scores s on s.y = l.label and s.label = l.label and s.split = 'train' group by l.label
))"""


def _descent(key: str, rounds: int) -> str:
    """Accelerated projected gradients, begun anew every 50 rounds, from ``bags`` (key, t, part) and ``grams`` (part, gram, most)."""
    sums = f"list_transform({_K}, lambda j: list_sum(list_slice(list_reverse_sort(v), 1, j)))"
    return f"""
rounds as (
  select {key}, part, t, g as p, g as look, 1::double as momentum, 0 as i from bags, prior
  union all
  select {key}, part, t, f as p, list_transform({_K}, lambda j: f[j] + (momentum - 1) / ((1 + sqrt(1 + 4 * momentum * momentum)) / 2) * (f[j] - p[j])) as look,
    case when i % 50 = 49 then 1::double else (1 + sqrt(1 + 4 * momentum * momentum)) / 2 end, i + 1
  from (
    select *, list_transform(v, lambda x: greatest(0::double, x - theta)) as f
    from (
      select *, list_max(list_transform({_K}, lambda j: (u[j] - 1) / j)) as theta
      from (
        select *, {sums} as u
        from (
          select r.*, list_transform({_K}, lambda j: look[j] - (list_dot_product(gram[j], look) - t[j]) / most) as v
          from rounds r join grams using (part) where i < {rounds}
        )
      )
    )
  )
),
last as (select {key}, part, unnest(['{"', '".join(sorted(LABELS))}']) as label, unnest(p) as p from rounds where i = {rounds})"""


_GRAMS = "list_transform(c, lambda a: list_transform(c, lambda b: list_dot_product(a, b))) as gram, list_sum(list_transform(c, lambda a: list_dot_product(a, a))) as most"


def _mixture_sql(vector: str) -> str:
    """The best mixture of the classes' means of ``vector``, the value of each row and label."""
    return f"""
with recursive {SCORES_SQL},{_TESTED},
valued as (select s.instance_id, split, y, label, p, pred, {vector} as v from scores s, (select unnest(g) as prior, unnest(['{"', '".join(sorted(LABELS))}']) as name from prior) z where z.name = label),
columns as (select y, label, avg(v) as m from valued where split = 'train' group by y, label),
matrix as (select list(c order by y) as c from (select y, list(m order by label) as c from columns group by y)),
grams as (select 0 as part, c, {_GRAMS} from matrix),
means as (select {_KEY}, label, avg(v) as m from drawn join valued using (instance_id) where split = 'test' group by {_KEY}, label),
bags as (
  select {_KEY}, 0 as part, list_transform(any_value(c), lambda a: list_dot_product(a, list(m order by label))) as t from means, matrix group by {_KEY}
),{_descent(_KEY, 2500)}
select {_KEY}, label, round(p, 5) as p_pred from last"""


def _readme_sql(bins: int = 2, subset: int = 5, subsets: int = 8, seed: int = 7) -> str:
    rng = np.random.default_rng(seed)
    chosen = [sorted(int(i) for i in rng.choice(scoring.WIDTH, subset, replace=False)) for _ in range(subsets)]
    picks = ", ".join(f"({part}, {i}, {bins**at})" for part, some in enumerate(chosen) for at, i in enumerate(some))
    return f"""
with recursive {SCORES_SQL},{_TESTED},
flat as (select instance_id, split, y, unnest(features) as v, generate_subscripts(features, 1)::int - 1 as feature from inst),
edges as (select feature, quantile_cont(v, 0.5) as e from flat where split = 'train' group by feature),
picks as (select * from (values {picks}) x(part, feature, worth)),
coded as (select instance_id, split, y, part, sum((v >= e)::int * worth)::int as cell from flat join edges using (feature) join picks using (feature) group by all),
every as (select part, cell from (select unnest(range({subsets})) as part), (select unnest(range({bins**subset})) as cell)),
rows_of as (select y, count(*) as n from inst where split = 'train' group by y),
columns as (
  select r.y, s.part, list(coalesce(k, 0) / r.n::double order by s.cell) as c
  from rows_of r cross join every s left join (select y, part, cell, count(*) as k from coded where split = 'train' group by y, part, cell) h on h.y = r.y and h.part = s.part and h.cell = s.cell
  group by r.y, s.part
),
matrix as (select part, list(c order by y) as c from columns group by part),
grams as (select part, c, {_GRAMS} from matrix),
counts as (select {_KEY}, part, cell, count(*) as k from drawn join coded using (instance_id) where split = 'test' group by {_KEY}, part, cell),
sizes as (select {_KEY}, part, sum(k) as n from counts group by {_KEY}, part),
bag_shares as (
  select z.protocol, z.bag_size, z.bag_index, s.part, list(coalesce(k, 0) / z.n::double order by s.cell) as q
  from sizes z join every s using (part) left join counts c on c.protocol = z.protocol and c.bag_size = z.bag_size and c.bag_index = z.bag_index and c.part = s.part and c.cell = s.cell
  group by z.protocol, z.bag_size, z.bag_index, s.part
),
bags as (select {_KEY}, part, list_transform(c, lambda a: list_dot_product(a, q)) as t from bag_shares join matrix using (part)),{_descent(_KEY, 1500)}
select {_KEY}, label, round(avg(p), 5) as p_pred from last group by {_KEY}, label"""


SQL["readme"] = _readme_sql()
SQL["gac"] = _mixture_sql("(pred = label)::int::double")
SQL["gpac"] = _mixture_sql("p")
SQL["fm"] = _mixture_sql("(p >= prior)::int::double")
SQL["hdx"] = f"""
with recursive {SCORES_SQL},{_TESTED},
flat as (select instance_id, split, y, unnest(features) as v, generate_subscripts(features, 1)::int - 1 as feature from inst),
edges as (
  select feature, list_distinct(quantile_cont(v, [{', '.join(f'{i / 8}' for i in range(1, 8))}])) as e from flat where split = 'train' group by feature
),
coded as (select instance_id, split, y, feature * 8 + len(list_filter(e, lambda x: x <= v)) as cell from flat join edges using (feature)),
cells as (select unnest(range(160)) as cell),
rows_of as (select y, count(*) as n from inst where split = 'train' group by y),
matrix as (
  select list(c order by y) as c from (
    select r.y, list(coalesce(k, 0) / r.n::double order by s.cell) as c
    from rows_of r cross join cells s left join (select y, cell, count(*) as k from coded where split = 'train' group by y, cell) h on h.y = r.y and h.cell = s.cell group by r.y
  )
),
counts as (select {_KEY}, cell, count(*) as k from drawn join coded using (instance_id) where split = 'test' group by {_KEY}, cell),
sizes as (select {_KEY}, sum(k) / 20 as n from counts group by {_KEY}),
bags as (
  select protocol, bag_size, bag_index, list(coalesce(k, 0) / z.n::double order by s.cell) as q
  from sizes z cross join cells s left join counts c using (protocol, bag_size, bag_index, cell) group by protocol, bag_size, bag_index
),
rounds as (
  select {_KEY}, q, list_transform(g, lambda x: (x + 1e-9::double) / (1 + {len(LABELS)} * 1e-9::double)) as p, 0 as i, false as done from bags, prior
  union all
  select {_KEY}, q, f, i + 1, list_max(list_transform({_K}, lambda j: abs(f[j] - p[j]))) < 1e-10::double
  from (
    select *, list_transform(w, lambda x: x / list_sum(w)) as f
    from (
      select *, list_transform({_K}, lambda j: p[j] * list_dot_product(c[j], ratio)) as w
      from (
        select r.*, c, list_transform(range(1, 161), lambda a: sqrt(q[a] / greatest(list_sum(list_transform({_K}, lambda j: c[j][a] * p[j])), 1e-15::double))) as ratio
        from rounds r, matrix where not done and i < 500
      )
    )
  )
)
select {_KEY}, unnest(['{"', '".join(sorted(LABELS))}']) as label, round(unnest(p), 5) as p_pred
from (select * from rounds qualify row_number() over (partition by {_KEY} order by i desc) = 1)"""
_POOLED = f"""
with {SCORES_SQL},
points as (
  select label, p, avg((y = label)::int) as t, count(*) as w, row_number() over (partition by label order by p) as i
  from scores where split = 'train' group by label, p
),
sums as (select *, sum(w * t) over (partition by label order by i) as st, sum(w) over (partition by label order by i) as sw from points),
stretches as (
  select a.label, a.i as j, b.i as k, (b.st - a.st + a.w * a.t) / (b.sw - a.sw + a.w) as m from sums a join sums b on a.label = b.label and a.i <= b.i
),
lows as (select label, j, k as i, min(m) over (partition by label, j order by k desc) as low from stretches),
pooled as (select label, p, v, i from (select label, i, max(low) as v from lows group by label, i) join points using (label, i)),
asked as (select instance_id, label, p, (y = label)::int as is_true from scores where split = 'test'),
below as (select a.*, l.p as lp, l.v as lv, l.i as li from asked a asof left join pooled l on a.label = l.label and a.p >= l.p),
mapped as (
  select b.instance_id, b.label, b.is_true, case when lp is null then f.v when lp = b.p or h.p is null then lv else lv + (h.v - lv) * (b.p - lp) / (h.p - lp) end as raw
  from below b left join pooled h on h.label = b.label and h.i = b.li + 1 left join pooled f on f.label = b.label and f.i = 1
),
{_NORMAL}"""
SQL["isotonic"] = _ece(_POOLED, "label", "q", "is_true = 1", _uniform_bin("q", 15)).replace("{rows}", "normal").replace(", 9) as ece", ", 6) as ece")
