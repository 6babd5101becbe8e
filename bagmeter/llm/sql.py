"""DuckDB SQL of the queries that SQL can express."""

from bagmeter.functions.rng import uniform_sql
from bagmeter.llm.quota import STRIDES

_TRIM = "trim({}, chr(32) || chr(9))"


def _id(c: str) -> str:
    bare = f"regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')"
    pattern = "'^([a-z]+)0*([0-9]+)$'"
    return (
        f"case when regexp_matches({bare}, {pattern}) then regexp_extract({bare}, {pattern}, 1) || '-' || "
        f"lpad(regexp_extract({bare}, {pattern}, 2), greatest(7, length(regexp_extract({bare}, {pattern}, 2))::int), '0') end"
    )


_ASKED = f"""
beats as (
  select distinct source, {_TRIM.format('y')} as label, instance_id from instances where split = 'test' and y is not null
),
supply as (select source, label, count(*) as available from beats group by source, label),
asked as (
  select protocol, bag_size, bag_index, source, {_TRIM.format('label')} as label,
    max(greatest(coalesce(n, floor(prevalence * bag_size + 0.5)), coalesce(min_n, 0)))::bigint as quota
  from bag_prevalences group by all
)"""

#: The beat classes of the ANSI/AAMI EC57 standard.
_CLASS = (
    "case when label in ('N', 'L', 'R', 'e', 'j') then 'N' when label in ('A', 'a', 'J', 'S') then 'S' when label in ('V', 'E') then 'V' "
    "when label = 'F' then 'F' when label in ('/', 'f', 'Q') then 'Q' else label end"
)

_VALUES = f"""
vals as (
  select upper({_TRIM.format('method')}) as method, upper({_TRIM.format('classifier')}) as classifier, bag_size, mae, run_day
  from (select distinct * from baselines_2) where isfinite(mae) and mae between 0 and 1
)"""

_COORDS = ", ".join(f"features[{i}] as f{i}" for i in range(1, 21))
_NEAR = " + ".join(f"coalesce((abs(a.f{i} - b.f{i}) <= 0.020000001)::int, 0)" for i in range(1, 21))
_PAIRS = f"""
vectors as (
  select distinct instance_id, split <> 'train' as probe, {_COORDS} from instances
  where split in ('train', 'valid', 'test') and len(features) = 20
    and not coalesce(len(list_distinct(features)) = 1 and len(list_filter(features, lambda v: v is null)) = 0, false)
),
pairs as (
  select a.instance_id as train_id, b.instance_id as other_id
  from vectors a, vectors b where not a.probe and b.probe and {_NEAR} >= 17
)"""

_LEAKS = """
with item_words as (
  select item_id, regexp_extract_all(lower(item_text), '[\\p{L}\\p{N}]+') as w from eval_items where item_text is not null
),
item_grams as (
  select distinct item_id, array_to_string(w[i : i + 11], ' ') as gram
  from (select item_id, w, unnest(range(1, len(w) - 10)) as i from item_words)
),
doc_words as (
  select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null
),
doc_grams as (
  select doc_id, array_to_string(w[i : i + 11], ' ') as gram
  from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from doc_words)
)"""

_PLACED = (
    _LEAKS.replace("select distinct item_id,", "select item_id, i,").replace("select doc_id, array", "select doc_id, i, array")
    .replace("item_grams as", "item_places as").replace("doc_grams as", "doc_places as")
)

_CLOSING = "' ' || chr(9) || chr(13) || chr(160) || chr(12288) || '\"''' || chr(8221) || chr(8217) || chr(187) || ')]'"
_MARKS = "['.', '!', '?', ';', ':', chr(8230), chr(12290), chr(65281), chr(65311), chr(65307), chr(65306)]"
_SOLID = "text"
for _code in (32, 10, 9, 13, 160, 12288):
    _SOLID = f"replace({_SOLID}, chr({_code}), '')"
_GIVEN = "regexp_extract(lower(coalesce(lang, '')), '^([a-z]+)', 1)"
_STATS = f"""
with lists as (
  select list(distinct lower(word)) as every, {', '.join(f"list(distinct lower(word)) filter (lang = '{c}') as l_{c}" for c in ('de', 'en', 'es', 'fr'))} from common_words
),
base as (
  select doc_id, greatest(length({_SOLID}), 1) as solid, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as words,
    case when {_GIVEN} in ('en', 'eng') then 'en' when {_GIVEN} in ('de', 'ger', 'deu') then 'de' when {_GIVEN} in ('fr', 'fra', 'fre') then 'fr'
      when {_GIVEN} in ('es', 'spa') then 'es' when {_GIVEN} in ('zh', 'zho', 'chi') then 'zh' else 'und' end as given,
    case when strlen(text) > 1.3 * length(text) then length(text) - length(regexp_replace(text, '\\p{{Han}}+', '', 'g')) else 0 end as han,
    list_filter(list_transform(string_split(text, chr(10)), lambda x: rtrim(x, {_CLOSING})), lambda x: length(trim(x)) > 0) as lines
  from documents where doc_id is not null and regexp_matches(text, '[^\\s\\x{{A0}}\\x{{3000}}]')
),
counted as (
  select doc_id, solid, given, han, len(words) as n, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) as letters, len(lines) as n_lines,
    len(list_filter(lines, lambda x: list_contains({_MARKS}, right(x, 1)))) as ended,
    {', '.join(f"len(list_filter(words, lambda w: list_contains(l_{c}, w))) as c_{c}" for c in ('de', 'en', 'es', 'fr'))}
  from base, lists
),
best as (select *, greatest(c_de, c_en, c_es, c_fr) as c from counted),
stats as (
  select doc_id,
    case when han * 3 > solid then 'zh' when c > 0 then case c when c_fr then 'fr' when c_es then 'es' when c_en then 'en' else 'de' end else given end as lang,
    n::double as n_words, letters / greatest(n, 1)::double as mean_length, 1 - letters / solid::double as symbol_ratio,
    ended / greatest(n_lines, 1)::double as ended_share, c / greatest(n, 1)::double as common_share
  from best
)"""

_PIECE_SOLID = "piece"
for _code in (32, 9, 13, 160, 12288):
    _PIECE_SOLID = f"replace({_PIECE_SOLID}, chr({_code}), '')"
_OUTSIDE = f"""
with every as (select list(distinct lower(word)) as every from common_words where lang is not null and word is not null),
texts as (select doc_id, string_split(text, chr(10)) as lines from documents where doc_id is not null and regexp_matches(text, '[^\\s\\x{{A0}}\\x{{3000}}]')),
lines as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as at_line from texts),
cut as (
  select doc_id, at_line, case when length(line) > 160
    then string_split(regexp_replace(line, '([.!?;。！？；])[ \t\r\u00a0\u3000]*', '\\1' || chr(10), 'g'), chr(10)) else [line] end as parts from lines
),
pieces as (select doc_id, at_line, unnest(parts) as piece, generate_subscripts(parts, 1) as at_part from cut),
worded as (
  select *, length({_PIECE_SOLID}) as solid, regexp_extract_all(lower(piece), '[\\p{{L}}\\p{{N}}]+') as words,
    length(piece) - length(regexp_replace(piece, '\\p{{Han}}+', '', 'g')) as han from pieces
),
hits as (
  select *, list_filter(words, lambda w: list_contains(every, w)) as common, len(list_filter(words, lambda w: length(w) = 1)) * 3 > len(words) as strewn,
    coalesce(list_sum(list_transform(list_filter(words, lambda w: not regexp_matches(w, '[0-9]')), lambda w: length(w))), 0) as lettered
  from worded, every where solid > 0
),
judged as (
  select doc_id, at_line, at_part, solid, case when han > 0 and han * 3 >= solid then han >= 14 or regexp_matches(piece, '[，。；：、！？]')
    else (case when strewn then len(list_filter(common, lambda w: length(w) > 1)) else len(common) end) >= greatest(1::double, 0.12::double * len(words))
      and lettered >= 0.55::double * solid end as ok
  from hits
),
placed as (
  select *, coalesce(lag(ok) over doc, false) and (coalesce(lead(ok) over doc, false) or coalesce(lead(ok, 2) over doc, false)) as between_sentences
  from judged window doc as (partition by doc_id order by at_line, at_part)
),
outside as (
  select doc_id, coalesce(sum(solid) filter (not ok and not between_sentences), 0)::double / sum(solid)::double as outside_share from placed group by doc_id
)"""


def _tail(stat: str, side: str) -> str:
    upto = f"count(*) over (partition by lang order by {stat} range between unbounded preceding and current row) / count(*) over (partition by lang)::double"
    low, high = upto, upto.replace(f"order by {stat}", f"order by {stat} desc")
    return {"low": low, "high": high, "both": f"least(1::double, 2 * least({low}, {high}))"}[side]


_TAILS = {"n_words": "both", "mean_length": "both", "symbol_ratio": "high", "ended_share": "low", "common_share": "low"}
_SCORE = " + ".join([*(f"0.01::double * -ln({_tail(s, side)})" for s, side in _TAILS.items()), f"-ln({_tail('outside_share', 'high')})"])

SQL = {
    "p1_found": f"""
with {_ASKED}
select a.protocol, a.bag_size, a.bag_index, a.label from asked a
left join supply s on a.source = s.source and a.label = s.label where a.quota > coalesce(s.available, 0)""",
    "p1_report": f"""
with {_ASKED},
samples as (select distinct protocol, bag_size, bag_index, source from asked),
every as (
  select protocol, bag_size, bag_index, source, label, quota, 0 as available from asked
  union all select protocol, bag_size, bag_index, s.source, label, 0, available from samples s join supply using (source)
),
leaves as (
  select protocol, bag_size, bag_index, source, label, {_CLASS} as c, sum(quota)::bigint as quota, sum(available)::bigint as available from every group by all
),
totals as (select *, least(sum(quota) over bag, sum(available) over bag) as t from leaves window bag as (partition by protocol, bag_size, bag_index, source)),
classes as (
  select protocol, bag_size, bag_index, source, c, any_value(t) as t, least(sum(quota), sum(available)) as base, sum(available) - least(sum(quota), sum(available)) as spare
  from totals group by protocol, bag_size, bag_index, source, c
),
class_amounts as (
  select protocol, bag_size, bag_index, source, c, base + greatest(0, least(spare, t - sum(base) over bag
    - coalesce(sum(spare) over (partition by protocol, bag_size, bag_index, source order by -spare, c rows between unbounded preceding and 1 preceding), 0))) as amount
  from classes window bag as (partition by protocol, bag_size, bag_index, source)
),
parts as (
  select l.protocol, l.bag_size, l.bag_index, l.source, l.c, label, quota, available, amount, least(quota, available) as own, available - least(quota, available) as spare
  from leaves l join class_amounts a on l.protocol = a.protocol and l.bag_size = a.bag_size and l.bag_index = a.bag_index
    and l.source is not distinct from a.source and l.c is not distinct from a.c
)
select protocol, bag_size, bag_index, label, quota, available, own, (own + greatest(0, least(spare, amount - sum(own) over class
    - coalesce(sum(spare) over (partition by protocol, bag_size, bag_index, source, c order by -spare, label rows between unbounded preceding and 1 preceding), 0))))::bigint as allotted,
  quota - own as shortfall
from parts window class as (partition by protocol, bag_size, bag_index, source, c)""",
    "p1_sample": "",
    "p2_found": f"""
with {_PAIRS}
select least(train_id, other_id) as instance_a, greatest(train_id, other_id) as instance_b from pairs""",
    "p2_report": f"""
with {_PAIRS},
places as (select distinct on (instance_id) instance_id as other_id, split, source from instances),
agreeing as (
  select b.instance_id as other_id, {_NEAR} as m from vectors a, vectors b where not a.probe and b.probe and {_NEAR} >= 17
)
select split, source, count(*) as pairs, count(distinct other_id) as beats, max(m / (40 - m)::double) as best_jaccard
from agreeing join places using (other_id) group by split, source""",
    "p3_merged_days": f"""
with {_VALUES},
cells as (select method, classifier, bag_size, least(1023, floor(mae * 1024))::int as bin, count(*) as n from vals group by all),
upto as (
  select *, sum(n) over (partition by method, classifier, bag_size order by bin) as u, sum(n) over (partition by method, classifier, bag_size) as t from cells
),
probs as (select unnest([0.05, 0.25, 0.5, 0.75, 0.95])::double as prob)
select method, classifier, bag_size, prob, t::bigint as n, (bin + 0.5::double) / 1024 as value, 1 / 2048::double as error
from upto, probs where floor(prob * (t - 1)) < u and floor(prob * (t - 1)) >= u - n""",
    "p3_found": f"""
with {_VALUES}
select method, classifier, bag_size from vals group by all having quantile_cont(mae, 0.5) > 0.30""",
    "p3_percentiles": f"""
with {_VALUES}, probs as (select unnest([0.05, 0.25, 0.5, 0.75, 0.95])::double as prob),
lists as (select method, classifier, bag_size, count(*) as n, quantile_cont(mae, [0.05, 0.25, 0.5, 0.75, 0.95]) as q from vals group by all)
select method, classifier, bag_size, unnest([0.05, 0.25, 0.5, 0.75, 0.95])::double as prob, n, round(unnest(q), 9) as value from lists""",
    "p4_found": f"""
with recursive
recs as (select {_id('record_id')} as node, {_id('patient_id')} as patient from records),
edges as (
  select node as a, '~' || patient as b from recs where patient is not null and not regexp_matches(patient, '-(0+|9999999)$')
  union select {_id('record_a')}, {_id('record_b')} from record_links where record_a is not null and record_b is not null
),
both_ways as (select a, b from edges where a <> b union select b, a from edges where a <> b),
reach as (
  select node, node as seen from recs union select r.node, e.b from reach r join both_ways e on r.seen = e.a
),
roots as (select node, min(seen) as root from reach group by node),
held as (select distinct {_id('record_id')} as node, split from instances where split is not null),
torn as (select root from roots join held using (node) group by root having count(distinct split) > 1)
select node as record_id, root as group_id from roots join torn using (root)""",
    "p5_found": f"""
with means as (
  select distinct run_id, quantifier, bag_size, mae_mean, mae_std, logged_at,
    case regexp_replace(upper(protocol), '[^A-Z]+', '', 'g') when 'CAPP' then 'C-APP' when 'APP' then 'APP' end as protocol
  from summary_table where mae_mean >= 0 and not isnan(mae_mean)
)
select run_id, protocol, bag_size, place, quantifier from (
  select *, row_number() over (partition by run_id, protocol, bag_size order by mae_mean, quantifier)::int as place from means
) where place <= 5""",
    "p8_found": f"{_LEAKS} select distinct doc_id, item_id from doc_grams join item_grams using (gram)",
    "p8_longest": f"""{_PLACED},
hits as (select doc_id, item_id, d.i, d.i - t.i as diagonal from doc_places d join item_places t using (gram)),
runs as (select *, i - row_number() over (partition by doc_id, item_id, diagonal order by i) as run from hits),
lengths as (
  select doc_id, item_id, (count(*) + 11)::int as longest, (min(i) - 1)::int as doc_word, (min(i) - 1 - diagonal)::int as item_word
  from runs group by doc_id, item_id, diagonal, run
)
select doc_id, item_id, longest, doc_word, item_word from lengths
qualify row_number() over (partition by doc_id, item_id order by longest desc, doc_word, item_word) = 1""",
    "p8_clean": f"""{_LEAKS}
select doc_id, source from documents where doc_id not in (select doc_id from doc_grams join item_grams using (gram))""",
    "p9_stats": f"""{_STATS} select doc_id, lang, n_words, {', '.join(f'round({s}, 9) as {s}' for s in _TAILS if s != 'n_words')} from stats""",
    "p9_found": f"{_OUTSIDE} select doc_id from outside where outside_share > 0.5",
    "p9_scores": f"""{_STATS}, {_OUTSIDE.replace('with every', 'every', 1)} select doc_id, lang, round({_SCORE}, 6) as score from stats join outside using (doc_id)""",
}

_BAG_KEY = ("w.protocol", "w.bag_size", "w.bag_index", "w.source", "w.label")
SQL["p1_sample"] = f"""
with allotments as ({SQL["p1_report"].replace("select protocol, bag_size, bag_index, label, quota, available, own,", "select protocol, bag_size, bag_index, source, label, quota, available, own,")}),
pool as (
  select distinct source, {_TRIM.format("y")} as label, instance_id from instances where split = 'test' and y is not null and source is not null and instance_id is not null
),
ranked as (
  select *, row_number() over (partition by source, label order by {uniform_sql(0, "'rank'", "instance_id")}, instance_id) - 1 as rank,
    count(*) over (partition by source, label) as size from pool
),
walks as (
  select w.*, size, floor({uniform_sql(0, "'start'", *_BAG_KEY)} * size)::bigint as start,
    ([{", ".join(map(str, STRIDES))}])[floor({uniform_sql(0, "'stride'", *_BAG_KEY)} * {len(STRIDES)})::bigint + 1] % size as stride
  from allotments w join (select distinct source, label, size from ranked) z on w.source = z.source and w.label = z.label where allotted > 0
),
places as (select protocol, bag_size, bag_index, source, label, (start + i * stride) % size as rank from (select *, unnest(range(allotted)) as i from walks))
select p.protocol, p.bag_size, p.bag_index, p.source, p.label, instance_id from places p join ranked r on p.source = r.source and p.label = r.label and p.rank = r.rank"""

_ASSIGNED = f"""
with recursive
recs0 as (select {_id('record_id')} as node, {_id('patient_id')} as patient from records),
edges1 as (select node as a, '~' || patient as b from recs0 where patient is not null and not regexp_matches(patient, '-(0+|9999999)$')),
edges2 as (
  select a, b from edges1 where a is not null union select {_id('record_a')}, {_id('record_b')} from record_links where record_a is not null and record_b is not null
),
recs as (select node from recs0 where node is not null union select a from edges2 where a <> b union select b from edges2 where a <> b),
both1 as (select a, b from edges1 where a <> b union select b, a from edges1 where a <> b),
both2 as (select a, b from edges2 where a <> b union select b, a from edges2 where a <> b),
reach1 as (select node, node as seen from recs union select r.node, e.b from reach1 r join both1 e on r.seen = e.a),
reach2 as (select node, node as seen from recs union select r.node, e.b from reach2 r join both2 e on r.seen = e.a),
before as (select node, min(seen) as root from reach1 group by node),
after as (select node, min(seen) as root from reach2 group by node),
held as (
  select {_id('record_id')} as node, {_TRIM.format('y')} as label, split, count(*) as n
  from (select distinct record_id, y, split, instance_id from instances where instance_id is not null) group by all having node is not null
),
old as (
  select b.root as node, sum(n) filter (split = 'train') as a, sum(n) filter (split = 'valid') as b, sum(n) filter (split = 'test') as c
  from before b join held using (node) where split is not null group by b.root
),
counts as (
  select a.root, coalesce(sum(n) filter (split = 'train'), 0) as n_train, coalesce(sum(n) filter (split = 'valid'), 0) as n_valid,
    coalesce(sum(n) filter (split = 'test'), 0) as n_test from after a left join held using (node) group by a.root
),
olds as (
  select a.root, case greatest(coalesce(o.a, 0), coalesce(o.b, 0), coalesce(o.c, 0)) when coalesce(o.a, 0) then 'train' when coalesce(o.b, 0) then 'valid' else 'test' end as split
  from old o join after a using (node) where coalesce(o.a, 0) + coalesce(o.b, 0) + coalesce(o.c, 0) > 0
),
met as (select root from olds group by root having count(distinct split) > 1),
settled as (
  select root, case greatest(n_train, n_valid, n_test) when n_train then 'train' when n_valid then 'valid' else 'test' end as split,
    case when (n_train > 0)::int + (n_valid > 0)::int + (n_test > 0)::int > 1 or root in (select root from met) then 'quarantined' else 'kept' end as status
  from counts where n_train + n_valid + n_test > 0
),
by_label as (select root, label, sum(n) as n from held join after using (node) group by root, label),
present as (
  select label, sum(n) filter (split = 'train') as a, sum(n) filter (split = 'valid') as b, sum(n) filter (split = 'test') as c
  from by_label join settled using (root) group by label
),
lacks as (
  select t.label, greatest(0, total * 0.7::double - coalesce(a, 0)) as a, greatest(0, total * 0.1::double - coalesce(b, 0)) as b,
    greatest(0, total * 0.2::double - coalesce(c, 0)) as c
  from (select label, sum(n)::double as total from by_label group by label) t left join present p on t.label is not distinct from p.label
),
laid as (
  select root, m.l as label, coalesce(n, 0) + 1e-9::double as weight, {uniform_sql(0, "'fill'", "root")} as u
  from (select root from counts where n_train + n_valid + n_test = 0)
  left join (select root, max({{'n': n, 'l': label}}) as m, sum(n) as n from by_label group by root) using (root)
),
spots as (
  select root, label, (sum(weight) over (partition by label order by u, root rows between unbounded preceding and current row) - weight / 2)
    / sum(weight) over (partition by label) as spot from laid
),
filled as (
  select root, case when spot < case when a + b + c > 0 then a / (a + b + c) else 0.7::double end then 'train'
    when spot < case when a + b + c > 0 then (a + b) / (a + b + c) else 0.7::double + 0.1::double end then 'valid' else 'test' end as split, 'filled' as status
  from spots s left join lacks l on s.label is not distinct from l.label
),
splits as (select * from settled union all select * from filled)"""
SQL["p4_splits"] = f"""{_ASSIGNED}
select node as record_id, root as group_id, split, status from after join splits using (root) where not starts_with(node, '~')"""
SQL["p4_shares"] = f"""{_ASSIGNED},
cells as (select label, split, sum(n) as n from by_label join splits using (root) group by label, split),
wanted as (select unnest(['train', 'valid', 'test']) as split, unnest([0.7, 0.1, 0.2])::double as asked)
select l.label, w.split, coalesce(c.n, 0)::bigint as n, asked, round(coalesce(c.n, 0) / l.total, 9) as reached
from (select label, sum(n)::double as total from by_label group by label) l cross join wanted w
left join cells c on l.label is not distinct from c.label and w.split = c.split"""
