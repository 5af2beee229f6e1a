"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from dataclasses import replace

from weftline.config import grid
from weftline.functions import text as T
from weftline.plans.passage_search import CONFIG, MISSING
from weftline.plans.queries import ACROSS, TERMS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z]+')"
DIMS = 64


def _q(s: str) -> str:
    return s.replace("'", "''")


def words(table: str, key: str) -> str:
    return f"(select {key}, pos, w[pos + 1] as token from (select {key}, w, unnest(range(len(w))) as pos from (select {key}, {WORDS} as w from {table})))"


HID = "(('0x' || substr(md5(token), 1, 8))::bigint % (select count(*) from embeddings))"
LONG = "(select vec_id, d - 1 as dim, embedding[d]::double as v from (select vec_id, embedding, unnest(range(1, 65)) as d from embeddings))"


def _pairwise(expr: str) -> str:
    return f"select x.vec_id as a, y.vec_id as b, round({expr}, 6) as value from (select vec_id, embedding::double[] as e from embeddings where vec_id % 50 = 0) x, (select vec_id, embedding::double[] as e from embeddings) y"


DOC = f"""
with w as (select doc_id, {HID} as hid, count(*) as c from {words('documents', 'doc_id')} group by 1, 2),
dv as (select doc_id, dim, sum(c * v) / sum(c) as value from w join {LONG} e on e.vec_id = hid where hid % 10 <> 0 group by 1, 2)
"""


def _doc_pairs(expr: str) -> str:
    return DOC + f", l as (select doc_id, list(value order by dim) as e from dv group by 1) select x.doc_id as a, y.doc_id as b, round({expr}, 6) as value from (select * from l where doc_id % 50 = 0) x, l y"


SENT = f"""
with s as (select doc_id, i - 1 as sent, lines[i] as text from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from (select doc_id, string_split(text, chr(10)) as lines from documents))),
w as (select doc_id, sent, {HID} as hid, count(*) as c from (select doc_id, sent, unnest({WORDS}) as token from s) group by 1, 2, 3),
sv as (select doc_id, sent, dim, sum(c * v) / sum(c) as value, sum(c) as n from w join {LONG} e on e.vec_id = hid where hid % 10 <> 0 group by 1, 2, 3)
"""

GLOSSARY = f"""
with b as (select item_id * 1000 + pos as ord, token as src, lead(token) over (partition by item_id order by pos) as tgt from {words('benchmark', 'item_id')}),
h as (select ord, src, tgt, (('0x' || substr(md5(src), 1, 8))::bigint % (select count(*) from embeddings)) as hs, (('0x' || substr(md5(tgt), 1, 8))::bigint % (select count(*) from embeddings)) as ht from b where tgt is not null),
p as (select * from h where hs % 10 <> 0 and ht % 10 <> 0)
"""
PAIR = (
    GLOSSARY
    + """, l as (select src as first, arg_max(tgt, ord) as second, arg_max(hs, ord) as hs, arg_max(ht, ord) as ht from p group by 1),
sim as (select first, second, round(list_cosine_similarity(x.embedding::double[], y.embedding::double[]), 6) as similarity from l join embeddings x on x.vec_id = hs join embeddings y on y.vec_id = ht)
"""
)


def _wide(alias: str, f: str) -> str:
    return ", ".join(f.format(d=d, a=alias) for d in range(DIMS))


SHORT, S_ADJ, L_ADJ = CONFIG.short_length, 1.0 + CONFIG.short_adjust, 1.0 + CONFIG.long_adjust
QLEN = f"(case when n > {SHORT} then trunc(n * {L_ADJ}::double) else trunc(n * {S_ADJ}::double) end)::int"

def _similarity(metric: str) -> str:
    dot, own = " + ".join(f"d{d} * q{d}" for d in range(DIMS)), " + ".join(f"d{d} * d{d}" for d in range(DIMS))
    if metric == "cosine":
        return f"({dot}) / (sqrt({own}) * qnorm)"
    return f"1 - sqrt({' + '.join(f'pow(d{d} / known - q{d} / qknown, 2)' for d in range(DIMS))})"


def _search(config=CONFIG, missing: int = 0) -> str:
    """The common tables of a search, of which a query takes what it needs. ``missing``: every so manieth word of a passage has no
    equivalent in its query."""
    asked = f"(select * from bt where pos % {missing} <> {missing - 1})" if missing else "bt"
    shown = "reverse(token)" if missing else "token"
    short, s_adj, l_adj, top_n = config.short_length, 1.0 + config.short_adjust, 1.0 + config.long_adjust, config.top_n
    qlen = f"(case when n > {short} then trunc(n * {l_adj}::double) else trunc(n * {s_adj}::double) end)::int"
    return f"""
with recursive emb as (select vec_id, {', '.join(f'embedding[{d + 1}]::double as v{d}' for d in range(DIMS))} from embeddings where vec_id % 10 <> 0),
seq as materialized (select row_number() over (order by doc_id, pos) - 1 as g, token, {HID} as hid from {words('documents', 'doc_id')}),
pre as materialized (select g, sum(case when vec_id is null then 0 else 1 end) over w as k, {', '.join(f'sum(coalesce(v{d}, 0)) over w as p{d}' for d in range(DIMS))} from seq left join emb on vec_id = hid window w as (order by g)),
bt as (select item_id, pos, token, {HID} as hid from {words('benchmark', 'item_id')}),
qn as (select item_id as query_id, count(*) as n, list({shown} order by pos) as asked from {asked} group by 1),
gn as (select item_id as query_id, count(*) as gold_n, list(token order by pos) as toks from bt group by 1),
qv as (select item_id as query_id, count(vec_id) as qknown, {', '.join(f'coalesce(sum(v{d}), 0) as q{d}' for d in range(DIMS))} from {asked} left join emb on vec_id = hid group by 1),
q as (select qn.query_id, n, asked, gold_n, toks, qknown, {qlen} as len, {', '.join(f'q{d}' for d in range(DIMS))}, sqrt({' + '.join(f'q{d} * q{d}' for d in range(DIMS))}) as qnorm from qn join qv on qn.query_id = qv.query_id join gn on gn.query_id = qn.query_id),
diff as (select q.query_id, a.g - len + 1 as start, a.k - coalesce(b.k, 0) as known, qnorm, qknown, {', '.join(f'a.p{d} - coalesce(b.p{d}, 0) as d{d}, q{d}' for d in range(DIMS))} from q join pre a on a.g >= len - 1 left join pre b on b.g = a.g - len),
sims as materialized (select query_id, start, round({_similarity(config.metric)}, 6) as similarity from diff where known > 0),
hits as materialized (select query_id, start, similarity, rank from (select *, row_number() over (partition by query_id order by similarity desc, start) as rank from sims) where rank <= {top_n}),
firsts as (select query_id, g as start from q join seq on token = toks[1]),
cand as (select f.query_id, f.start, count(*) as n from firsts f join q on q.query_id = f.query_id join bt on bt.item_id = f.query_id join seq on seq.g = f.start + bt.pos and seq.token = bt.token group by 1, 2),
gold as (select c.query_id, min(c.start) as gold_start from cand c join q on q.query_id = c.query_id and q.gold_n = c.n group by 1),
ranks as (select g.query_id, g.gold_start, (select count(*) from sims s where s.query_id = g.query_id and (s.similarity > o.similarity or (s.similarity = o.similarity and s.start < o.start)))::bigint as predicted_rank,
    (select count(*) from sims s where s.query_id = g.query_id)::bigint as n_windows from gold g join sims o on o.query_id = g.query_id and o.start = g.gold_start),
steps as (select h.*, len, case when start - lag(start) over (partition by h.query_id order by start) <= 2 * len then 0 else 1 end as fresh from hits h join q on q.query_id = h.query_id),
parts as (select *, sum(fresh) over (partition by query_id order by start) as c from steps),
cl0 as (select query_id, c, min(start) as "begin", max(start + len - 1) as "end", min(rank) as best_rank, arg_min(start, rank) as optimal_start, arg_min(similarity, rank) as similarity, count(*) as n_hits from parts group by 1, 2),
clusters as (select *, row_number() over (partition by query_id order by best_rank) as cluster_no from cl0),
over as (select * from (select c.query_id, cluster_no, greatest(least(gold_start + gold_n - 1, "end") - greatest(gold_start, "begin") + 1, 0)::double / gold_n * 100 as pct from clusters c join gold g on g.query_id = c.query_id join q on q.query_id = c.query_id) where pct > 0),
flags as (select query_id, bool_or(cluster_no = 1 and pct >= 90) as top_full, bool_or(cluster_no <= 5 and pct >= 90) as near_full, bool_or(pct >= 90) as any_full,
    bool_or(cluster_no = 1 and pct >= 50) as top_some, bool_or(cluster_no <= 5 and pct >= 50) as near_some, true as any_some,
    (list(cluster_no order by pct desc, cluster_no) filter (where pct >= 90))[1] as best_overlap_rank, min(cluster_no) filter (where pct >= 90) as first_hit_rank,
    (list(cluster_no order by pct desc, cluster_no) filter (where pct >= 50 and pct < 90))[1] as best_partial_rank from over group by 1)
"""


SEARCH = _search()

SEEDS = f"""
with a as (select item_id, pos as i, token || ' ' || lead(token, 1) over w || ' ' || lead(token, 2) over w || ' ' || lead(token, 3) over w || ' ' || lead(token, 4) over w as seed from {words('benchmark', 'item_id')} window w as (partition by item_id order by pos)),
b as (select doc_id, pos as j, token || ' ' || lead(token, 1) over w || ' ' || lead(token, 2) over w || ' ' || lead(token, 3) over w || ' ' || lead(token, 4) over w as seed from {words('documents', 'doc_id')} window w as (partition by doc_id order by pos)),
m as (select item_id, i, doc_id, j, a.seed from a join b on a.seed = b.seed)
"""


def _windows(table: str, key: str, n: int) -> str:
    """(key, start, n_known, dot products' parts) of windows of n tokens."""
    over = f"over (partition by {key} order by pos rows between current row and {n - 1} following)"
    return f"""(select * from (select {key}, pos as start, count(*) {over} as n_all, count(vec_id) {over} as n_known, {', '.join(f'sum(embedding[{d + 1}]::double) {over} as s{d}' for d in range(DIMS))}
        from (select *, {HID} as hid from {words(table, key)}) left join (select * from embeddings where vec_id % 10 <> 0) on vec_id = hid) where n_all = {n})"""


SELF = " + ".join(f"s{d} * s{d}" for d in range(DIMS))
GATE = SEEDS + f""", wa as {_windows('benchmark', 'item_id', 10)}, wb as {_windows('documents', 'doc_id', 10)},
g as (select item_id, i, doc_id, j, round(coalesce(({' + '.join(f'wa.s{d} * wb.s{d}' for d in range(DIMS))}) / nullif(sqrt({' + '.join(f'wa.s{d} * wa.s{d}' for d in range(DIMS))}) * sqrt({' + '.join(f'wb.s{d} * wb.s{d}' for d in range(DIMS))}), 0), 0), 6) as similarity
    from m join wa using (item_id) join wb using (doc_id) where wa.start = i and wb.start = j and wa.n_known > 0 and wb.n_known > 0)
"""

SUMMARY = """, t as (select count(*) as total_phrases from q), f as (select count(*) filter (where top_full) as top_full, count(*) filter (where near_full) as near_full, count(*) filter (where any_full) as any_full,
            count(*) filter (where top_some) as top_some, count(*) filter (where near_some) as near_some, count(*) as any_some, median(best_overlap_rank)::double as clustered_median, round(avg(best_overlap_rank), 6) as clustered_mean, count(best_overlap_rank) as nf,
            median(best_partial_rank)::double as partial_median, round(avg(best_partial_rank), 6) as partial_mean, count(best_partial_rank) as np from flags),
            r as (select median(predicted_rank)::double as rank_median, round(avg(predicted_rank), 6) as rank_mean, round(stddev_pop(predicted_rank), 6) as rank_pstdev from ranks),
            summary as (select total_phrases, top_full, near_full, any_full, top_some, near_some, any_some, clustered_median, clustered_mean, partial_median, partial_mean, rank_median, rank_mean, rank_pstdev, total_phrases - nf as missing_full, total_phrases - np as missing_partial,
            round(top_full / total_phrases, 6) as top_full_ratio, round(any_full / total_phrases, 6) as any_full_ratio, round(any_some / total_phrases, 6) as any_some_ratio from t, f, r)
"""

def _report(config=CONFIG) -> str:
    return f""", spans as (select query_id, cluster_no, list(token order by g) as w from (select query_id, cluster_no, unnest(range("begin", "end" + 1)) as g from clusters) join seq using (g) group by 1, 2),
lines as (select c.query_id, c.cluster_no, printf('%d: Optimal at %d, scored %.5f, globally ranked at %d. Displaying %d to %d', c.cluster_no, c.optimal_start, round(c.similarity::decimal(18, 6), 5)::double, c.best_rank, c."begin", c."end") || chr(10)
        || array_to_string(w[1 : c.optimal_start - c."begin"] || ['***'] || w[c.optimal_start - c."begin" + 1 : c.optimal_start - c."begin" + len] || ['***'] || w[c.optimal_start - c."begin" + len + 1 :], ' ') || chr(10)
        || 'All subsumed results scores: ' || string_agg(printf('%d:%.5f', p.start, round(p.similarity::decimal(18, 6), 5)::double), '; ' order by p.start) || chr(10) || chr(10) as t
    from clusters c join parts p on p.query_id = c.query_id and p.c = c.c join spans s on s.query_id = c.query_id and s.cluster_no = c.cluster_no
    group by c.query_id, c.cluster_no, c.optimal_start, c.similarity, c.best_rank, c."begin", c."end", len, w),
body as (select query_id, string_agg(t, chr(10) order by cluster_no) as body from lines group by 1),
ov as (select query_id, string_agg(printf('%.2f%% of gold in Result #%d', pct, cluster_no), chr(10) order by pct desc, cluster_no) as t from over group by 1),
st as (select query_id, count(*) as n_windows, avg(similarity) as mean_sim, stddev_pop(similarity) as std_sim from sims group by 1)
select q.query_id, concat_ws(chr(10), array_to_string(asked, ' '), array_to_string(toks, ' ') || chr(10),
    'Actual location: ' || coalesce(g.gold_start::varchar, 'None') || ', predicted rank: ' || coalesce(predicted_rank::varchar, 'None') || ' out of ' || st.n_windows || ';' || chr(10),
    coalesce(ov.t, case when g.gold_start is null then 'Correct passage unknown' else 'Correct match not represented in these results' end) || chr(10),
    printf('Gold is %.2f times longer, actual adjustment ratio was ', gold_n / n) || (case when n > {config.short_length} then {1.0 + config.long_adjust} else {1.0 + config.short_adjust} end)::double::varchar,
    printf('avg similarity score: %.2f', mean_sim) || chr(10) || printf('std of similarity score: %.2f', std_sim) || chr(10), body) as report
from q join st on st.query_id = q.query_id join body on body.query_id = q.query_id left join gold g on g.query_id = q.query_id left join ranks r on r.query_id = q.query_id left join ov on ov.query_id = q.query_id
"""


GREEDY = """, ordered as (select h.query_id, len, list({'start': start, 'similarity': similarity, 'rank': rank} order by rank) as rest from hits h join q on q.query_id = h.query_id group by 1, 2),
taken as (select query_id, len, 0 as cluster_no, rest, rest as own, rest[1] as head from ordered
    union all select query_id, len, cluster_no + 1, list_filter(rest, lambda x: not (x.start - rest[1].start between 1 - len and len)), list_filter(rest, lambda x: x.start - rest[1].start between 1 - len and len), rest[1] from taken where len(rest) > 0)
select query_id, cluster_no::int as cluster_no, list_min(list_transform(own, lambda x: x.start)) as "begin", list_max(list_transform(own, lambda x: x.start)) + taken.len - 1 as "end", head.rank::int as best_rank,
    head.start as optimal_start, head.similarity as optimal_similarity, len(own)::bigint as n_hits from taken where cluster_no > 0
"""


def _run_report(config) -> str:
    near = f"in the top {config.top_k} results"
    window = "full" if config.window is None else config.window
    return f"""select 'Results for benchmark' || chr(10) || chr(10) || 'The top {config.top_n} results are displayed, clustering when the start of another result is within {window} tokens' || chr(10)
        || 'Search window is adjusted by a factor of {config.long_adjust + 1}' || chr(10) || 'Phrases of up to {config.short_length} tokens are adjusted by {config.short_adjust + 1}' || chr(10)
        || 'Tokens are of kind {config.method}' || chr(10) || 'The distance metric used is {config.metric}' || chr(10) || chr(10)
        || {' || '.join(f"case when {m} is null then 'No {k} results' else 'The median clustered {k} passage appears at rank ' || {m}::varchar || printf(', average is %.2f, with %d phrases with no {k} results', {a}, {x}) end || chr(10)" for k, m, a, x in (('full', 'clustered_median', 'clustered_mean', 'missing_full'), ('partial', 'partial_median', 'partial_mean', 'missing_partial')))}
        || 'The median predicted global rank is ' || rank_median::varchar || ' of ' || (select max(n) from (select count(*) as n from sims group by query_id)) || printf(', the average %.2f, the standard deviation %.2f', rank_mean, rank_pstdev) || chr(10) || chr(10)
        || printf('A total of %d phrases were searched', total_phrases) || chr(10)
        || printf('The full passage was found in the top result %d times, {near} %d times, in any %d times', top_full, near_full, any_full) || chr(10)
        || printf('Some of it was found in the top result %d times, {near} %d times, in any %d times', top_some, near_some, any_some) as report from summary"""


def _grid() -> str:
    cols = "clustered_median, clustered_mean, partial_median, partial_mean, rank_median, rank_mean, top_full_ratio, any_full_ratio, any_some_ratio"
    rows = []
    for config in grid(long_adjust=[0.0, 0.4], short_adjust=[0.3], top_n=[100, 500], method=["word"]):
        rows.append(f"select * from ({_search(config)}{SUMMARY} select '{config.results_dir('benchmark')}' as config, {cols} from summary)")
    return " union all ".join(rows)


PHRASES = f"""
with t as (select item_id, pos, token, {HID} as hid from {words('benchmark', 'item_id')}),
c as (select item_id, pos, {HID} as hid from (select item_id, pos, unnest(string_split(token, '')) as token from t where hid % 10 = 0 and length(token) > 1)),
p as (select item_id, pos, dim, v from t join {LONG} l on vec_id = hid where hid % 10 <> 0 union all select item_id, pos, dim, avg(v) as v from c join {LONG} l on vec_id = hid where hid % 10 <> 0 group by 1, 2, 3),
m as (select item_id, dim, avg(v) as value, count(*) as n from p group by 1, 2)
select item_id, max(n)::bigint as n, round(sqrt(sum(value * value)), 6) as norm, round(max(value) filter (where dim = 0), 6) as v0 from m group by 1
"""

SEED_VECTORS = f"""
with w as {_windows('benchmark', 'item_id', 4)},
s as (select item_id, pos as start, token || ' ' || lead(token, 1) over w || ' ' || lead(token, 2) over w || ' ' || lead(token, 3) over w as seed from {words('benchmark', 'item_id')} window w as (partition by item_id order by pos)),
o as (select seed, item_id, start, row_number() over (partition by seed order by item_id, start) as k from s where seed is not null),
f as (select o.seed, w.* from o join w on w.item_id = o.item_id and w.start = o.start where k = 1 and n_known > 0)
select * from (select a.seed as a, b.seed as b, round(({' + '.join(f'a.s{d} * b.s{d}' for d in range(DIMS))}) / (sqrt({' + '.join(f'a.s{d} * a.s{d}' for d in range(DIMS))}) * sqrt({' + '.join(f'b.s{d} * b.s{d}' for d in range(DIMS))})), 6) as similarity
    from f a, f b) where similarity > 0.8
"""

RANDOM = (
    GLOSSARY
    + """, z as (select src as first, tgt as second, hs, ht from p),
l as (select first, hs, row_number() over (order by first, second) as n from z),
r as (select second, ht, row_number() over (order by md5('0:' || second), second) as n from z),
sim as (select list_cosine_similarity(x.embedding::double[], y.embedding::double[]) as similarity from l join r on l.n = r.n join embeddings x on x.vec_id = hs join embeddings y on y.vec_id = ht)
select count(similarity) as n, round(avg(similarity), 6) as mean, round(stddev_samp(similarity), 6) as std, round(max(similarity), 6) as max, round(min(similarity), 6) as min, round(median(similarity), 6) as median from sim
"""
)

STARTS = (
    GATE
    + f""", c as (select g.item_id, g.i, g.doc_id, g.j, wa.start as start_a, wb.start as start_b, round(({' + '.join(f'wa.s{d} * wb.s{d}' for d in range(DIMS))}) / (sqrt({' + '.join(f'wa.s{d} * wa.s{d}' for d in range(DIMS))}) * sqrt({' + '.join(f'wb.s{d} * wb.s{d}' for d in range(DIMS))})), 6) as similarity
    from g join wa on wa.item_id = g.item_id and wa.start between g.i - 8 and g.i join wb on wb.doc_id = g.doc_id and wb.start between g.j - 8 and g.j where g.similarity > 0.9 and wa.n_known > 0 and wb.n_known > 0)
select item_id, i::int as i, doc_id, j::int as j, start_a::int as start_a, start_b::int as start_b, similarity from (select *, row_number() over (partition by item_id, i, doc_id, j order by similarity desc, start_a, start_b) as r from c) where r = 1
"""
)

SPACES = "\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def oracle_sql() -> dict[str, str]:
    seeds2 = "select item_id, substr(text, i + 1, 2) as seed, i as pos from (select item_id, text, unnest(range(0, greatest(length(text) - 1, 0))) as i from benchmark)"
    quoted = "|".join(sorted(TERMS, key=lambda t: (-len(t), t)))
    categories = " ".join(f"when contains('{m}', term) then '{n}'" for n, m in T.CATEGORIES)
    return {
        "cosine_matrix": _pairwise("coalesce(list_cosine_similarity(x.e, y.e), 0)"),
        "dot_matrix": _pairwise("list_dot_product(x.e, y.e)"),
        "euclid_matrix": _pairwise("list_distance(x.e, y.e)"),
        "cosine_distance": _pairwise("1 - coalesce(list_cosine_similarity(x.e, y.e), 0)"),
        "clean_text": f"select page_id, translate(replace(translate(replace(regexp_replace(replace(regexp_replace(html, '[{SPACES}]+', '', 'g'), '{T.MARKER}', ''), '<.+?>', '', 'g'), '¶', ''), '{_q(T.REMOVE_FIRST)}', ''), '{T.REMOVE_PAIR}', ''), '{_q(T.REMOVE_REST)}', '') as cleaned from pages",
        "strip_punct": f"select doc_id, md5(s) as stripped_md5, length(s)::int as n_chars_left from (select doc_id, translate(text, '{T.QUERY_PUNCTUATION}', '') as s from documents)",
        "sent_split": "select doc_id, (i - 1)::int as pos, s[i] as sentence from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from (select doc_id, string_split_regex(text, '[\\n。？！．]') as s from documents))",
        "phrase_split": "select item_id, (i - 1)::int as pos, s[i] as phrase from (select item_id, s, unnest(range(1, len(s) + 1)) as i from (select item_id, string_split_regex(text, '[。？！；：、，「」『』《》 *()○]') as s from benchmark))",
        "char_tokens": "select item_id, (i - 1)::int as pos, s[i] as token from (select item_id, s, unnest(range(1, len(s) + 1)) as i from (select item_id, string_split(text, '') as s from benchmark))",
        "dict_tokens": f"select doc_id, len(t)::int as n_tokens, md5(array_to_string(t, '|')) as tokens_md5 from (select doc_id, regexp_extract_all(text, '(?s)({quoted}|.)') as t from documents)",
        "find_all": "select doc_id, i::int as at from (select doc_id, text, unnest(range(0, greatest(length(text) - 2, 0))) as i from documents) where substr(text, i + 1, 3) = 'the'",
        "seed_index": f"select item_id, seed, string_agg(pos::varchar, ',' order by pos) as positions from ({seeds2}) where translate(seed, '一二三四五六七八九十百千', '') <> '' group by 1, 2",
        "term_category": f"select term, n, case {categories} else 'other' end as category from (select term, count(*) as n from (select unnest(string_split(text, '')) as term from documents) where term <> '' group by 1)",
        "group_rows": "select conv_id, count(*)::int as n, string_agg(role, ',' order by turn, role) as roles from conversations group by 1",
        "doc_vectors": DOC + "select doc_id, dim::int as dim, round(value, 6) as value from dv",
        "doc_similarity": _doc_pairs("coalesce(list_cosine_similarity(x.e, y.e), 0)"),
        "doc_distance": _doc_pairs("list_distance(x.e, y.e)"),
        "sent_vectors": SENT + "select doc_id, sent::int as sent, max(n)::bigint as n, round(sqrt(sum(value * value)), 6) as norm, round(max(value) filter (where dim = 0), 6) as v0 from sv group by 1, 2",
        "doc_sentence_means": SENT + ", dm as (select doc_id, dim, avg(value) as value, count(*) as n from sv group by 1, 2) select doc_id, max(n) as n_sentences, round(sqrt(sum(value * value)), 6) as norm, round(max(value) filter (where dim = 0), 6) as v0 from dm group by 1",
        "vector_sum": f"select label, dim::int as dim, round(sum(v), 5) as value from {LONG} l join embeddings e on e.vec_id = l.vec_id group by 1, 2",
        "center_space": f"with l as {LONG}, m as (select dim, avg(v) as m from l group by 1) select vec_id as token, round(sqrt(sum((v - m) * (v - m))), 6) as norm from l join m on l.dim = m.dim group by 1",
        "vocab_coverage": f"select count(*) as n_words, count(*) filter (where {HID} % 10 <> 0) as n_covered from (select distinct token from {words('documents', 'doc_id')})",
        "pair_filter": GLOSSARY + "select ord, src as first, tgt as second from p",
        "pair_flip": GLOSSARY + "select ord, tgt as first, src as second from p",
        "pair_similarity": PAIR + "select * from sim",
        "pair_similarity_stats": PAIR + "select count(similarity) as n, round(avg(similarity), 6) as mean, round(stddev_samp(similarity), 6) as std, max(similarity) as max, min(similarity) as min, round(median(similarity), 6) as median from sim",
        "embedding_merge": "select vec_id as token, round(case when label = 0 then -embedding[1]::double else embedding[1]::double end, 6) as v0 from embeddings",
        "search_length": f"select item_id, n::int as n_tokens, {QLEN} as search_len from (select item_id, len({WORDS}) as n from benchmark)",
        "length_stats": f"select count(n) as n, sum(n)::bigint as total, round(avg(n), 6) as mean, median(n)::double as median from (select len({WORDS}) as n from benchmark)",
        "window_vectors": f"select doc_id, start::int as start, n_known::int as n_known, round(sqrt({SELF}) / nullif(n_known, 0), 6) as norm, round(s0 / nullif(n_known, 0), 6) as v0 from {_windows('documents', 'doc_id', 10)}",
        "passage_search_topk": SEARCH + 'select h.query_id, rank::int as rank, start, start + len - 1 as "end", similarity from hits h join q on q.query_id = h.query_id where rank <= 10',
        "global_rank": SEARCH + "select query_id, gold_start, predicted_rank, n_windows from ranks",
        "sim_stats": SEARCH + "select query_id, count(*) as n_windows, round(avg(similarity), 5) as mean_sim, round(stddev_pop(similarity), 5) as std_sim from sims group by 1",
        "locate_phrase": SEARCH + "select query_id, gold_start from gold",
        "merge_islands": SEARCH + 'select query_id, cluster_no::int as cluster_no, "begin", "end", best_rank::int as best_rank, optimal_start, n_hits from clusters',
        "cluster_rank": SEARCH + "select query_id, cluster_no::int as cluster_no, best_rank::int as best_rank, similarity from clusters",
        "overlap_pct": SEARCH + "select query_id, cluster_no::int as cluster_no, round(pct, 6) as pct from over",
        "hit_flags": SEARCH + "select query_id, top_full, near_full, any_full, top_some, near_some, any_some, best_overlap_rank::int as best_overlap_rank, first_hit_rank::int as first_hit_rank, best_partial_rank::int as best_partial_rank from flags",
        "run_summary": SEARCH + SUMMARY + "select * from summary",
        "shared_seeds": SEEDS + "select distinct seed from m",
        "match_locations": SEEDS + "select item_id, i::int as i, doc_id, j::int as j from m",
        "chunk_gate": GATE + "select item_id, i::int as i, doc_id, j::int as j, similarity from g where similarity > 0.9",
        "best_location": GATE + "select item_id, doc_id, i::int as i, j::int as j, similarity from (select *, row_number() over (partition by item_id, doc_id order by similarity desc, i, j) as r from g where similarity > 0.9) where r = 1",
        "optimize_start": STARTS,
        "passage_search_euclid": _search(replace(CONFIG, metric="euclidean")) + 'select h.query_id, rank::int as rank, start, start + len - 1 as "end", similarity from hits h join q on q.query_id = h.query_id where rank <= 10',
        "merge_greedy": SEARCH + GREEDY,
        "run_report": SEARCH + SUMMARY + _run_report(CONFIG),
        "phrase_report": SEARCH + _report(),
        "across_report": _search(ACROSS, MISSING) + _report(ACROSS),
        "across_summary": _search(ACROSS, MISSING) + SUMMARY + "select * from summary",
        "param_grid": _grid(),
        "phrase_vectors": PHRASES,
        "shared_seeds_vec": SEED_VECTORS,
        "random_pair_stats": RANDOM,
        "project_space": f"select vec_id::varchar as token, dim::int as dim, round(2 * v, 5) as value from {LONG} where dim < 16",
        "dict_sentences": f"""select item_id, (i - 1)::int as sent, array_to_string(w[i], '|') as words from (select item_id, w, unnest(range(1, len(w) + 1)) as i from (select item_id,
            list_filter(list_transform(list_filter(string_split_regex(text, '[\\n。？！．]'), lambda s: s <> ''), lambda s: flatten(list_transform(string_split_regex(s, '[。？！；：、，「」『』《》 *()○]'), lambda p: regexp_extract_all(p, '(?s)({quoted}|.)')))), lambda x: len(x) > 0) as w from benchmark))""",
        "gloss_labels": GLOSSARY + """, d as (select unnest(['the', 'and', 'was']) as k, unnest(['article', 'conjunction', 'verb']) as v)
            select ord, case when a.v is null then '' else src || a.v end as first_label, case when a.v is null then '' else tgt || coalesce(b.v, a.v) end as second_label from p left join d a on a.k = src left join d b on b.k = tgt""",
        "reparse_words": f"select item_id, array_to_string(regexp_extract_all(array_to_string({WORDS}, ''), '(?s)({quoted}|.)'), '|') as words from benchmark",
    }
