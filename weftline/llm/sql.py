"""DuckDB SQL for the queries that SQL can express. The others are tested against brute force in tests/llm."""

from __future__ import annotations

from weftline.llm.quality import FENCE, GAP, METRICS, MIN_ROWS, MIN_WORDS, NOISE, QUANTILES, TAIL
from weftline.llm.sql_codes import codes_sql
from weftline.llm.sql_spelling import spelling_sql


def _quality() -> str:
    metric = " union all ".join(f"select doc_id, lang, source, '{k}' as metric, ({m.replace(' div ', ' // ')})::bigint as v from base where not base_failed" for k, (m, _) in METRICS.items())
    shift = "greatest(length(bin(v)) - 6, 0)"
    low = "((bucket - greatest(bucket // 32 - 1, 0) * 32) << greatest(bucket // 32 - 1, 0)::int)"
    rule = "case metric " + " ".join(f"when '{k}' then '{r}'" for k, (_, r) in METRICS.items()) + " end"
    far = f"case when q99 > q95 then q99 + {TAIL} * (q99 - q95) end"
    spread = f"case when q75 > q25 then {FENCE} * (q75 - q25) end"

    def level(name: str, *by: str) -> str:
        keys = ", ".join([*by, "metric"])
        at = ", ".join(f"min(low) filter (where upto * 100 >= total * {q}) as q{q}" for q in QUANTILES)
        return f"""
        {name}_m as (select {keys}, bucket, {low} as low, sum(n) as n from fine group by {keys}, bucket),
        {name}_c as (
            select *, sum(n) over (partition by {keys} order by bucket) as upto, sum(n) over (partition by {keys}) as total,
                (lead(low) over (partition by {keys} order by bucket) + {NOISE})::double / (low + {NOISE}) as wide from {name}_m),
        {name}_q as (
            select {keys}, max(total) as total, {at},
                max_by(floor(sqrt(wide) * (low + {NOISE}))::bigint - {NOISE}, wide) filter (where wide >= {GAP} and upto * 4 >= total * 3) as gap
            from {name}_c group by {keys}),
        {name} as (
            select *, case {rule} when 'quartiles' then q75 + {spread} when 'gap' then coalesce(gap, {far}) else {far} end as hi,
                case {rule} when 'quartiles' then q25 - {spread} end as lo from {name}_q),"""

    tests = []
    for k, (m, _) in METRICS.items():
        v = f"({m.replace(' div n_words', ' // nullif(n_words, 0)').replace(' div ', ' // ')})"
        for x, sign in (("hi", "<="), ("lo", ">=")):
            tests.append(f"coalesce({v} {sign} (select {x} from lim where lim.lang = b.lang and lim.source = b.source and metric = '{k}'), true)")
    return f"""
    with words as (
        select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text,
            regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
    grams as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) as i from words)),
    twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from grams) where n > 1),
    covered as (select doc_id, count(distinct i + o) as n from twice, (select unnest([0, 1, 2]) as o) group by doc_id),
    counts as (
        select doc_id, lang, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
            length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
            list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from words),
    signals as (
        select c.doc_id, lang, source, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, len(lines)::bigint as n_lines,
            (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words
        from counts c left join covered v on c.doc_id = v.doc_id),
    base as (select *, (n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words) as base_failed from signals),
    long as ({metric}),
    fine as (select lang, source, metric, {shift} * 32 + (v >> {shift}::int) as bucket, count(*) as n from long group by all),
    {level('a', 'lang', 'source')}{level('b', 'lang')}{level('c')}
    groups as (select distinct lang, source, metric from (select lang, source from base), (select unnest([{', '.join(f"'{k}'" for k in METRICS)}]) as metric)),
    lim as (
        select g.lang, g.source, g.metric, coalesce(a.lo, b.lo, c.lo) as lo, coalesce(a.hi, b.hi, c.hi) as hi from groups g
        left join a on a.lang = g.lang and a.source = g.source and a.metric = g.metric and a.total >= {MIN_ROWS}
        left join b on b.lang = g.lang and b.metric = g.metric and b.total >= {MIN_ROWS}
        left join c on c.metric = g.metric)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and {' and '.join(tests)}) as kept from base b
    """


MIXING = """
with s as (select coalesce(source, '') as src, sum(coalesce(length(text), 0))::double as chars from documents group by 1),
t as (select sum(chars) as chars, count(*) filter (where chars > 0)::double as weight from s),
r as (select src, case when s.chars > 0 then 1.0::double * t.chars / (s.chars * t.weight) else 0 end as rate from s, t),
q as (select src, rate / greatest(ceil(rate / 16), 1) as rate, greatest(ceil(rate / 16), 1)::bigint as parts from r),
d as (
    select doc_id, source, md5(coalesce(text, '')) as text_md5, src, part,
        (('0x' || substr(md5('2011:' || coalesce(doc_id::varchar, '') || case when part > 1 then ':' || part::varchar else '' end), 1, 13))::bigint) / 4503599627370496.0::double as u
    from (select *, unnest(range(1, parts + 1)) as part from documents join q on src = coalesce(source, ''))),
cdf as (
    with recursive c as (
        select src, rate, 0 as k, exp(-rate) as p, exp(-rate) as cdf from q
        union all select src, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) from c where k < 64)
    select src, k, cdf from c),
n as (
    select doc_id, source, text_md5, sum(k)::int as n_copies from (select doc_id, source, text_md5, (select min(k) from cdf where cdf.src = d.src and cdf.cdf > d.u) as k from d)
    group by all),
e as (select *, unnest(range(1, n_copies + 1))::int as copy_no from n where n_copies > 0)
select doc_id, source, n_copies, copy_no, ('0x' || substr(md5('2012:' || coalesce(doc_id::varchar, '') || ':' || copy_no::varchar), 1, 13))::bigint as order_key, text_md5 from e
"""

WARC = """
with p as (select page_id, url, coalesce(html, '') as html from pages),
d as (select page_id, url, strlen(html)::bigint as payload_bytes, sha1(html) as h, max(page_id) over (partition by html) as last from p)
select page_id, payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, ((i // 4) * 5 + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31))::int, 1)), '') as payload_digest,
    case when page_id = last then 'response' else 'revisit' end as record_type,
    case when page_id = last then null else last end as refers_to, url
from d
"""

CHAT = r"""
with c as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
e as (select *, replace(replace(text, '\', '\\'), '<|', '<\|') as text_e, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<|nl|>') as role_e from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
    sum(length('<|im_start|>' || role_e || chr(10) || text_e || '<|im_end|>' || chr(10)))::bigint as formatted_chars
from e group by conv_id
"""


def _near(size: int, similar: int, last: str) -> str:
    """Components of documents whose sets of shingles of ``size`` words are similar, with a last column."""
    return f"""
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w,
        count(*) over (partition by coalesce(text, '')) as copies from documents),
s as (select distinct doc_id, array_to_string(w[i : i + {size - 1}], ' ') as g from (select doc_id, w, unnest(range(1, case when len(w) >= {size} then len(w) - {size - 2} else least(len(w), 1) + 1 end)) as i from w)),
n as (select doc_id, count(*) as n from s group by 1),
k as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from k join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * k >= {similar} * (nx.n + ny.n - k)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id as d, doc_id as c from documents union select e.y, r.c from r join e on e.x = r.d)
select w.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, {last}
from w left join n on n.doc_id = w.doc_id join (select d, min(c) as component_id from r group by 1) on d = w.doc_id
"""


JACCARD = _near(5, 80, "case when n is null then 1 else copies end as n_equal_texts")
SKETCH = _near(3, 85, "w.doc_id = component_id as kept")


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard": JACCARD, "op3_quality": _quality(), "op6_mixing": MIXING, "op7_warc": WARC, "op10_chat": CHAT, "op11_spelling": spelling_sql(), "op12_sketch": SKETCH, "op13_codes": codes_sql()}
