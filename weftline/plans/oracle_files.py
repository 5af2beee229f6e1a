"""DuckDB SQL of the queries that go through files: what they must read back."""

from __future__ import annotations

from weftline.functions import text as T
from weftline.plans import oracle as O
from weftline.plans.files import LEFT_OUT, MAPPING, REMOVED


def cleaned(c: str, keep: str = "", other: tuple[str, ...] = (), blanks: bool = False) -> str:
    c = f"translate({c}, ' \t', '')" if blanks else f"regexp_replace({c}, '[{O.SPACES}]+', '', 'g')"
    c = f"replace(regexp_replace(replace({c}, '{T.MARKER}', ''), '<.+?>', '', 'g'), '¶', '')"
    for x in other:
        c = f"regexp_replace({c}, '{x}', '', 'g')"
    first, rest = ("".join(x for x in y if x not in keep) for y in (T.REMOVE_FIRST, T.REMOVE_REST))
    return f"translate(replace(translate({c}, '{O._q(first)}', ''), '{T.REMOVE_PAIR}', ''), '{O._q(rest)}', '')"


def oracle_sql() -> dict[str, str]:
    marked = f"string_split(regexp_replace(replace(translate(text, 'e', '{T.SYLLABLE}'), '{T.SYLLABLE} ', ' '), '{T.SYLLABLE}$', ''), ' ')"
    pairs = O.GLOSSARY + "select src, tgt, count(*) as n from p group by 1, 2"
    return {
        "csv_rows": "select conv_id, turn::bigint as turn, role, md5(text) as text_md5 from conversations",
        "alignment_phrases": f"select query_id, row_no, query_md5 from (select row_no, row_number() over (order by row_no) - 1 as query_id, md5(reverse(text)) as query_md5 from (select *, row_number() over (order by item_id) - 1 as row_no from benchmark) where item_id % 3 <> 0) where query_id not in ({', '.join(map(str, LEFT_OUT))})",
        "text_files": "select item_id, md5(text || chr(10)) as text_md5 from benchmark",
        "clean_files": f"select item_id, {cleaned(f"translate(text, '{''.join(MAPPING)}', '{''.join(MAPPING.values())}')")} as text from benchmark",
        "folder_texts": "select md5(text || chr(10)) as text_md5, count(*) as n from benchmark group by 1",
        "vec_file": "select vec_id as token, len(embedding)::int as n, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm, round(embedding[1]::double, 6) as v0 from embeddings",
        "utterances": "select md5(text) as text_md5, count(*) as n from documents where text is not null group by 1",
        "pair_file": pairs,
        "similarity_file": O.PAIR + "select * from sim",
        "term_list": f"select row_number() over (order by length(token) desc, token) - 1 as place, token as term from (select distinct token from {O.words('benchmark', 'item_id')})",
        # at a place all prefixes of the text that are terms meet it; the longest counts, and the walk goes on behind it
        "dictionary_tokens": f"""with recursive d as (select token from {O.words('documents', 'doc_id')} where length(token) >= 4 union select token from {O.words('benchmark', 'item_id')}),
            l as (select distinct length(token) as k from d),
            m as (select item_id, i, max(k) as k from (select item_id, text, unnest(range(1, length(text) + 1)) as i from benchmark) b, l where i + k - 1 <= length(text) and substr(text, i, k) in (select token from d) group by 1, 2),
            s as (select b.item_id, i, coalesce(m.k, 1) as k from (select item_id, unnest(range(1, length(text) + 1)) as i from benchmark) b left join m using (item_id, i)),
            w as (select item_id, 1::bigint as i from benchmark where length(text) > 0 union all select w.item_id, w.i + s.k from w join s on s.item_id = w.item_id and s.i = w.i where w.i + s.k <= (select length(text) from benchmark b where b.item_id = w.item_id))
            select b.item_id, count(w.i)::int as n, coalesce(string_agg(substr(text, w.i, s.k), '|' order by w.i), '') as tokens from benchmark b left join w on w.item_id = b.item_id left join s on s.item_id = w.item_id and s.i = w.i group by b.item_id""",
        "first_lines": f"select token as term from (select token, count(*) as n from {O.words('documents', 'doc_id')} group by 1) order by n desc, token limit 100",
        "report_files": f"select query_id, md5(report || chr(10)) as report_md5 from ({O.SEARCH + O._report()})",
        "compiled_lines": "select md5(line) as line_md5, count(*) as n from (select unnest(string_split(text, chr(10))) as line from documents where text is not null) group by 1",
        "target_words": f"select doc_id, len(w)::int as n, md5(array_to_string(w, '|')) as words_md5 from (select doc_id, list_filter({marked}, lambda x: x <> '') as w from documents)",
        "gold_words": f"select item_id, len(w)::int as n, array_to_string(w, '|') as words from (select item_id, {marked} as w from benchmark)",
        "removed_words": f"select doc_id, (i - 1)::int as sent, count(*) as n, min(token) as least, max(token) as most from (select doc_id, i, unnest(string_split(s[i], ' ')) as token from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from (select doc_id, string_split(replace(text, '{REMOVED}', ' '), chr(10)) as s from documents))) where token <> '' group by 1, 2",
        "space_words": "select doc_id, len(w)::int as n, md5(array_to_string(w, '|')) as words_md5 from (select doc_id, string_split(text, ' ') as w from documents)",
        "clean_kept": f"select page_id, {cleaned('html', T.KEEP_PUNCTUATION, ('[Q-Z]+', 'é.'), blanks=True)} as cleaned from pages",
        "whole_phrases": O.PHRASES.rsplit("select item_id, max(n)", 1)[0] + f""", k as (select item_id, {O.HID} as hid from (select item_id, array_to_string({O.WORDS}, ' ') as token from benchmark)),
            f as (select item_id, dim, v from k join {O.LONG} l on vec_id = hid where hid % 10 <> 0),
            b as (select coalesce(m.item_id, f.item_id) as item_id, coalesce(m.dim, f.dim) as dim, coalesce(f.v, m.value) as value from m full join f on m.item_id = f.item_id and m.dim = f.dim)
            select item_id, round(sqrt(sum(value * value)), 6) as norm, round(max(value) filter (where dim = 0), 6) as v0 from b group by 1""",
        "first_labels": "select min(vec_id) as ord, label from embeddings group by label",
    }
