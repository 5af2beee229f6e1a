"""DuckDB SQL of the spelling variants: words meet by all of their patterns with one letter left open."""

from __future__ import annotations

from weftline.llm.spelling import DIVISOR, LETTERS, MIN_COUNT, MIN_LENGTH, TIMES

#: The polynomial of CRC-32, its bits reversed.
POLYNOMIAL = 0xEDB88320


def _steps() -> list[int]:
    """What a byte does to a checksum."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (POLYNOMIAL if c & 1 else 0)
        out.append(c)
    return out


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a string expression's UTF-8 bytes."""
    digit = lambda at: f"(instr('0123456789ABCDEF', substr(hex(encode({text})), {at}, 1)) - 1)"
    data = f"list_transform(range(1, octet_length(encode({text})) * 2, 2), lambda i: {digit('i')} * 16 + {digit('i + 1')})"
    steps = "[" + ", ".join(f"{x}::bigint" for x in _steps()) + "]"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {data}), lambda a, b: xor(a >> 8, ({steps})[(xor(a, b) & 255) + 1])), 4294967295::bigint)"


def spelling_sql() -> str:
    return f"""
    with recursive r as (
        select doc_id, run, count(*) as k from (
            select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{LETTERS}]+')) as run from documents)
        where length(run) >= {MIN_LENGTH} group by all),
    h as (select run, k, {crc32_sql("(doc_id::varchar || ':' || run)")} as h from r),
    w as (select case when h % {DIVISOR} = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, k from h),
    v as materialized (select word, sum(k)::bigint as n from w where length(word) >= {MIN_LENGTH} group by word having sum(k) >= {MIN_COUNT}),
    p as materialized (
        select word, n, left(word, i::int) || '*' || substr(word, i::int + 2) as p from (select word, n, unnest(range(0, length(word))) as i from v)
        union all select word, n, left(word, i::int) || '*' || substr(word, i::int + 1) from (select word, n, unnest(range(0, length(word) + 1)) as i from v)),
    e as materialized (select distinct a.word, b.word as near, b.n as near_n from p a join p b on a.p = b.p and a.word <> b.word),
    f as materialized (
        select v.word, v.n, count(e.near) as n_near, min(struct_pack(m := -e.near_n, w := encode(e.near))) filter (where e.near_n >= {TIMES} * v.n) as b,
        from v left join e on e.word = v.word group by v.word, v.n),
    g as materialized (select word, n, n_near, decode(b.w) as form, -b.m as form_n from f),
    u as (select word, word as at, 0 as d from v union all select u.word, g.form, d + 1 from u join g on g.word = u.at where g.form is not null)
    select g.word, form, (select max_by(u.at, u.d) from u where u.word = g.word) as root, n, n_near, form_n from g
    """
