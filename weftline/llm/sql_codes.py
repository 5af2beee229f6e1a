"""DuckDB SQL of the vector codes: every round spelled out, every distance computed."""

from __future__ import annotations

from weftline.llm.codebooks import ENTRIES, PARTS, ROUNDS, SCALE


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    def assigned(r: int) -> str:
        return f"""
    near{r} as materialized (
        select vec_id, part, min(d * {entries} + entry) // {entries} as d, min(d * {entries} + entry) % {entries} as entry from (
            select c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x))::bigint as d from cells c join book{r} b on b.part = c.part and b.pos = c.pos group by all) group by all)"""

    steps = [assigned(0)]
    for r in range(rounds):
        steps.append(f"""
    sums{r} as (select c.part, n.entry, c.pos, sum(c.x) as s, count(*) as n from cells c join near{r} n on n.vec_id = c.vec_id and n.part = c.part group by all),
    book{r + 1} as materialized (
        select b.part, b.entry, b.pos, coalesce(((s - ((s % n) + n) % n) // n)::bigint, b.x) as x
        from book{r} b left join sums{r} t on t.part = b.part and t.entry = b.entry and t.pos = b.pos)""")
        steps.append(assigned(r + 1))
    return f"""
    with kept as (
        select vec_id, label, embedding::double[] as v from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    cells as materialized (
        select vec_id, (i - 1) // (len(v) // {parts}) as part, (i - 1) % (len(v) // {parts}) as pos, floor({scale} * v[i])::bigint as x
        from (select vec_id, v, unnest(range(1, len(v) + 1)) as i from kept)),
    first as (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept order by vec_id limit {entries}),
    book0 as materialized (select part, entry, pos, x from cells join first using (vec_id)),{','.join(steps)},
    done as (
        select vec_id, string_agg(printf('%02x', entry::int), '' order by part) as code, sum(d)::bigint as error from near{rounds} group by vec_id),
    labelled as (select d.*, label from done d join kept k using (vec_id)),
    total as (select label, sum(error)::bigint as label_error from labelled group by label),
    digest as (select sha256(string_agg(x::varchar, ',' order by part, entry, pos)) as codebooks_sha256 from book{rounds})
    select vec_id, code, error, label_error, codebooks_sha256 from labelled l join total t on l.label is not distinct from t.label, digest
    """
