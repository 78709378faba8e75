"""op11_vector_codes in DuckDB's SQL, its rounds written out."""

from __future__ import annotations

PARTS, ENTRIES, ROUNDS = 8, 16, 6

KEPT = """kept as (select row_number() over () as row, vec_id, label, [floor(4096 * x::double)::bigint for x in embedding] as v from embeddings
        where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
    part as (select row, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] as x from kept, range({parts}) r(p)),
    book0 as (select p, e, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] as c from (select v, row_number() over (order by vec_id, v) - 1 as e from kept where vec_id is not null qualify e < {entries}), range({parts}) r(p))"""
#: The nearest entry of each part: least squared distance, then least index.
NEAREST = """near{n} as (select row, p, min(struct_pack(d := d, e := e)) as best from (select row, part.p, e, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x, c)])::bigint as d from part join book{n} on book{n}.p = part.p) group by all)"""
UPDATE = """book{m} as (select b.p, b.e, coalesce(u.c, b.c) as c from book{n} b left join (select p, e, list(floor(total / n)::bigint order by i) as c from
        (select part.p, best.e as e, i, sum(x[i])::double as total, count(*) as n from part join near{n} using (row, p), range(1, 1025) r(i) where i <= len(x) group by all) group by p, e) u on u.p = b.p and u.e = b.e)"""


def sql() -> str:
    steps = [KEPT.format(parts=PARTS, entries=ENTRIES)]
    for n in range(ROUNDS):
        steps += [NEAREST.format(n=n), UPDATE.format(n=n, m=n + 1)]
    steps.append(NEAREST.format(n=ROUNDS))
    return (
        "with " + ",\n    ".join(steps) + f""",
    coded as (select vec_id, label, string_agg(printf('%02x', best.e), '' order by p) as code, sum(best.d)::bigint as error from near{ROUNDS} join kept using (row) group by row, vec_id, label),
    digest as (select sha256(string_agg(c::varchar, ',' order by p, e, i)) as codebooks_sha256 from (select p, e, unnest(c) as c, unnest(range(len(c))) as i from book{ROUNDS}))
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded, digest"""
    )
