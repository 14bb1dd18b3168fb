"""DuckDB SQL for the same rows as the queries of merkle, spelling and contamination, written for all rows."""

from __future__ import annotations

A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def crc32(codes: str) -> str:
    """The crc32 of a list of bytes, bit by bit."""
    bits = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, xor(crc, code::bigint))"
    return f"xor(list_reduce({codes}, lambda crc, code: {bits}, 4294967295), 4294967295)"


def merkle_sql(levels: int = 9) -> str:
    """Level by level: a tree of 16 ** levels leaves at most."""
    fields = ", ".join(f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c} end" for c in ("doc_id", "source", "lang", "n_chars"))
    parts = [
        f"""leaves as (select *, sha256(concat({fields}, case when text is null then '-' else strlen(text) || ':' || text end)) leaf,
    coalesce({crc32("list_transform(string_split(doc_id::varchar, ''), lambda x: unicode(x))")} % 5 = 0, false) hit,
    sha256(concat({fields}, case when text is null then '-' else strlen(text) || ':' || translate(text, {A_Z}) end)) changed from documents)""",
        """s0 as (select coalesce('=' || source, '') tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 rank, count(*) over (partition by source) n,
    leaf digest, doc_id, leaf, case when hit then changed else leaf end now from leaves)""",
    ]

    def climb(name: str) -> None:
        for k in range(levels):
            parts.append(
                f"""{name}{k + 1} as (select tree, rank // 16 rank, any_value((n + 15) // 16) n, case when any_value(n) > 1 then sha256(string_agg(digest, '' order by rank)) else any_value(digest) end digest
    from {name}{k} group by tree, rank // 16)"""
            )
        for k in range(levels):
            run = "over (partition by tree, rank // 16 order by rank rows between"
            parts.append(
                f"""{name}_side{k} as (select tree, rank, n > 1 real, coalesce(string_agg(digest, '') {run} unbounded preceding and 1 preceding), '') before,
    coalesce(string_agg(digest, '') {run} 1 following and unbounded following), '') after from {name}{k})"""
            )

    climb("s")
    parts.append(f"t0 as (select 0 tree, row_number() over (order by tree) - 1 rank, count(*) over () n, digest, tree name from s{levels})")
    climb("t")
    steps = [("s", k) for k in range(levels)] + [("t", k) for k in range(levels)]
    rows = "d0"
    parts.append(f"d0 as (select s0.doc_id, s0.leaf, s0.now folded, '' proof, s0.tree, s0.rank, t0.digest subroot, t0.rank above, t{levels}.digest root from s0 join t0 on t0.name = s0.tree cross join t{levels})")
    for i, (name, k) in enumerate(steps):
        key = f"x.tree = d.tree and x.rank = d.rank // {16**k}" if name == "s" else f"x.rank = d.above // {16**k}"
        parts.append(f"""d{i + 1} as (select d.* replace (case when x.real then sha256(x.before || d.folded || x.after) else d.folded end as folded,
    case when x.real then d.proof || x.before || x.after else d.proof end as proof) from d{i} d join {name}_side{k} x on {key})""")
        rows = f"d{i + 1}"
    return "with " + ",\n".join(parts) + f"\nselect doc_id, leaf, subroot, root, sha256(proof) proof_sha256, folded folded_root, folded = root verified from {rows}"


WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def contamination_sql() -> str:
    """Windows as joined words, met by equality."""

    def runs(table: str, key: str) -> str:
        return f"(select {key}, regexp_extract_all(translate(coalesce(text, ''), {A_Z}), {WORD}) w from {table})"

    return f"""
with d as (select row_number() over () id, doc_id, w from {runs("documents", "doc_id")}),
i as (select coalesce(item_id::varchar, '') item, w from {runs("benchmark", "item_id")} where len(w) > 0),
win as (select distinct item, least(len(w), 10) n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') s
  from (select item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) p from i)),
places as (select id, p, n, array_to_string(w[p : p + n - 1], ' ') s from (select id, w, n, unnest(range(1, len(w) - n + 2)) p from d cross join (select distinct n from win))),
found as (select id, p, places.n, item from places join win on win.n = places.n and win.s = places.s),
hit as (select id, count(distinct q) n_hit from (select id, unnest(range(p, p + n)) q from found) group by id),
items as (select id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) names from found group by id)
select doc_id, len(w) n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hit using (id) left join items using (id)
"""


def spelling_sql() -> str:
    """Near words by deletions: a replacement leaves the same rest at one place, an insertion the shorter word."""
    code = "case when unicode(x) < 128 then [unicode(x)] else [195, unicode(x) - 64] end"  # UTF-8 of U+00C0 to U+00FF
    return f"""
with recursive run as (select coalesce(doc_id::varchar, '') || ':' id, unnest(regexp_extract_all(translate(coalesce(text, ''), {A_Z}), '[a-zÀ-ÿ]+')) run from documents),
distinct_runs as (select id, run, count(*) n from run where length(run) >= 7 group by all),
hashed as (select *, {crc32(f"flatten(list_transform(string_split(id || run, ''), lambda x: {code}))")} h from distinct_runs),
slipped as (select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end word, n from hashed),
words as (select word, sum(n)::bigint n from slipped where length(word) >= 7 group by word having sum(n) >= 2),
rest as (select word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) rest from (select *, unnest(range(1, length(word) + 1)) p from words)),
near as (select a.word, b.word form, b.n form_n from rest a join rest b on a.rest = b.rest and a.p = b.p and a.word <> b.word
  union select a.word, b.word, b.n from words a join rest b on a.word = b.rest
  union select b.word, a.word, a.n from words a join rest b on a.word = b.rest),
best as (select word, count(*) n_near, first(form order by form_n desc, form) form, max(form_n) form_n from near group by word),
forms as (select word, n, coalesce(n_near, 0)::bigint n_near, case when form_n >= 10 * n then form end form, case when form_n >= 10 * n then form_n end form_n from words left join best using (word)),
chain as (select word, form here, 1 step from forms where form is not null union all select chain.word, forms.form, step + 1 from chain join forms on forms.word = chain.here where forms.form is not null),
ends as (select word, last(here order by step) root from chain group by word)
select word, form, coalesce(root, word) root, n, n_near, form_n from forms left join ends using (word)
"""
