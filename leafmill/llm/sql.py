"""DuckDB SQL for the queries that SQL can express over the whole tables."""

from __future__ import annotations

from .license_scan import COPYRIGHT_LINE, KNOWN, SPELLINGS
from .poisson_mix import SEED, TEMPERATURE

OP9 = r"""
with n as (
  select doc_id, length(coalesce(text, '')) as size,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
  from documents
)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by norm) as group_size,
       row_number() over w = 1 as kept,
       sha256(norm) as text_sha256
from n
window w as (partition by norm order by size desc, doc_id nulls last)
"""

_UPPER, _SPACE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}')"

OP12 = f"""
with d as (select row_number() over () as row_nr, doc_id, {_TERMS} as terms from documents),
q as (select row_number() over () as item_nr, item_id, unnest({_TERMS}) as term from benchmark),
asked as (select item_nr, item_id, term, count(*) as repeats from q group by all),
t as (select row_nr, doc_id, len(terms) as n, unnest(terms) as term from d),
p as (select row_nr, doc_id, n, term, count(*) as tf from t where term in (select term from asked) group by all),
w as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from p, (select count(*) as n_docs from d where len(terms) > 0) group by term, n_docs
),
s as (
  select item_nr, item_id, row_nr, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint as score
  from asked join p using (term) join w using (term), (select count(*) filter (len(terms) > 0) as n_docs, sum(len(terms))::bigint as n_terms from d)
  group by all
)
select item_id, rank, doc_id, score
from (select *, (row_number() over (partition by item_nr order by score desc, doc_id nulls last))::int as rank from s where score > 0)
where rank <= 20
"""

OP13 = f"""
with l as (
  select doc_id, row_nr, pos, line, translate(trim(line, {_SPACE}), '{_UPPER}', '{_UPPER.lower()}') as k
  from (
    select doc_id, row_nr, unnest(range(1, len(lines) + 1)) as pos, unnest(lines) as line
    from (select doc_id, row_number() over () as row_nr, string_split(coalesce(text, ''), chr(10)) as lines from documents)
  )
),
repeated as (
  select k, max(doc_id) as top from l where length(k) >= 20 group by k having count(distinct doc_id) >= 3
),
m as (select l.*, r.k is not null and l.doc_id <> r.top as dropped from l left join repeated r on l.k = r.k)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from m group by doc_id, row_nr
"""

OP10 = f"""
with c as (select source, count(*) as n_rows, round(pow(count(*)::double, {TEMPERATURE}) * 1e6) as wanted from documents group by source),
r as (
  select source, wanted / (select sum(wanted::decimal(38,0))::double from c) * (select sum(n_rows)::double from c) / n_rows as rate from c
),
tables as (
  select source, list(p order by k) as steps from (
    select source, k, sum(t) over (partition by source order by k) as p from (
      select source, k, exp(-rate) * list_reduce(list_concat([1.0::double], list_transform(range(1, k + 1), lambda i: rate / i)), lambda a, b: a * b) as t
      from r, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 24)::bigint + 1)) as u(k)
    )
  ) group by source
),
d as (
  select d.doc_id, d.source, md5(coalesce(d.text, '')) as text_md5,
         len(list_filter(steps, lambda p: p <= ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::varchar, '') || ':1'), 1, 13))::bigint::double / 4503599627370496.0))::int as repeats
  from documents d join tables t on d.source is not distinct from t.source
),
e as (select doc_id, source, text_md5, repeats, unnest(range(1, repeats + 1))::int as copy_no from d)
select doc_id, source, repeats, copy_no, text_md5,
       row_number() over (order by md5('{SEED}:' || coalesce(doc_id::varchar, '') || ':' || copy_no::varchar), doc_id, copy_no) - 1 as position
from e
"""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(expr: str) -> str:
    out = f"lower({expr})"
    steps = [(COPYRIGHT_LINE.replace("(?m)", ""), " ", "gm"), *((p, w, "g") for p, w in SPELLINGS), (r"[^\p{L}\p{N}]+", " ", "g")]
    for pattern, word, flags in steps:
        if "(?=" in pattern:  # DuckDB's patterns have no look-ahead: keep the digit
            pattern, word = pattern.replace("(?=[0-9])", "([0-9])"), word + (r"\2" if "|" in pattern else r"\1")
        out = f"regexp_replace({out}, {_literal(pattern)}, {_literal(word)}, '{flags}')"
    return f"trim({out})"


OP7 = f"""
with known as (
  select digest, min(license) as license from (
    select license, sha256({_canonical("t")}) as digest from (values {", ".join(f"({_literal(a)}, {_literal(b)})" for a, b in KNOWN)}) k(license, t)
  ) group by digest
),
l as (
  select doc_id, sha256({_canonical("line")}) as digest, regexp_matches(lower(line), {_literal(COPYRIGHT_LINE.replace("(?m)", ""))}) as notice
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents) where regexp_matches(line, '[\\p{{L}}\\p{{N}}]')
),
by_line as (
  select doc_id, count(license) as n_license_lines, count(license) + count(*) filter (license is null and notice) = count(*) as nothing_else
  from l left join known using (digest) group by doc_id
),
found as (
  select doc_id, license, false as whole from l join known using (digest)
  union all
  select doc_id, license, true from (select doc_id, sha256({_canonical("coalesce(text, '')")}) as digest from documents) join known using (digest)
),
by_doc as (
  select doc_id, min(case when whole then license end) as whole_license, string_agg(distinct license, ',' order by license) as licenses from found group by doc_id
)
select d.doc_id, coalesce(n_license_lines, 0) as n_license_lines, whole_license, coalesce(licenses, '') as licenses,
       whole_license is not null or (coalesce(n_license_lines, 0) > 0 and nothing_else) as is_license
from (select distinct doc_id from documents) d
left join by_line b on d.doc_id is not distinct from b.doc_id
left join by_doc f on d.doc_id is not distinct from f.doc_id
"""

ORACLES = {"op7_license_scan": OP7, "op9_exact_dedup": OP9, "op10_poisson_mix": OP10, "op12_hybrid_search": OP12, "op13_line_runs": OP13}
