"""DuckDB SQL that gives the rows of a registered query on the same tables."""

from __future__ import annotations

from .chat import TAILS
from .common import WORD
from .secret_scan import ACCESS, ASSIGN, ASSIGN_VALUE, FORGE, HEX, PEM

OP6 = rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped as (
  select *, regexp_replace(text, '([<\[])(\\*)({TAILS})', '\1\\\2\3', 'g') as e,
    length(regexp_replace(role, '([<\[])(\\*)({TAILS})', '\1\\\2\3', 'g')) as r from turns
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(e) + case role when 'user' then 15 when 'system' then 15 when 'assistant' then 4 else 17 + r end)::bigint as formatted_chars
from escaped group by conv_id
"""

OP7 = r"""
with rules(rhost, rpath, verdict) as (
  values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), parts as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages
), hits as (
  select page_id, host, path, max({'n': length(rhost || rpath), 'rule': rhost || rpath, 'verdict': verdict}) as hit
  from parts left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by all
)
select page_id, host, path, hit.rule as rule, coalesce(hit.verdict, 'allow') as verdict from hits
"""


def _spans(kind: str, pattern: str, keep: str = "true") -> str:
    """kind:start:end of all matches of a pattern; pieces between matches give their places."""
    quoted = pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{quoted}')) + 1), lambda k: {{
      's': list_sum(list_transform(regexp_split_to_array(t, '{quoted}')[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{quoted}')[:k - 1], lambda x: length(x))), 0),
      'n': length(regexp_extract_all(t, '{quoted}')[k]), 'kind': '{kind}', 'keep': {keep}}}), lambda x: x.keep)"""


_VALUE = ASSIGN_VALUE.replace("'", "''")
_KINDS = [
    ("assign", _spans("assign", ASSIGN.replace("(password", "(?:password"), f"length(regexp_extract_all(t, '{_VALUE}', 1)[k]) >= 6")),
    ("access", _spans("access", ACCESS)),
    ("hex", _spans("hex", HEX)),
    ("pem", _spans("pem", PEM)),
    ("forge", _spans("forge", FORGE)),
]
OP8 = f"""
with found as (
  select doc_id, {", ".join(f"{sql} as {kind}" for kind, sql in _KINDS)} from (select doc_id, coalesce(text, '') as t from documents)
), texts as (
  select doc_id, len(assign) as n_assign, len(access) as n_access, len(hex) as n_hex,
    list_transform(list_sort(list_transform(flatten([{", ".join(f"list_transform({kind}, lambda x: {{'s': x.s, 'k': {k}, 'e': x.s + x.n, 'kind': x.kind}})" for k, (kind, _) in enumerate(_KINDS))}]), lambda x: x)),
      lambda x: {{'base': x.k < 3, 'text': x.kind || ':' || x.s::bigint || ':' || x.e::bigint}}) as xs from found
)
select doc_id, n_assign, n_access, n_hex,
  sha256(coalesce(array_to_string(list_transform(list_filter(xs, lambda x: x.base), lambda x: x.text), ','), '')) as base_sha256,
  coalesce(array_to_string(list_transform(xs, lambda x: x.text), ','), '') as spans from texts
"""

OP10 = f"""
with sizes as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size from documents),
sources as (
  select source, sum(size)::bigint as source_size, [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w from sizes group by source
), levels as (
  select *, 2.0::double * source_size as cap,
    (1.5::double * sum(source_size) over () - coalesce(sum(2.0::double * source_size) over before, 0)) / (sum(w) over () - coalesce(sum(w) over before, 0)) as level
  from sources window before as (order by 2.0::double * source_size / w, source nulls last rows between unbounded preceding and 1 preceding)
), targets as (
  select source, source_size, case when cap <= level * w then cap else min(case when cap > level * w then {{'r': cap / w, 'level': level}} end) over ().level * w end as target from levels
), drawn as (
  select doc_id, size, s.source, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':mix'), 1, 8))::bigint / 4294967296.0::double as draw
  from sizes s join targets t on s.source is not distinct from t.source
), counted as (select *, (floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end)::bigint as copies from drawn)
select doc_id, size, source_size, target, size * copies as taken, source, copies from counted
"""

OP12 = r"""
with words as (
  select row_number() over () as row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents
), d as (select row, doc_id, w, len(w)::bigint as n from words where len(w) > 0),
s as (select count(*)::bigint as total, sum(n)::bigint as length from d),
asked as (
  select item, item_id, term, count(*)::bigint as times from (
    select row_number() over () as item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
  ) group by all
),
postings as (select row, doc_id, n, term, count(*)::bigint as tf from (select row, doc_id, n, unnest(w) as term from d) group by all),
weights as (select term, floor(1000 * ln((2 * total + 2)::double / (2 * df + 1)::double))::bigint as w from (select term, count(*)::bigint as df from postings group by term), s),
scored as (
  select item, item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * total) // length))))::bigint as score
  from asked join postings using (term) join weights using (term), s group by item, item_id, row, doc_id
), ranked as (select item_id, row_number() over (partition by item order by score desc, doc_id nulls last) as rank, doc_id, score from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 20
"""

ORACLES = {"op6_chat_formatting": OP6, "op7_url_filters": OP7, "op8_secret_scans": OP8, "op10_source_mixing": OP10, "op12_ranked_search": OP12}
