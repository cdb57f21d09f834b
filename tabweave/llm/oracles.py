"""DuckDB SQL for the corpus operators' queries that SQL can express."""

from __future__ import annotations

from tabweave.llm.chat import CLOSE, MASKED_ROLE, OPEN, SEP
from tabweave.llm.divergence import MIN_DOCS, SCALE, TOP_TERMS
from tabweave.llm.licence_texts import DIGESTS, LICENCES
from tabweave.llm.licences import BODY_LENGTH, COPYRIGHT_LINE, HEAD_WORDS, SPELLINGS
from tabweave.llm.mixing import BLOCK_DOCS, MAX_REPEATS, SEED
from tabweave.llm.ngram_join import PERCENT, WIDTH
from tabweave.llm.quality_rules import DEFAULT as LIMITS
from tabweave.llm.quality_rules import SOFT, Z

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NGRAM = f"""
with recursive w as (
  select doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '', ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (
  select distinct doc_id, case when len(ws) < {WIDTH} then ws else ws[i:i + {WIDTH - 1}] end as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - {WIDTH - 2}, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (
  select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
l as (
  select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= {PERCENT} * (na.n + nb.n - c)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from r join e on e.a = r.b)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.b) as component_id
from documents d left join n using (doc_id) join r on r.a = d.doc_id group by 1, 2
"""


def _canonical(c: str) -> str:
    c = f"regexp_replace(regexp_replace(lower({c}), '\\r\\n?', chr(10), 'g'), {_text(COPYRIGHT_LINE)}, '', 'g')"
    for old, new in SPELLINGS:
        c = f"replace({c}, {_text(old)}, {_text(new)})"
    c = f"regexp_replace({c}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({c}, ' ?\\n ?', chr(10), 'g'), '\\A[ \\n]+|[ \\n]+\\z', '', 'g')"


LICENCE = f"""
with raw(licence, text) as (values {", ".join(f"({_text(k)}, {_text(v)})" for k, v in LICENCES.items())}),
canon as (select licence, regexp_replace({_canonical("text")}, '[ \\n]+', ' ', 'g') as c from raw),
listed as (
  select licence, sha256(c) as digest, length(c) as n, array_to_string(string_split(c, ' ')[1:{HEAD_WORDS}], ' ') as head from canon
  {"".join(f" union all select {_text(name)}, {_text(digest)}, {n}, {_text(head)}" for name, digest, n, head in DIGESTS)}),
known as (select min(licence) as licence, digest, n, head from listed group by digest, n, head),
d as (select doc_id, {_canonical("coalesce(text, '')")} as c from documents),
w as (select doc_id, regexp_replace(c, '[ \\n]+', ' ', 'g') as c from d),
units as (
  select doc_id, unnest(string_split(c, chr(10))) as u from d
  union all
  select doc_id, replace(u, chr(10), ' ') from (select doc_id, unnest(regexp_split_to_array(c, '\\n{{2,}}')) as u from d) where contains(u, chr(10))),
found as (select doc_id, count(*) as n, string_agg(distinct licence, ',' order by licence) as names from units join known on sha256(u) = digest and known.n < {BODY_LENGTH} group by 1),
heads as (
  select doc_id, ' ' || c || ' ' as p, licence, digest, n, ' ' || head as head from w join known on contains(' ' || c || ' ', ' ' || head) where n >= {BODY_LENGTH}),
places as (select *, string_split(p, head) as pieces, unnest(range(1, len(string_split(p, head)))) as i from heads),
starts as (select *, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + (i - 1) * length(head) as s from places),
inside as (
  select doc_id, string_agg(distinct licence, ',' order by licence) as names from starts
  where sha256(substr(p, s::bigint + 2, n::bigint)) = digest and substr(p, s::bigint + 2 + n::bigint, 1) = ' ' group by 1)
select w.doc_id, known.licence as whole_licence, coalesce(inside.names, '') as bodies, coalesce(found.n, 0)::bigint as n_notices, coalesce(found.names, '') as notices
from w left join known on known.digest = sha256(w.c) left join found using (doc_id) left join inside using (doc_id)
"""

_BODY = f"replace(replace(replace(text, '\\', '\\\\'), '{OPEN}', '#\\## '), '{CLOSE}', '<\\/turn>')"
CHAT = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -7, i, case i when 0 then 'user' else 'assistant' end, '\\### Assistant: {CLOSE} ok' from range(2) t(i)),
t as (
  select *, case when contains(role || text, '\\') or contains(text, '{OPEN}') or contains(role, '{OPEN}') or contains(text, '{CLOSE}') or contains(role, '{CLOSE}') or contains(role, '{SEP}')
    then length({_BODY}) + length(replace({_BODY.replace("text", "role")}, '{SEP}', ':\\ ')) else length(text) + length(role) end + {len(OPEN + SEP + CLOSE) + 1} as chars from c),
g as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as every,
    coalesce(string_agg(text, '' order by turn, role, text) filter (role = '{MASKED_ROLE}'), '') as said, sum(chars) as chars from t group by 1)
select conv_id, n_turns::bigint as n_turns, sha256(every) as turns_sha256, length(said)::bigint as loss_chars, sha256(said) as loss_sha256, chars::bigint as formatted_chars, true as round_trip from g
"""

MIXING = f"""
with d as (
  select doc_id, coalesce(doc_id::varchar, '') as id, coalesce(md5(text), '') as tie, source, len({_WORDS})::bigint as tokens from documents),
s as (select source, count(*) as docs, sum(tokens) as tokens, sum(tokens) / sum(sum(tokens)) over () as p from d group by 1),
x as (
  select greatest(0, coalesce(1 - ln({MAX_REPEATS}) / nullif(ln(max(p) / min(p)), 0), 0)) as t from s where tokens > 0),
z as (select sum(p ** t) as z, min(p ** (t - 1)) as least from s, x where tokens > 0),
m as (
  select source, docs, tokens, case when tokens > 0 then p ** t / z else 0.0 end as weight,
    case when tokens > 0 then round(p ** (t - 1) / least, 6) else 1.0 end as repeats from s, x, z),
q as (
  select *, floor(repeats)::int as whole, floor((repeats - floor(repeats)) * tokens)::bigint as quota, greatest(ceil(docs / {BLOCK_DOCS}), 1)::bigint as blocks from m),
r as (
  select d.*, q.tokens as src_tokens, weight, repeats, whole, quota, blocks, e.epoch, md5('{SEED}:' || e.epoch || ':' || id) as o
  from d join q on d.source is not distinct from q.source, lateral (select unnest(range(0, whole + 1)) as epoch) e
  where e.epoch < whole or quota > 0),
b as (select *, floor(('0x' || o[1:8])::bigint * blocks / 4294967296.0)::bigint as block from r),
k as (
  select *, row_number() over (partition by source, epoch, block order by o, tie) as position, sum(tokens) over (partition by source, epoch order by block, o, tie rows unbounded preceding) as run from b)
select doc_id, source, tokens, round(weight, 9) as weight, repeats, epoch::int as epoch, block, position::bigint as position,
  round(case when whole * src_tokens + quota > 0 then (epoch * src_tokens + run - tokens / 2) / (whole * src_tokens + quota) else 0.0 end, 9) as slot from k where epoch < whole or run <= quota
"""

_KINDS = ("any", *SOFT)


def _low(r: str) -> str:
    """The lower end of a host's posterior rate of a kind of failure."""
    mean = f"((f_{r} + m_{r} * w_{r}) / (n + w_{r}))"
    return f"case when w_{r} is null then m_{r} - {Z} * sqrt(m_{r} * (1 - m_{r}) / nn) else {mean} - {Z} * sqrt({mean} * (1 - {mean}) / (n + w_{r} + 1)) end"


def _rules(host: str) -> str:
    return f"""
with d as (select doc_id, {host} as source, coalesce(text, '') as text, {_WORDS} as ws from documents),
g as (
  select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) as c
  from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from d)),
r as (select doc_id, count(distinct i + k) as n from g, range(3) t(k) where c > 1 group by 1),
l as (
  select doc_id, count(*) as lines, count(*) - count(distinct line) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from d)
  where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by 1),
s as (
  select d.doc_id, source, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(l.n, 0)::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words, coalesce(l.lines, 0) as n_lines
  from d left join l using (doc_id) left join r using (doc_id)),
f as (
  select *, n_words < {LIMITS.min_words} or 100 * n_repeat_words > {LIMITS.max_repeat_pct} * n_words as base_failed, 100 * n_symbols > {LIMITS.max_symbol_pct} * n_words as x_symbols,
    100 * n_dup_lines > {LIMITS.max_dup_line_pct} * n_lines as x_lines, word_chars < {LIMITS.min_mean} * n_words or word_chars > {LIMITS.max_mean} * n_words as x_lengths from s),
h as (
  select source, count(*) as n, count(*) filter (base_failed or {" or ".join(f"x_{r}" for r in SOFT)}) as f_any, {", ".join(f"count(*) filter (x_{r}) as f_{r}" for r in SOFT)}
  from f where source is not null group by 1),
t as (
  select sum(n)::double as nn, count(*) as k, sum(n * n)::double / sum(n) as sq, {", ".join(f"sum(f_{r}) / sum(n) as m_{r}, sum(f_{r} * f_{r} / n) - sum(f_{r})::double * sum(f_{r}) / sum(n) as v_{r}" for r in _KINDS)} from h),
p as (
  select *, {", ".join(f"case when nn - sq - (k - 1) <= 1e-9 or m_{r} <= 0 or m_{r} >= 1 then 0 else least(1, greatest(0, (v_{r} / (m_{r} * (1 - m_{r})) - (k - 1)) / (nn - sq - (k - 1)))) end as rho_{r}" for r in _KINDS)} from t),
w as (select *, {", ".join(f"case when rho_{r} > 1e-9 then 1 / rho_{r} - 1 end as w_{r}" for r in _KINDS)} from p),
v as (
  select source, {_low("any")} > greatest({LIMITS.max_host_rate}, m_any) as rejected, {", ".join(f"{_low(r)} > greatest({LIMITS.max_rule_rate}, m_{r}) as bad_{r}" for r in SOFT)} from h, w),
j as (
  select f.*, coalesce(rejected or {" or ".join(f"(bad_{r} and x_{r})" for r in SOFT)}, false) as by_host from f left join v on f.source = v.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, by_host, not base_failed and not by_host as kept from j
"""


RULES, RULES_BY_LENGTH = _rules("source"), _rules("'len' || length(length(text)::varchar)")

_P = "(1 + {scale}::hugeint * ({count} + 2) // ({total} + 2 * {v}))"
_WEIGHT = lambda count, total: _P.format(scale=SCALE, count=count, total=total, v="v")
DIVERGENCE = f"""
with d as (
  select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ws from documents),
w as (select i, lang, source, unnest(ws) as term from d),
k as (select lang, term, count(*) as of_lang from w group by 1, 2 having count(distinct i) >= {MIN_DOCS}),
v as (select lang, count(*) as v, sum(of_lang)::bigint as lang_total from k group by 1),
c as (select lang, source, term, count(*) as n from w semi join k using (lang, term) group by 1, 2, 3),
g as (
  select x.lang, x.source, coalesce(v.v, 0) as v, coalesce(v.lang_total, 0) as lang_total, coalesce(t.total, 0)::bigint as total
  from (select distinct lang, source from d) x left join v using (lang) left join (select lang, source, sum(n) as total from c group by 1, 2) t using (lang, source)),
e as (
  select g.lang, g.source, term, of_lang, lang_total, v, coalesce(n, 0) as n, total, {_WEIGHT("coalesce(n, 0)", "total")} as p
  from g join k using (lang) left join c using (lang, source, term)),
pairs as (
  select g.lang, g.source, h.source as item, coalesce(s.value, 0)::bigint as value from g join g h on g.lang = h.lang and g.source <> h.source
  left join (select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value from e x join e y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by 1, 2, 3) s
  on s.lang = g.lang and s.source = g.source and s.item = h.source),
terms as (
  select lang, source, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from (select *, {_WEIGHT("of_lang", "lang_total")} as q from e) where n > 0 and p > q),
r as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select * from (select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) as rank from terms) where rank <= {TOP_TERMS})
select lang, source, part, item, value, rank::int as rank from r
"""

ORACLES = {"op3_ngram_jaccard": NGRAM, "op6_licences": LICENCE, "op7_chat": CHAT, "op8_mixing": MIXING, "op9_quality_rules": RULES, "host_rules_by_length": RULES_BY_LENGTH, "op12_divergence": DIVERGENCE}
