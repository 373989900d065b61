"""DuckDB SQL for the queries that SQL can express."""

LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP8 = f"""
with recursive w as (select doc_id, {WORDS.format(LOWER.format("text"))} as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]]
    else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) as sh
  from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
both_ways as (select a, b from link union select b, a from link),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join both_ways l on r.b = l.a),
root as (select a, min(b) as component_id from reach group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, r.component_id, d.doc_id = r.component_id as kept
from documents d left join n on n.doc_id = d.doc_id join root r on r.a = d.doc_id
"""

OP7 = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join link l on r.b = l.a),
root as (select a, min(b) as component_id from reach group by 1),
n as (select a, count(*) as n from link group by 1)
select e.vec_id, coalesce(n.n, 0) as n_links, r.component_id, e.vec_id = r.component_id as kept
from embeddings e join root r on r.a = e.vec_id left join n on n.a = e.vec_id
"""

OP6 = f"""
with d as (select doc_id, source, len({WORDS.format("coalesce(text, '')")}) as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by 1),
r as (select *, row_number() over (order by encode(source) nulls last) - 1 as turn from s),
w as (select *, ([3.0, 1.0, 2.0])[turn % 3 + 1]::double as weight, 2.0::double * source_size as stop from r),
l as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(stop) over (order by stop / weight, turn rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by stop / weight, turn rows between current row and unbounded following) as level
  from w),
p as (select *, (select arg_min(level, stop / weight) from l where stop / weight > level) as per from l),
t as (select source, source_size, turn, least(stop, coalesce(per * weight, stop)) as target from p),
o as (
  select d.doc_id, d.size, t.source_size, t.turn, t.target, floor(t.target + 0.5)::bigint as goal,
    (coalesce(sum(d.size) over (partition by t.turn order by md5(concat(coalesce(d.doc_id::varchar, ''), '/', d.size::varchar)), d.doc_id
      rows between unbounded preceding and 1 preceding), 0))::bigint as lead_words
  from d join t on d.source is not distinct from t.source),
k as (
  select *, (case when source_size > 0 then goal // source_size else 0 end) as whole from o),
q as (select *, (whole * size + least(greatest(goal - whole * source_size - lead_words, 0), size))::bigint as taken from k),
u as (select *, case when taken > 0 then lead_words / greatest(target, 1.0) end as x from q)
select doc_id, size, source_size, target, taken,
  case when turn % 3 = 0 then least(x, 1.0)
       when turn % 3 = 1 then (case when x < 1.0 then sqrt(0.25 + 2.0 * x) - 0.5 else 1.0 end)
       when x < 0.625 then 1.5 - sqrt(greatest(2.25 - 2.0 * x, 0)) when x < 1.0 then 0.5 + (1.0 - sqrt(greatest(1.0 - 2.0 * (x - 0.625), 0))) else 1.0 end as position
from u
"""

OP4 = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (
  select page_id, octet_length(encode(html)) as payload_bytes, sha256(html) as k,
    array_to_string(list_transform(range(0, 8), lambda i: translate(to_base(('0x' || substring(sha1(html), (5 * i + 1)::int, 5))::bigint, 32, 4),
      '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), '') as payload_digest
  from p),
t as (select *, max(page_id) over (partition by k) as top from d)
select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id <> top then top end as refers_to
from t
"""

_ESCAPED = "replace({0}, '\\', '\\\\')"
for _c in ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]"):
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"

OP9 = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as r0, text as t0 from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn nulls first, r0 nulls first, t0 nulls first)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, r0 nulls first, t0 nulls first) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(20 + case when role = 'assistant' then 0 else 13 end + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}))::bigint as formatted_chars
from c group by conv_id
"""


def _op10(texts: bool = False) -> str:
    """Every word of every line (or also of every paragraph and text) against every template."""
    from rasterloom.llm.licenses import TEMPLATES, TEXTS, THRESHOLD, VERSION

    templates = TEMPLATES + TEXTS if texts else TEMPLATES
    parts = "string_split_regex(text, '[\\n\\r]')"
    if texts:
        even = "regexp_replace(text, '\\r\\n?', chr(10), 'g')"
        parts = f"list_concat([{even}], string_split_regex({even}, '\\n[ \\t]*\\n'), string_split_regex({even}, '\\n'))"
    notices = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(templates))
    n = len(templates)
    bag = "unnest(regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+'))"
    return f"""
with t(i, license, notice) as (values {notices}),
tt as (select i, license, {bag.format("notice")} as term from t),
tf as (select i, license, term, count(*) as k from tt group by all),
idf as (select term, ln({1 + n}::double / (1 + count(*))) + 1 as idf from tf group by 1),
tv as (
  select i, license, term, k * idf as w, sqrt(sum((k * idf) ** 2) over (partition by i)) as norm, regexp_full_match(term, '{VERSION}') as version,
    count(*) filter (where regexp_full_match(term, '{VERSION}')) over (partition by i) as versions
  from tf join idf using (term)),
l as (select doc_id, unnest({parts}) as words, generate_subscripts({parts}, 1) - 1 as line from documents where text is not null),
lt as (select doc_id, line, {bag.format("words")} as term from l),
lf as (select doc_id, line, term, count(*) as k from lt group by all),
lw as (select doc_id, line, term, k * coalesce(idf, ln({1 + n}::double) + 1) as w from lf left join idf using (term)),
ln_ as (select doc_id, line, sqrt(sum(w * w)) as norm from lw group by all),
s as (
  select lw.doc_id, lw.line, tv.i, tv.license, least(sum(lw.w * tv.w / tv.norm) / min(ln_.norm), 1.0) as score
  from lw join tv using (term) join ln_ on ln_.doc_id = lw.doc_id and ln_.line = lw.line group by lw.doc_id, lw.line, tv.i, tv.license, tv.versions
  having count(*) filter (where version) = tv.versions),
b as (select *, row_number() over (partition by doc_id order by round(score, 9) desc, line, license) as r from s where score >= {THRESHOLD} - 1e-12),
f as (
  select d.doc_id, concat(coalesce(d.source, ''), '/', floor(d.doc_id / 10)::bigint) as dir, b.license, b.score, b.line
  from documents d left join b on b.doc_id = d.doc_id and b.r = 1),
p as (select *, concat(dir, '/', doc_id) as path from f),
g as (select dir, license, score, row_number() over (partition by dir order by path) as r from p where line = 0),
u as (
  select p.*, a.dir as from1, a.license as l1, a.score as s1 from p left join g a on a.dir = p.dir and a.r = 1)
select doc_id, path, coalesce(license, l1) as license, coalesce(score, s1) as score,
  case when license is not null then 'header' when l1 is not null then 'inherited' else 'none' end as origin,
  case when license is null then from1 end as license_dir
from u
"""


OP10 = _op10()

#: After the scan of OP10: every licence file above a document rather than its own directory's.
_TREE = """f as (
  select d.doc_id, d.doc_id % 2 = 0 as named,
    concat_ws('/', coalesce(d.source, ''), case when d.doc_id % 10 <> 0 then floor(d.doc_id / 100)::bigint::varchar end,
      case when d.doc_id % 10 <> 0 and d.doc_id % 4 <> 0 then floor(d.doc_id / 10)::bigint::varchar end) as dir, b.license, b.score
  from documents d left join b on b.doc_id = d.doc_id and b.r = 1),
p as (select *, concat(dir, '/', case when named then 'LICENSE.' else '' end, doc_id) as path from f),
g as (select dir, license, score, row_number() over (partition by dir order by path) as r from p where named and license is not null),
u as (
  select p.path, a.dir as from1, a.license as l1, a.score as s1, row_number() over (partition by p.path order by length(a.dir) desc) as r
  from (select distinct path, dir from p) p join g a on a.r = 1 and (a.dir in (p.dir, '') or starts_with(p.dir, a.dir || '/')))
select p.doc_id, p.path, coalesce(p.license, u.l1) as license, coalesce(p.score, u.s1) as score,
  case when p.license is not null then 'header' when u.l1 is not null then 'inherited' else 'none' end as origin,
  case when p.license is null then u.from1 end as license_dir
from p left join u on u.path = p.path and u.r = 1
"""
OP10_TREE = OP10[: OP10.index("\nf as (") + 1] + _TREE

#: The same with licence texts among the templates, paragraphs and whole texts among the parts.
OP10_TEXTS = _op10(True)[: _op10(True).index("\nf as (") + 1] + _TREE

#: CRC-32 of the bytes of ``w``, byte by byte; the table of remainders follows from the polynomial.
_CRC = """
rest as (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as r from range(256) t(i)),
remainders as (select list(r order by i) as r from rest),
{kinds} as (
  select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(w)) + 1),
      lambda i: ('0x' || substring(hex(encode(w)), (2 * i - 1)::int, 2))::bigint)),
    lambda c, b: xor(c >> 8, r[xor(c & 255, b) + 1])), 4294967295) % 10000 as bucket
  from (select distinct w from {words}), remainders)"""

_FEATURES = r"unnest(regexp_extract_all(" + LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))"

OP11 = f"""
with dw as (select doc_id, {_FEATURES} as w from documents),
tw as (select {_FEATURES} as w from benchmark),
aw as (select w from dw union all select w from tw),
{_CRC.format(kinds="kinds", words="aw")},
df as (select doc_id, bucket, count(*) as n from dw join kinds using (w) group by all),
s as (select bucket, sum(n)::double as s from df group by 1),
t as (select bucket, count(*)::double as t from tw join kinds using (w) group by 1),
total as (select (select coalesce(sum(s), 0) from s)::double as s, (select coalesce(sum(t), 0) from t)::double as t),
gain as (
  select bucket, floor(1000 * ln((coalesce(t.t, 0) + 1) * (total.s + 10000) / ((s.s + 1) * (total.t + 10000))))::bigint as gain
  from s left join t using (bucket), total),
weighed as (
  select d.doc_id, coalesce(sum(n), 0)::bigint as n_features, coalesce(floor(sum(n * gain)::double / sum(n)), 0)::bigint as weight
  from documents d left join df on df.doc_id = d.doc_id left join gain using (bucket) group by d.doc_id),
scored as (
  select *, weight + floor(-1000 * ln(-ln((('0x' || substring(sha256('2024:' || doc_id::varchar), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score from weighed),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as rank from scored where n_features >= 20)
select scored.*, case when rank <= (select 10 * count(*) // 100 from ranked) then rank end as rank from scored left join ranked using (doc_id)
"""

OP13 = """
with v as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.id as anchor_id, b.id, a.label = b.label as same, list_dot_product(a.e, b.e)::bigint as score
  from v a join v b on a.id <> b.id and len(a.e) = len(b.e) where a.id % 100 = 0),
p as (
  select anchor_id, id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, id) as k from s where same),
n as (
  select p.anchor_id, positive_id, s.id as negative_id, positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id) as rank
  from p join s on s.anchor_id = p.anchor_id and not same and k <= 5
    and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10
"""
