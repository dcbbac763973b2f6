"""The queries of this subpackage and the SQL of those that SQL can express.

Trained models, slot planning, tokenizers and bin packing have no SQL form; tests hold those operators against
plain Python, round trips or held-out accuracy."""

from __future__ import annotations

from .decontaminate import op4_decontamination
from .language import op8_language_id
from .licenses import op1_license_scan
from .neardup import op5_minhash_near_dedup
from .packing import op10_packing
from .quality import CONFIDENCE, LADDERS, LOSS, RISK, WINDOW, op7_quality_rules
from .secrets import op2_secret_scan
from .sharding import op6_sharding
from .substring import op3_substring_dedup
from .warc import op9_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_secret_scan, op3_substring_dedup, op4_decontamination, op5_minhash_near_dedup,
        op6_sharding, op7_quality_rules, op8_language_id, op9_warc, op10_packing,
    )
}

_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
_RUNGS = ", ".join(f"('{rule}', {j}, {cut}::double)" for rule, ladder in LADDERS.items() for j, cut in enumerate(ladder))
#: The chance of k or fewer of n at the risk a rule is allowed: at most alpha where the exact upper bound is within that risk.
_CHANCE = f"list_sum(list_transform(range(0, k::bigint + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK / len(LADDERS)}::double) + (n - i) * ln(1 - {RISK / len(LADDERS)}::double))))"
_VERDICT = " ".join(f"when c.cuts['{rule}'] is not null and s.scores['{rule}'] > c.cuts['{rule}'] then '{rule}'" for rule in sorted(LADDERS))

SQL: dict[str, str] = {
    "op3_substring_dedup": f"""
with d as (select doc_id, {_WORDS.format(text="coalesce(text, '')")} as ws from documents),
w as (select doc_id, i, array_to_string(ws[i:i + 19], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from d) t),
f as (select k, min((doc_id, i)) as first from w group by k having count(*) > 1),
again as (select doc_id, i from w join f using (k) where (doc_id, i) > first),
gone as (select doc_id, list_distinct(flatten(list(range(i, i + 20)))) as p from again group by doc_id),
kept as (select d.doc_id, len(ws) as n, case when p is null then ws else list_filter(ws, lambda x, j: not list_contains(p, j)) end as ks from d left join gone using (doc_id)),
whole as (select doc_id, array_to_string(ws, ' ') as t, len(ws) as n from d),
firsts as (select t, min(doc_id) as lead from whole where n >= 20 group by t)
select k.doc_id, n::bigint as n_words, (n - len(ks))::bigint as n_removed, sha256(array_to_string(ks, ' ')) as kept_sha256,
  coalesce(k.doc_id > lead, false) as copied
from kept k join whole using (doc_id, n) left join firsts using (t)""",
    "op5_minhash_near_dedup": f"""
with recursive d as (select doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
s as (select distinct doc_id, case when len(ws) < 5 then array_to_string(ws, ' ') else array_to_string(ws[i:i + 4], ' ') end as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from d where len(ws) > 0) t),
n as (select doc_id, count(*) as n, list_sort(list(g)) as whole from s group by doc_id),
same as (select whole, min(doc_id) as lead from n group by whole),
reps as (select n.doc_id, n, lead from n join same using (whole)),
rs as (select s.doc_id, g from s join reps using (doc_id) where doc_id = lead),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as c from rs a join rs b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from both_ join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
e as (select a, b from links union select b, a from links),
walk as (select lead as v, lead as r from same union select e.b as v, walk.r from walk join e on e.a = walk.v where e.b > walk.r),
root as (select v, min(r) as r from walk group by v)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(r, d.doc_id) as component_id,
  d.doc_id = coalesce(r, d.doc_id) as kept, coalesce(lead, d.doc_id) as representative_id
from d left join reps using (doc_id) left join root on v = lead""",
    "op9_warc": """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
f as (select b, max(page_id) as last from p where octet_length(b) >= 1000 group by b),
j as (select page_id, p.b, case when page_id <> last then last end as refers_to from p left join f using (b))
select page_id, octet_length(b)::bigint as payload_bytes, sha1(b) as payload_digest,
  case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to from j""",
    "op7_quality_rules": f"""
with d as (select doc_id, coalesce(text, '') as t, lower(substr(coalesce(lang, ''), 1, 2)) as l, {_WORDS.format(text="coalesce(text, '')")} as ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: translate(x, {_BLANKS}, '') <> '') as ls from documents),
w as (select doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from d) a),
again as (select doc_id, i from w qualify count(*) over (partition by doc_id, k) > 1),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + {WINDOW})) as p from again) a group by doc_id),
counted as (select doc_id, case when regexp_full_match(l, '[a-z]{{2}}') then l else 'other' end as stratum, len(ws)::bigint as n_words,
  length(translate(t, {_BLANKS}, ''))::bigint as word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
  len(ls) as n_lines, length(t) - length(regexp_replace(t, '\\p{{Lu}}+', '', 'g')) as n_upper from d left join covered using (doc_id)),
s as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  map {{'symbols': n_symbols / greatest(word_chars, 1)::double, 'dup_lines': n_dup_lines / greatest(n_lines, 1)::double, 'repeats': n_repeat_words / greatest(n_words, 1)::double,
    'upper': n_upper / greatest(word_chars, 1)::double, 'word_chars': word_chars / greatest(n_words, 1)::double}} as scores from counted),
truth as (select doc_id, bool_or(quality > 0) as good from labels where doc_id is not null and quality is not null group by doc_id),
rungs(rule, j, cut) as (values {_RUNGS}),
hits as (select stratum, rule, j, cut, count_if(good) as n, count_if(good and scores[rule] > cut) as k, count_if(not good and scores[rule] > cut) as bad
  from s join truth using (doc_id) cross join rungs where not base_failed group by all),
tested as (select *, n > 0 and k <= n * {RISK}::double and {_CHANCE} <= (1 - {CONFIDENCE}::double) / ((select count(distinct stratum) from hits) * {len(LADDERS)}) as ok from hits),
certified as (select *, bad - {LOSS} * k as gain from (select *, bool_and(ok) over (partition by stratum, rule order by j) as safe from tested) a where safe),
chosen as (select stratum, rule, cut from certified where gain > 0 qualify row_number() over (partition by stratum, rule order by gain desc, j) = 1),
c as (select stratum, map(list(rule), list(cut)) as cuts from chosen group by stratum),
judged as (select s.*, case when base_failed then 'base' {_VERDICT} end as rule from s left join c using (stratum))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule is null as kept, rule, stratum from judged""",
}
