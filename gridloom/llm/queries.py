"""The queries of this subpackage, by name, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers

from . import ann, lang_id, licenses, lm_scoring, mixing, packing, pii, quality, simhash, substrings
from .common import read


def op1_ivf_pq_neighbours(spark, sf_dir):
    return ann.search(read(spark, sf_dir, "embeddings"))


def op2_vector_best_fit(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_simhash_bit_sliced(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_weak_supervision_pii(spark, sf_dir):
    return pii.detect(read(spark, sf_dir, "documents"))


def op5_patience_licenses(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


def op6_suffix_array_rules(spark, sf_dir):
    return quality.rules(read(spark, sf_dir, "documents")).drop("longest_repeat")


def op7_two_stage_dedup(spark, sf_dir):
    return substrings.remove_repeats(read(spark, sf_dir, "documents"))


def op8_cross_parse_language(spark, sf_dir):
    return lang_id.identify(read(spark, sf_dir, "documents"))


def op9_context_mixing(spark, sf_dir):
    return lm_scoring.score(read(spark, sf_dir, "documents"))


def op10_pfair_mix(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "source", "block", "release", "deadline", "slot", "position")


def queries():
    return {f.__name__: f for f in (op1_ivf_pq_neighbours, op2_vector_best_fit, op3_simhash_bit_sliced, op4_weak_supervision_pii, op5_patience_licenses, op6_suffix_array_rules, op7_two_stage_dedup, op8_cross_parse_language, op9_context_mixing, op10_pfair_mix)}


#: The schedule is a recursion over slots whose state is the list of blocks served.
OP10_SQL = """
with recursive counted as (select source, count(*) as n from documents group by source),
sized as (select source, cast(floor(sqrt(n) * 1000) as bigint) as size, row_number() over (order by source is not null, source) as i, count(*) over () as sources, greatest(1000, 4 * count(*) over ()) as q from counted),
asked as (select *, q * size < sum(size) over () as few from sized),
shared as (select *, case when few then 1 else (q - count(*) filter (few) over ()) * size // cast(sum(size) filter (not few) over () as bigint) end as base,
    case when few then -1 else (q - count(*) filter (few) over ()) * size % cast(sum(size) filter (not few) over () as bigint) end as rest from asked),
given as (select source, i, greatest(1, base + case when row_number() over (order by rest desc, i) <= q - sum(base) over () then 1 else 0 end) as k from shared),
weighed as (select *, cast(sum(k) over () as bigint) as q from given),
listed as (select list(cast(k as bigint) order by i) as ks, cast(max(q) as bigint) as q, count(*) as n from weighed),
slots as (
    select cast(-1 as bigint) as t, [cast(0 as bigint) for i in range(n)] as done, cast(0 as bigint) as chosen, ks, q, n from listed where n > 0
    union all
    select t + 1, [done[i] + case when i = pick then 1 else 0 end for i in range(1, n + 1)], pick, ks, q, n
    from (select *, list_min([case when done[i] < ks[i] and done[i] * q // ks[i] <= t + 1 then ((done[i] + 1) * q + ks[i] - 1) // ks[i] * 1000000 + i end for i in range(1, n + 1)]) % 1000000 as pick from slots where t + 1 < q)
),
period as (select chosen as i, t, row_number() over (partition by chosen order by t) - 1 as nth from slots where t >= 0),
ranked as (select doc_id, source, row_number() over (partition by source order by md5(coalesce(cast(doc_id as varchar), 'null')), doc_id) - 1 as r from documents)
select r.doc_id, r.source, r // 16 as block, r // 16 * q // k as release, ((r // 16 + 1) * q + k - 1) // k as deadline,
       r // 16 // k * q + t as slot, (r // 16 // k * q + t) * 16 + r % 16 as position
from ranked r join weighed w on r.source is not distinct from w.source join period p on p.i = w.i and p.nth = r // 16 % k
"""


def _windows(n: int) -> str:
    """The windows of ``n`` words of each text, by place, and how often each occurs in its text."""
    slices = f"list_transform(range(1, len(ws) - {n - 2}), lambda i: hash(array_to_string(ws[i:i + {n - 1}], ' ')))"
    return f"select rid, i, count(*) over (partition by rid, x) as c from (select rid, unnest(range(1, len(h) + 1)) as i, unnest(h) as x from (select rid, {slices} as h from w where len(ws) >= {n}))"


def _covered(n: int) -> str:
    return f"select rid, count(distinct p) as k from (select rid, unnest(range(i, i + {n})) as p from ({_windows(n)}) where c > 1) group by rid"


#: Words in windows that occur twice say what repeats of that length or more cover; the longest repeat is over 200 words if a window of 201 occurs twice.
OP6_SQL = f"""
with w as (select doc_id, row_number() over () as rid, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') as ws from documents),
lines as (select rid, len(x) - len(list_distinct(x)) as dups from (select rid, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ \t-\r]')) as x from w)),
made as (select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(dups as bigint) as n_dup_lines,
    cast(coalesce(a.k, 0) as bigint) as n_repeat_words, cast(coalesce(b.k, 0) as bigint) as covered_words, l.rid is not null as long_repeat
    from w join lines on lines.rid = w.rid left join ({_covered(3)}) a on a.rid = w.rid left join ({_covered(quality.MIN_WORDS)}) b on b.rid = w.rid
    left join (select distinct rid from ({_windows(quality.LONGEST + 1)}) where c > 1) l on l.rid = w.rid)
select * exclude (long_repeat), n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * covered_words <= {quality.MOST_COVERED} * n_words and not long_repeat as kept from made
"""


#: Windows of 400 bytes and of 51 words by hash over all texts; their islands are the removed runs, what lies between is kept.
OP7_SQL = f"""
with w as (select doc_id, row_number() over () as rid, encode(coalesce(text, '')) as b, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') as ws from documents),
win as (select rid, unnest(range(1, len(h) + 1)) as s, unnest(h) as x from (select rid, list_transform(range(1, octet_length(b) - {substrings.LENGTH - 2}), lambda i: hash(array_slice(b, i, i + {substrings.LENGTH - 1}))) as h from w where octet_length(b) >= {substrings.LENGTH})),
rep as (select rid, s, lag(s) over (partition by rid order by s) as before from (select rid, s, count(*) over (partition by x) as c from win) where c > 1),
isl as (select rid, s, count(*) filter (before is null or s > before + {substrings.LENGTH}) over (partition by rid order by s) as g from rep),
span as (select rid, min(s) as a, max(s) + {substrings.LENGTH - 1} as z from isl group by rid, g),
piece as (select rid, coalesce(lag(z) over (partition by rid order by a), 0) + 1 as f, a - 1 as t from span
    union all select w.rid, coalesce(max(z), 0) + 1, any_value(octet_length(b)) from w left join span on span.rid = w.rid group by w.rid),
kept as (select piece.rid, string_agg(hex(array_slice(b, f, t)), '' order by f) as hx from piece join w on w.rid = piece.rid where t >= f group by piece.rid),
gone as (select rid, sum(z - a + 1) as n_removed, count(*) as n_spans from span group by rid),
told as (select rid, count(distinct p) as k from (select rid, unnest(range(i, i + {substrings.WORDS})) as p from ({_windows(substrings.WORDS).replace("partition by rid, x", "partition by x")}) where c > 1) group by rid)
select doc_id, cast(octet_length(b) as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(hx, ''))) as kept_sha256, cast(coalesce(k, 0) as bigint) as passage_words
from w left join gone on gone.rid = w.rid left join kept on kept.rid = w.rid left join told on told.rid = w.rid
"""


def oracle_sql():
    return {"op10_pfair_mix": OP10_SQL, "op6_suffix_array_rules": OP6_SQL, "op7_two_stage_dedup": OP7_SQL}
