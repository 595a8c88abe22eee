"""DuckDB SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

import re

from .mixing import SHARE, WEIGHTS
from .quality_rules import GAMMA, PRIOR_ROWS, RULES
from .sharding import HEAVY, LAW, OVERHEAD, SHARDS

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


def _hash60(value: str) -> str:
    return f"cast('0x' || substr(md5({value}), 1, 15) as bigint)"


OP9 = f"""
with d as (select doc_id, source, cast(coalesce(len({_WORDS}), 0) as bigint) as size, {_hash60("coalesce(cast(doc_id as varchar), '')")} as h from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
ranked as (select source, source_size, row_number() over (order by source nulls last) - 1 as place from s),
weighed as (select source, source_size, place, cast([{", ".join(map(str, WEIGHTS))}][place % {len(WEIGHTS)} + 1] as double) as weight, cast(2 * source_size as double) as most from ranked),
filled as (select *, row_number() over (order by most / weight, place) as fill, cast({SHARE} as double) * sum(source_size) over () as whole, sum(weight) over () as all_weights,
  sum(most) over (order by most / weight, place rows between unbounded preceding and 1 preceding) as full_before,
  sum(weight) over (order by most / weight, place rows between unbounded preceding and 1 preceding) as weight_before from weighed),
levelled as (select *, (whole - coalesce(full_before, 0)) / (all_weights - coalesce(weight_before, 0)) as level from filled),
common as (select arg_min(level, fill) as c from levelled where level * weight <= most),
goal as (select source, source_size, case when c is null or c * weight > most then most else c * weight end as target from levelled left join common on true),
planned as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole_times from goal),
grouped as (select source, h, sum(size) as z from d group by source, h),
summed as (select source, h, z, sum(z) over (partition by source order by h) - z as below from grouped),
picked as (select g.source, g.h, 2 * below + z <= 2 * (target - whole_times * source_size) as taken_more from summed g join planned p on g.source is not distinct from p.source)
select d.doc_id, d.size, p.source_size, p.target,
  cast(case when p.source_size = 0 then 0 else d.size * least(p.whole_times + case when k.taken_more then 1 else 0 end, 2) end as bigint) as taken
from d join planned p on d.source is not distinct from p.source join picked k on d.source is not distinct from k.source and d.h = k.h
"""

#: CRC-32 by its reflected polynomial, with a table that the query makes from its rule.
_CRC = """crc_table as (select list(entry order by n) as t from (select n, list_reduce(list_prepend(n, cast(range(8) as bigint[])),
  lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as entry from (select cast(range as bigint) as n from range(256)))),
crcs as (select h, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: cast('0x' || b as bigint))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as crc from (select distinct md5(text) as h, text from documents where text is not null) cross join crc_table)"""

OP10 = f"""
with {_CRC},
d as (select doc_id, cast(coalesce(strlen(text), 0) + {OVERHEAD} as bigint) as size, md5(text) as m, case when text is null then 0 else {_hash60("text")} end as k1,
  {_hash60("coalesce(cast(doc_id as varchar), '')")} as k2 from documents),
total as (select cast(sum(size) as hugeint) as t from d),
by_text as (select k1, cast(sum(size) as hugeint) as g from d group by k1),
heavy as (select k1, g, row_number() over (order by g desc, k1) - 1 as rank from by_text cross join total where g * {SHARDS} > {HEAVY} * t and g * {SHARDS} <= t),
dealt as (select k1, g, rank, case when rank % {2 * SHARDS} < {SHARDS} then rank % {2 * SHARDS} else {2 * SHARDS - 1} - rank % {2 * SHARDS} end as shard from heavy),
own as (select s.shard, cast(coalesce(sum(g), 0) as hugeint) as h from (select range as shard from range({SHARDS})) s left join dealt d on d.shard = s.shard group by s.shard),
rest as (select t - (select sum(h) from own) as w from total),
levels as (select row_number() over (order by h, shard) as k, h, (w + sum(h) over (order by h, shard) + row_number() over (order by h, shard) - 1) // row_number() over (order by h, shard) as level,
  lead(h) over (order by h, shard) as next_h from own cross join rest),
level as (select arg_min(level, k) as l from levels where next_h is null or level <= next_h),
bounds as (select shard, sum(greatest(0, l - h)) over (order by shard) as upper_ from own cross join level),
light as (select k1, k2, size from d anti join heavy using (k1)),
texts as (select k1, cast(sum(size) as hugeint) as g, cast(sum(sum(size)) over (order by k1) - sum(size) as hugeint) as below from light group by k1),
rows_ as (select k1, k2, cast(sum(size) as hugeint) as z, cast(sum(sum(size)) over (order by k1, k2) - sum(size) as hugeint) as below from light group by k1, k2),
middles as (select r.k1, r.k2, case when x.g * {SHARDS} > t then 2 * r.below + r.z else 2 * x.below + x.g end as m from rows_ r join texts x using (k1) cross join total),
placed as (select k1, k2, -1 as rank, cast((select count(*) from bounds where shard < {SHARDS - 1} and 2 * upper_ <= m) as integer) as shard from middles
  union all select distinct d.k1, d.k2, rank, cast(shard as integer) from d join dealt on d.k1 = dealt.k1)
select doc_id, size, crc as text_crc32, '{LAW}' as law, shard, row_number() over (partition by shard order by rank, k1, k2, doc_id) - 1 as slot, cast(null as integer) as grown_shard
from d join placed using (k1, k2) left join crcs on crcs.h = d.m
"""

_BREAKS = r"'[\x20\x09-\x0D]'"

def _double(expression: str) -> str:
    """Decimal literals of a Spark expression as DuckDB writes them."""
    return re.sub(r"([0-9.]+)D", r"cast(\1 as double)", expression)


OP4 = rf"""
with t as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select r, doc_id, lang, source, text, {_WORDS} as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
windows as (select r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] || ' ' || words[i + 4] as v from w, unnest(range(1, len(words) - 3)) as u(i)),
twice as (select r, i from (select r, i, count(*) over (partition by r, v) as n from windows) where n >= 2),
covered as (select r, count(distinct i + k) as n_repeat_words from twice, range(5) as o(k) group by r),
m as (select w.r, doc_id, lang, source, cast(len(words) as bigint) as n_words, cast(length(regexp_replace(text, {_BREAKS}, '', 'g')) as bigint) as word_chars,
  cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
  cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, cast(len(lines) as bigint) as n_lines from w left join covered using (r)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m),
v as (select r, lang, source, rule, counted, cast(ceil(ln(x) / ln({GAMMA!r})) as integer) as bucket
  from b, lateral (values {", ".join(f"('{k}', {_double(e)}, {c})" for k, (e, _, _, c) in RULES.items())}) as u(rule, x, counted) where n_words > 0),
k as (select lang, source, rule, bucket, count(*) as n from v group by all),
levels as (select 2 as depth, lang, source, rule, bucket, n from k union all select 1, lang, null, rule, bucket, sum(n) from k group by lang, rule, bucket union all select 0, null, null, rule, bucket, sum(n) from k group by rule, bucket),
sums as (select *, sum(n) over (partition by depth, lang, source, rule order by bucket) as up_to, sum(n) over (partition by depth, lang, source, rule) as total from levels),
q as (select depth, lang, source, rule, cast(max(total) as double) as n, cast(min(case when 4 * up_to >= total then bucket end) as double) as q1, cast(min(case when 4 * up_to >= 3 * total then bucket end) as double) as q3
  from sums group by depth, lang, source, rule),
wide as (select l.lang, l.rule, (l.n * l.q1 + {float(PRIOR_ROWS)!r}::double * a.q1) / (l.n + {float(PRIOR_ROWS)!r}::double) as q1, (l.n * l.q3 + {float(PRIOR_ROWS)!r}::double * a.q3) / (l.n + {float(PRIOR_ROWS)!r}::double) as q3
  from q l join q a on l.rule = a.rule where l.depth = 1 and a.depth = 0),
drawn as (select o.lang, o.source, o.rule, (o.n * o.q1 + {float(PRIOR_ROWS)!r}::double * w.q1) / (o.n + {float(PRIOR_ROWS)!r}::double) as q1, (o.n * o.q3 + {float(PRIOR_ROWS)!r}::double * w.q3) / (o.n + {float(PRIOR_ROWS)!r}::double) as q3,
  case o.rule {" ".join(f"when '{k}' then {f!r}::double" for k, (_, _, f, _) in RULES.items())} end as width
  from q o join wide w on o.lang is not distinct from w.lang and o.rule = w.rule where o.depth = 2),
limits as (select lang, source, rule, case when rule in ({", ".join(f"'{k}'" for k, (_, side, _, _) in RULES.items() if side == "both")}) then q1 - width * (q3 - q1) else -1e300 end as low, q3 + width * (q3 - q1) as high from drawn),
outside as (select distinct v.r from v join limits l on v.lang is not distinct from l.lang and v.source is not distinct from l.source and v.rule = l.rule where v.counted > 0 and not v.bucket between l.low and l.high)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and r not in (select r from outside) as kept from b
"""

ORACLE_SQL = {"op4_quality_rules": OP4, "op9_source_mixing": OP9, "op10_histogram_sharding": OP10}
