"""DuckDB SQL of the registered queries of this package that SQL can express.

The others (tokenizers, sampled segmentations, pages, packing, byte spans, spans of personal data, the forest) are tested against the libraries
or brute force in ``tests/llm``.
"""

from __future__ import annotations

import math

from barloom.llm import quality as Q

CHECKS: dict[str, str] = {}

_WORD = "[^\\x20\\x09-\\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: components over the ids of ``nodes`` by the pairs of ``links`` (both ways)
_REACH = """reach as (select id, id as root from nodes union select l.b, r.root from reach r join links l on l.a = r.id),
component as (select id, min(root) as component_id from reach group by id)"""

CHECKS["op5_minhash_near_dedup"] = f"""with recursive
split as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') as ws from documents),
word as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from split),
run as (select doc_id, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o || ' ' || lead(w, 3) over o || ' ' || lead(w, 4) over o as s
        from word window o as (partition by doc_id order by i)),
shingle as (select distinct doc_id, s from run where s is not null union
            select doc_id, array_to_string(ws, ' ') from split where len(ws) between 1 and 4),
size as (select d.doc_id, count(s) as n from documents d left join shingle using (doc_id) group by d.doc_id),
pair as (select x.doc_id as a, y.doc_id as b, count(*) as c from shingle x join shingle y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
link as (select a, b from pair join size p on p.doc_id = a join size q on q.doc_id = b where 100 * c >= 75 * (p.n + q.n - c)),
links as (select a, b from link union select b, a from link),
nodes as (select doc_id as id from documents),
{_REACH}
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from size join component on id = doc_id"""

CHECKS["op6_embedding_near_dedup"] = f"""with recursive
v as (select vec_id, cast(embedding as double[]) as e from embeddings),
link as (select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id < y.vec_id and list_cosine_similarity(x.e, y.e) >= 0.9),
links as (select a, b from link union select b, a from link),
nodes as (select vec_id as id from v),
{_REACH}
select id as vec_id, (select count(*) from links where a = id) as n_links, component_id, id = component_id as kept from component"""

_signals = " union all ".join(f"select doc_id, stratum, '{s}' as signal, {a} as a, {b} as b from stat where not base_failed"
                              for s, (a, b) in Q.SIGNALS.items())
CHECKS["op9_quality_rules"] = f"""with
split as (select doc_id, case when lang in ({', '.join(f"'{x}'" for x in Q.STRATA)}) then lang else 'other' end as stratum, coalesce(text, '') as t,
                 regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws,
                 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from documents),
word as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from split),
run as (select doc_id, i, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o as g from word window o as (partition by doc_id order by i)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from run where g is not null) where n > 1),
again as (select doc_id, count(distinct i) as n from (select doc_id, unnest([i, i + 1, i + 2]) as i from twice) group by doc_id),
count1 as (select doc_id, stratum, len(ws) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
                  len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(regexp_extract_all(t, '\\p{{Lu}}')) as n_capitals,
                  len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n, 0) as n_repeat_words
           from split left join again using (doc_id)),
stat as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from count1),
label as (select doc_id, max(quality) as q from labels where doc_id is not null and quality is not null group by doc_id),
signal as ({_signals}),
tried as (select stratum, signal, g as cutoff, count(*) filter (where q >= 1) as n, count(*) filter (where q >= 1 and 1000 * a > g * b) as x,
                 count(*) filter (where q < 1 and 1000 * a > g * b) as bad
          from signal join label using (doc_id) cross join (select unnest({list(Q.GRID)}) as g) group by all),
sure as (select stratum, signal, cutoff, bad - {Q.CAUTION} * x as gain from tried
         where x < {Q.RISK} * n and bad - {Q.CAUTION} * x > 0 and (
           select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * {math.log(Q.RISK)!r} + (n - i) * {math.log1p(-Q.RISK)!r}))
           from (select unnest(range(0, x + 1)) as i)) <= {Q.ALPHA / ((len(Q.STRATA) + 1) * len(Q.SIGNALS) * len(Q.GRID))!r}),
rule as (select stratum, signal, cutoff from (select *, row_number() over (partition by stratum, signal order by gain desc, cutoff desc) as k from sure) where k = 1),
broken as (select distinct s.doc_id from signal s join rule r using (stratum, signal) where 1000 * a > cutoff * b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and b.doc_id is null as kept
from stat left join broken b using (doc_id)"""


#: CRC-32: the table of 256 remainders by its rule, and the checksum of a string's UTF-8 bytes
_CRC_TABLE = """crc_table as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as tab)"""


def _crc(text: str) -> str:
    hexed = f"hex(encode({text}))"
    high, low = (f"strpos('0123456789ABCDEF', substr({hexed}, cast(2 * i + {k} as int), 1)) - 1" for k in (1, 2))
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: 16 * ({high}) + {low})"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


CHECKS["op11_importance_resampling"] = f"""with
{_CRC_TABLE},
texts as (select doc_id, text, false as wanted from documents union all select item_id, text, true from benchmark),
split as (select doc_id, wanted, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from texts),
word as (select doc_id, wanted, unnest(ws) as w from split),
bucket as (select w, {_crc("w")} % 10000 as bucket from (select distinct w from word) cross join crc_table),
total as (select bucket, cast(count(*) filter (where not wanted) as double) as s, cast(count(*) filter (where wanted) as double) as t
          from word join bucket using (w) group by bucket),
gain as (select bucket, cast(floor(1000 * ln((t + 1) * ((select sum(s) from total) + 10000) / ((s + 1) * ((select sum(t) from total) + 10000)))) as bigint) as gain from total),
weight as (select doc_id, cast(sum(gain) as bigint) as weight from word join bucket using (w) join gain using (bucket) where not wanted group by doc_id),
noise as (select doc_id, len(ws) as n_features, coalesce(weight, 0) as weight, cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) as h
          from split left join weight using (doc_id) where not wanted),
score as (select doc_id, n_features, weight, weight + cast(floor(-1000 * ln(-ln((h + cast(0.5 as double)) / cast(4294967296 as double)))) as bigint) as score from noise),
place as (select doc_id, row_number() over (order by score desc, doc_id) as r from score where n_features >= 20)
select doc_id, cast(n_features as bigint) as n_features, weight, score, case when r <= 10 * (select count(*) from place) // 100 then r end as rank
from score left join place using (doc_id)"""

CHECKS["op12_prefix_trie"] = f"""with
{_CRC_TABLE},
turns as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first) as pos
          from conversations where conv_id is not null),
plan as (select c.conv_id, c.conv_id - c.conv_id % 5 as start, {_crc("cast(c.conv_id as varchar)")} % 9 as h
         from (select distinct conv_id from turns) c cross join crc_table),
taken as (select p.conv_id, t.pos, t.role, t.text from plan p join turns t on t.conv_id = p.start and t.pos <= p.h
          union all select p.conv_id, 1000000 + t.pos, t.role, t.text from plan p join turns t on t.conv_id = p.conv_id and t.pos > p.h),
rebuilt as (select conv_id, row_number() over (partition by conv_id order by pos) as depth, sha256(role || chr(1) || text) as turn, octet_length(encode(text)) as n_bytes from taken),
prefix as (select conv_id, depth, string_agg(turn, '') over (partition by conv_id order by depth) as path, n_bytes,
                  depth = count(*) over (partition by conv_id) as ended from rebuilt
           union all select conv_id, 0, '', 0, not exists (select 1 from rebuilt r where r.conv_id = p.conv_id) from plan p),
node as (select path, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(n_bytes) as n_bytes, bool_and(ended) as leaf,
                sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ended), '')) as ends_sha256 from prefix group by path),
up as (select path, case when depth > 0 then left(path, length(path) - 64) end as up from node),
child as (select up as path, count(*) as n from up where up is not null group by up),
under as (select a.path, count(*) filter (where d.leaf) as n_leaves, cast(sum((d.n_convs - 1) * d.n_bytes) as bigint) as saved
          from node d join prefix p on p.conv_id = d.conv_id and p.depth <= d.depth join node a on a.path = p.path group by a.path)
select n.conv_id, cast(n.depth as bigint) as depth, m.conv_id as parent_conv_id, n.n_convs, coalesce(c.n, 0) as n_children, n_leaves, saved as saved_tokens, n.ends_sha256
from node n join up using (path) left join node m on m.path = up.up left join child c on c.path = n.path join under u on u.path = n.path"""

CHECKS["op13_exact_top_k"] = """with
v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as w from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pair as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) as bigint) as score
         from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pair) where rank <= 5"""
