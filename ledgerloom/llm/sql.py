"""DuckDB SQL for the queries that SQL can express in reasonable time."""

from __future__ import annotations

from ledgerloom.llm import decontaminate, sharding

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"

NEAR_DUPLICATES = f"""
with recursive words as (
    select doc_id, list_filter(regexp_split_to_array({_LOWERED}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w
    from documents),
shingled as (
    select doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1),
        lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) as s
    from words where len(w) > 0),
sets as (select doc_id, len(s) as n, unnest(s) as shingle from shingled),
sizes as (select doc_id, len(s) as n from shingled),
links as (
    select a.doc_id as a, b.doc_id as b from sets a join sets b on a.shingle = b.shingle and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach as (
    select doc_id as a, doc_id as b from sizes
    union select reach.a, links.b from reach join links on reach.b = links.a)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, coalesce(least_id, d.doc_id) as component_id
from documents d left join sizes on sizes.doc_id = d.doc_id
left join (select a, min(b) as least_id from reach group by a) r on r.a = d.doc_id"""

_CRC = "xor(list_reduce({bytes}, lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"
_BYTES = "list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::bigint)"


def sharding_sql(shards: int) -> str:
    a = sharding.MULTIPLIER
    return f"""
with recursive crc_table as (
    select list_transform(range(256), lambda n: list_reduce(range(8),
        lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as crc),
jumps(doc_id, key, shard, next) as (
    select distinct doc_id, cast(coalesce(doc_id, 0) as hugeint) & 18446744073709551615, cast(-1 as bigint),
        cast(0 as bigint) from documents
    union all
    select doc_id, k, next, cast(floor((2147483648.0::double / ((k >> 33) + 1)::double) * (next + 1)::double) as bigint)
    from (select doc_id, next, (key * {a}::hugeint + 1) % 18446744073709551616::hugeint as k
          from jumps where next < {shards})),
ends as (select doc_id, shard, next from jumps where next >= {shards}),
sized as (
    select doc_id, cast(octet_length(encode(coalesce(text, ''))) + 16 as bigint) as size,
        {_CRC.format(bytes=_BYTES.format(text="coalesce(text, '')"))} as text_crc32, crc
    from documents, crc_table),
parted as (
    select doc_id, size, text_crc32, crc,
        {_CRC.format(bytes=_BYTES.format(text="concat_ws(':', doc_id, text_crc32, size)"))} % {sharding.PARTS} as part
    from sized)
select p.doc_id, size, cast(text_crc32 as bigint) as text_crc32, 'key' as law, cast(shard as int) as shard,
    cast(row_number() over (partition by shard order by part, p.doc_id nulls first, text_crc32, size) - 1 as bigint)
        as slot,
    cast(case when next = {shards} then {shards} else shard end as int) as grown_shard
from parted p join ends e on p.doc_id is not distinct from e.doc_id"""


_BENCH_WORDS = "regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"



def _near(rank: int) -> str:
    """Proposed starts that have the term of one more rank close to its place, or no such term."""
    return f"""near_{rank} as (
    select distinct s.doc_id, s.phrase, s.start from near_{rank - 1} s
    left join probes p on p.phrase = s.phrase and p.rank = {rank}
    left join places q on q.doc_id = s.doc_id and q.term = p.term
        and abs(q.place - s.start - p.o) <= {decontaminate.SLOP}
    where p.term is null or q.term is not null)"""


DECONTAMINATION = f"""
with items as (
    select cast(item_id as varchar) as item_id, {_BENCH_WORDS.format(lowered=_LOWERED)} as w from benchmark),
item_windows as (
    select distinct item_id, least(len(w), {decontaminate.WINDOW}) as size,
        array_to_string(list_slice(w, i, i + {decontaminate.WINDOW - 1}), ' ') as phrase
    from (select item_id, w, unnest(range(1, greatest(len(w) - {decontaminate.WINDOW - 1}, 1) + 1)) as i from items
          where len(w) > 0)),
sizes as (select distinct size from item_windows),
docs as (select doc_id, {_BENCH_WORDS.format(lowered=_LOWERED)} as w from documents),
found as (
    select doc_id, i, x.size, item_id, phrase from (
        select doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as phrase
        from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from docs, sizes)) x
    join item_windows using (phrase)),
hit as (
    select doc_id, count(distinct place) as n_hit
    from (select doc_id, unnest(range(i, i + size)) as place from found) group by doc_id),
of_items as (select doc_id, list_sort(list(distinct item_id)) as ids from found group by doc_id),
terms as (
    select phrase, unnest(string_split(phrase, ' ')) as term, unnest(range(size)) as o
    from (select distinct phrase, size from item_windows)),
places as (select doc_id, unnest(w) as term, unnest(range(len(w))) as place from docs),
counts as (select term, count(*) as n from places group by term),
probes as (
    select phrase, term, o, row_number() over (partition by phrase order by n, o) as rank
    from terms left join counts using (term)
    qualify bool_and(n is not null) over (partition by phrase)),
near_1 as (
    select distinct doc_id, phrase, place - o as start from probes join places using (term) where rank = 1),
{_near(2)},
{_near(3)},
near as (
    select doc_id, count(distinct phrase) as n_near
    from near_3 anti join found using (doc_id, phrase) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
    cast(coalesce(len(ids), 0) as bigint) as n_items,
    sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
    coalesce(n_near, 0) as n_near
from docs left join hit using (doc_id) left join of_items using (doc_id) left join near using (doc_id)"""
