"""Checking SQL for DuckDB, for the operators that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# pattern, and what a value `v` must meet
_LUHN = """list_sum(list_transform(range(1, length(d) + 1), lambda p:
    case when p % 2 = 1 then cast(d[length(d) - p + 1] as int)
         else (2 * cast(d[length(d) - p + 1] as int)) // 10 + (2 * cast(d[length(d) - p + 1] as int)) % 10 end)) % 10 = 0"""
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
     "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 or coalesce(try_cast(ltrim(p, '0') as int), 0) > 255)) = 0"),
    ("card", r"[0-9](?:[ -]?[0-9])+", f"length(d) between 16 and 19 and {_LUHN}"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "length(d) between 8 and 15"),
)


def _personal_data() -> str:
    found, matches = [], []
    for n, (kind, pattern, _) in enumerate(_KINDS):
        found.append(f"""select doc_id, {n} as k, '{kind}' as kind, vs, gaps, unnest(range(1, len(vs) + 1)) as i from (
            select doc_id, regexp_extract_all(t, '{pattern}') as vs, string_split_regex(t, '{pattern}') as gaps from docs)""")
        matches.append(f"when kind = '{kind}' then {_KINDS[n][2]}")
    return f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
found as ({" union all ".join(found)}),
placed as (select doc_id, k, kind, vs[i] as v, regexp_replace(vs[i], '[^0-9]', '', 'g') as d,
    list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(vs[1:i - 1], lambda g: length(g))), 0) as s from found),
kept as (select doc_id, k, kind, s, s + length(v) as e from placed where case {" ".join(matches)} end),
per_doc as (select doc_id, count(*) filter (k = 0) as n_email, count(*) filter (k = 1) as n_ip, count(*) filter (k = 2) as n_card,
    count(*) filter (k = 3) as n_phone,
    string_agg(kind || ':' || cast(cast(s as bigint) as varchar) || ':' || cast(cast(e as bigint) as varchar), ',' order by k, s) as spans from kept group by doc_id)
select d.doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
    sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from docs d left join per_doc using (doc_id)"""


def _passages(window: int = 10) -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), '{u}', '{l}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(u=_UPPER, l=_LOWER)
    return f"""
with items as (select item_id, {words} as w from benchmark),
windows as (select distinct item_id, least({window}, len(w)) as size, w[i:i + least({window}, len(w)) - 1] as win
    from (select item_id, w, unnest(range(1, len(w) - least({window}, len(w)) + 2)) as i from items where len(w) > 0)),
sizes as (select distinct size from windows),
docs as (select doc_id, {words} as w from documents),
starts as (select doc_id, size, i, w[i:i + size - 1] as win
    from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from docs, sizes where len(w) >= size)),
hits as (select doc_id, item_id, size, i from starts join windows using (size, win)),
words_hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from (select distinct doc_id, size, i from hits)) group by 1),
items_hit as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
    from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs d left join words_hit using (doc_id) left join items_hit using (doc_id)"""


_SHINGLES = r"""
docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{u}', '{l}'), '[^\x20\x09-\x0D]+') as w from documents),
grams as (select distinct doc_id, case when len(w) < 4 then w else w[i:i + 3] end as g
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from docs where len(w) > 0)),
sizes as (select doc_id, count(*) as n from grams group by 1)""".format(u=_UPPER, l=_LOWER)

_JOIN = f"""
with recursive {_SHINGLES},
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from sizes union select r.a, l.b from reach r join both_ways l on r.b = l.a)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(m, d.doc_id) as component_id
from documents d left join sizes s on s.doc_id = d.doc_id left join (select a, min(b) as m from reach group by 1) r on r.a = d.doc_id"""

# crc32 of v, an id as decimal text: byte by byte, bit by bit
_CRC = """xor(list_reduce(list_transform(range(1, length(v) + 1), lambda p: ascii(v[p])),
    lambda c, x: list_reduce(range(8), lambda d, k: if(d & 1 = 1, xor(d >> 1, 3988292384), d >> 1), xor(c, x)), 4294967295), 4294967295)"""


def _leaf(chars: str) -> str:
    parts = [f"coalesce(cast(strlen(cast({c} as varchar)) as varchar) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", chars, "text")]
    return f"sha256({' || '.join(parts)})"


def _nodes(name: str, leaves: str) -> str:
    """All nodes of the trees over the leaves (g, i, h, n): g, level, i, h, n nodes in that level."""
    return f"""{name} as (select g, 0 as level, i, h, n from {leaves}
    union all select g, any_value(level) + 1, i // 2, sha256(string_agg(h, '' order by i)), (any_value(n) + 1) // 2 from {name} where n > 1 group by g, i // 2)"""


def _ways(name: str, leaves: str, nodes: str) -> str:
    """Of each leaf (g, i) the digests before and after its node, level by level."""
    return f"""{name} as (select s.g, s.i, list({{'l': coalesce(if(o.i < p.i, o.h, ''), ''), 'r': coalesce(if(o.i > p.i, o.h, ''), ''), 'h': ''}} order by p.level) as way
    from {leaves} s join {nodes} p on p.g = s.g and p.i = s.i >> p.level and p.n > 1
    left join {nodes} o on o.g = p.g and o.level = p.level and o.i = xor(p.i, 1) group by s.g, s.i)"""


_MANIFEST = f"""
with recursive ids as (select doc_id, cast(doc_id as varchar) as v from (select distinct doc_id from documents where doc_id is not null)),
tampered as (select doc_id from ids where {_CRC} % 7 = 0),
docs as (select doc_id, coalesce('=' || lang, '') as g, {_leaf("n_chars")} as h, {_leaf("n_chars + 1")} as changed from documents),
leaves as (select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 as i, count(*) over (partition by g) as n from docs),
{_nodes("nodes", "leaves")},
subroots as (select '' as g, g as member, h, row_number() over (order by g) - 1 as i, count(*) over () as n from nodes where n = 1),
{_nodes("upper", "subroots")},
{_ways("low", "leaves", "nodes")},
{_ways("high", "subroots", "upper")},
placed as (select d.doc_id, d.h as leaf, s.h as subroot, (select h from upper where n = 1) as root, if(x.doc_id is null, d.h, d.changed) as start,
        list_concat(coalesce(low.way, []), coalesce(high.way, [])) as way
    from leaves d join subroots s on s.member = d.g left join low on low.g = d.g and low.i = d.i left join high on high.i = s.i
    left join tampered x on x.doc_id = d.doc_id),
folded as (select *, list_reduce(list_prepend({{'l': '', 'r': '', 'h': start}}, way), lambda a, b: {{'l': '', 'r': '', 'h': sha256(b.l || a.h || b.r)}}).h as folded_root
    from placed)
select doc_id, leaf, subroot, root, sha256(list_aggregate(list_prepend('', list_transform(way, lambda s: s.l || s.r)), 'string_agg', '')) as proof_sha256, folded_root,
    folded_root = root as verified from folded"""

_NEGATIVES = """
with vectors as (select vec_id, if(vec_id % 7 = 0, (label + 1) % 10, label) as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
    from embeddings where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
    from vectors a join vectors b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
positives as (select anchor_id, vec_id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by n.score desc, n.vec_id) as int) as rank, n.vec_id as negative_id,
    positive_score, n.score as negative_score
from positives p join scored n on n.anchor_id = p.anchor_id and not n.same and 50 * positive_score <= 100 * n.score and 100 * n.score <= 95 * positive_score
qualify rank <= 3"""

_NEAR_VECTORS = """
with recursive vectors as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
    where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from vectors a join vectors b on a.label = b.label and a.vec_id <> b.vec_id
    where list_cosine_similarity(a.v, b.v) >= 0.93),
reach as (select vec_id as a, vec_id as b from vectors union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a, min(b) as component_id from reach group by a),
counts as (select a, count(*) as n_links from links group by a)
select vec_id, coalesce(n_links, 0) as n_links, cast(coalesce(component_id, vec_id) as bigint) as component_id, coalesce(component_id, vec_id) = vec_id as kept
from embeddings e left join least on least.a = e.vec_id left join counts on counts.a = e.vec_id"""

# crc32 of every text's bytes by the table of the 256 byte remainders, which the CTE builds by rule
_SHARDS = r"""
with remainders as (select list(list_reduce(list_prepend(b, range(8)), lambda d, k: if(d & 1 = 1, xor(d >> 1, 3988292384), d >> 1)) order by b) as t from range(256) as r(b)),
docs as (select doc_id, md5(text) as o, coalesce(strlen(text), 0) + 1 as size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: cast('0x' || h as bigint))),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as text_crc32 from documents, remainders),
placed as (select doc_id, size, text_crc32, o, least((2 * sum(size) over (order by o nulls first, doc_id) - size) * 8 // (2 * sum(size) over ()), 7) as shard from docs)
select doc_id, size, text_crc32, 'bytes' as law, cast(shard as int) as shard, row_number() over (partition by shard order by o nulls first, doc_id) - 1 as slot,
    cast(null as int) as grown_shard from placed"""

SQL = {
    "op1_pii": _personal_data(),
    "op3_ngram_jaccard_join": _JOIN,
    "op7_sharding": _SHARDS,
    "op9_benchmark_decontamination": _passages(),
    "op11_embedding_near_dedup": _NEAR_VECTORS,
    "op12_merkle_dataset_manifest": _MANIFEST,
    "op13_hard_negative_mining": _NEGATIVES,
}
