"""DuckDB SQL with the same rows as the queries, where SQL can express them on whole tables."""

from __future__ import annotations

from tesserae.llm.quality import CLASSES, MIN_CHARS, MIN_WORDS, MOST_CLASSES, N_COMMON, NOISE

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(words: str, k: int) -> str:
    joined = " || ' ' || ".join([f"{words}[i + {j}]" if j else f"{words}[i]" for j in range(k)])
    return f"case when len({words}) = 0 then [] when len({words}) < {k} then [array_to_string({words}, ' ')] else list_distinct(list_transform(range(1, len({words}) - {k - 2}), lambda i: {joined})) end"


def near_dup(k: int, percent: int, source: str = "documents") -> str:
    """CTEs that end in near_dup(doc_id, n_shingles, component_id, kept)."""
    return f"""nd_w as (select doc_id, {_WORDS.format(_ASCII_LOWER)} as w from {source}),
nd_s as (select doc_id, {_shingles('w', k)} as s from nd_w),
nd_n as (select doc_id, len(s) as n from nd_s),
nd_x as (select doc_id, unnest(s) as g from nd_s),
nd_rare as (select g from nd_x group by g having count(*) > 1),
nd_y as (select nd_x.doc_id, hash(nd_x.g) as g from nd_x join nd_rare using (g)),
nd_p as (select a.doc_id as a, b.doc_id as b, count(*) as both_ from nd_y a join nd_y b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
nd_l as (select a, b from nd_p join nd_n na on na.doc_id = a join nd_n nb on nb.doc_id = b where 100 * both_ >= {percent} * (na.n + nb.n - both_)),
nd_e as (select a, b from nd_l union all select b, a from nd_l),
nd_r(node, root) as (select doc_id, doc_id from nd_n union select nd_e.b, nd_r.root from nd_r join nd_e on nd_e.a = nd_r.node),
nd_c as (select node, min(root) as component_id from nd_r group by node),
near_dup as (select nd_n.doc_id, nd_n.n::bigint as n_shingles, nd_c.component_id, nd_n.doc_id = nd_c.component_id as kept from nd_n join nd_c on nd_c.node = nd_n.doc_id)"""


def contamination(k: int, percent: int, source: str = "documents") -> str:
    """CTEs that end in contamination(doc_id, item_id, n_shingles, n_shared, containment)."""
    words = _WORDS.format("lower(coalesce(text, ''))")
    return f"""ct_d as (select doc_id, {words} as w from {source}),
ct_b as (select item_id, {words} as w from benchmark),
ct_i as (select item_id, {_shingles('w', k)} as s from ct_b),
ct_j as (select item_id, len(s) as n, unnest(s) as g from ct_i),
ct_x as (select doc_id, unnest({_shingles('w', k)}) as g from ct_d),
ct_h as (select doc_id, item_id, any_value(n)::bigint as n_shingles, count(*) as n_shared from ct_x join ct_j using (g) group by 1, 2),
contamination as (select *, n_shared / n_shingles as containment from ct_h where 100 * n_shared >= {percent} * n_shingles)"""


#: CRC-32 (reflected 0xEDB88320) of each half byte.
_CRC = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"

SHARDS = f"""
with recursive h as (select doc_id, coalesce(text, '') as text, string_split(hex(encode(coalesce(text, ''))), '') as x, octet_length(encode(coalesce(text, ''))) as n from documents),
c as (select doc_id, n, list_reduce(list_transform(range(0, 2 * n), lambda i: (strpos('0123456789ABCDEF', x[i - i % 2 + 2 - i % 2]) - 1)::bigint),
  lambda a, v: xor(a >> 4, ({_CRC}::bigint[])[(xor(a, v) & 15) + 1]), 4294967295::bigint) as crc from h),
j(doc_id, n, key, b, j) as (select doc_id, n, doc_id::hugeint, -1::bigint, 0::bigint from documents, (values (16), (17)) v(n)
  union all select doc_id, n, k, j, floor((j + 1)::double * (2147483648::double / (k // 8589934592 + 1)::double))::bigint
  from (select *, (key * 2862933555777941757 + 1) % 18446744073709551616::hugeint as k from j where j < n)),
s as (select a.doc_id, a.b as shard, g.b as grown_shard from j a join j g using (doc_id) where a.n = 16 and g.n = 17 and a.j >= 16 and g.j >= 17)
select doc_id, (c.n + 1)::bigint as size, xor(coalesce(crc, 4294967295), 4294967295)::bigint as text_crc32, 'key' as law, shard::int as shard,
  row_number() over (partition by shard order by doc_id) - 1 as slot, grown_shard::int as grown_shard from c join s using (doc_id)"""


def quality(source: str = "documents") -> str:
    """CTEs that end in quality(doc_id, base counts, base_failed, kept)."""
    names = [f"c{i}" for i in range(len(CLASSES) + 1)] + [f"w{i}" for i in range(N_COMMON + 1)]
    taken, before, left = [], "text", []
    for i, pattern in enumerate(CLASSES.values()):
        left.append(f"regexp_replace({before}, '{pattern.replace(chr(92) * 2, chr(92) * 2)}', '', 'g') as left{i}")
        taken.append(f"length({before}) - length(left{i}) as c{i}")
        before = f"left{i}"
    taken.append(f"length({before}) as c{len(CLASSES)}")
    common = [f"len(list_filter(w, lambda x: x = known[{i + 1}])) as w{i}" for i in range(N_COMMON)]
    common.append(f"len(w) - len(list_filter(w, lambda x: list_contains(known, x))) as w{N_COMMON}")
    words = "+".join(f"q_w{i}" for i in range(N_COMMON + 1))
    share = f"(q_w{N_COMMON}::double / nullif({words}, 0))"
    most = f"sqrt(greatest((0.5 * ln(2 / (1 + {share})) + 0.5 * ((1 - {share}) * ln(2.0) + case when {share} > 0 then {share} * ln(2 * {share} / (1 + {share})) else 0 end)) / ln(2.0), 0))"
    chance = f"({NOISE!r} / sqrt(n_words::double))"

    def distance(kind: str) -> str:
        cols = [c for c in names if c[0] == kind]
        p, q = "+".join(cols), "+".join("q_" + c for c in cols)
        term = "case when {x} > 0 then 0.5 * {x} * ln(2 * {x} / ({a} + {b})) else 0 end"
        parts = []
        for c in cols:
            a, b = f"({c}::double / nullif({p}, 0))", f"(q_{c}::double / nullif({q}, 0))"
            parts += [term.format(x=x, a=a, b=b) for x in (a, b)]
        return f"case when {p} > 0 and {q} > 0 then sqrt(greatest(({' + '.join(parts)}) / ln(2.0), 0)) else 0 end"

    def compared(i: int) -> str:
        good = "ql_b where not base_failed" if i == 1 else "ql_j1 where not base_failed and not diverges"
        return f"""ql_q{i} as (select lang, {', '.join(f'sum({c})::double as q_{c}' for c in names)} from {good} group by lang),
ql_d{i} as (select ql_b.*, {distance('c')} as class_distance, {distance('w')} as common_distance, {most} as most from ql_b left join ql_q{i} using (lang)),
ql_j{i} as (select *, ({'+'.join(c for c in names if c[0] == 'c')} >= {MIN_CHARS} and class_distance > {MOST_CLASSES}) or coalesce(n_words >= {MIN_WORDS} and 2 * {chance} <= most and common_distance > ({chance} + 2 * most) / 3, false) as diverges from ql_d{i}),"""

    return f"""ql_t as (select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text from {source}),
ql_x as (select *, {_WORDS.format('text')} as w from ql_t),
ql_g as (select lang, g, count(*) as n from (select lang, unnest(w) as g from ql_x) where regexp_matches(g, '^\\p{{L}}+$') group by 1, 2),
ql_k as (select lang, list(g order by n desc, g) as known from (select *, row_number() over (partition by lang order by n desc, g) as r from ql_g) where r <= {N_COMMON} group by lang),
ql_w as (select ql_x.*, coalesce(known, []) as known from ql_x left join ql_k using (lang)),
ql_v as (select doc_id, unnest(range(1, len(w) - 3)) as i, w from ql_w where len(w) >= 5),
ql_h as (select doc_id, i, hash(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) as g from ql_v),
ql_m as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as k from ql_h) where k > 1),
ql_o as (select doc_id, sum(least(coalesce(nxt, i + 5) - i, 5)) as n from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from ql_m) group by doc_id),
ql_l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from ql_t),
ql_c as (select doc_id, {', '.join(left[:1])}, text, lang, w, known from ql_w),
{''.join(f"ql_c{i} as (select *, {x} from ql_c{i - 1 if i > 1 else ''}), " for i, x in enumerate(left) if i)}
ql_f as (select doc_id, lang, len(w) as n_words, length(text) - (length(left0) - length(left1)) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, {', '.join(taken)}, {', '.join(common)} from ql_c{len(left) - 1}),
ql_b as (select ql_f.*, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(ql_o.n, 0) as n_repeat_words, n_words < 10 or 100 * coalesce(ql_o.n, 0) > 20 * n_words as base_failed
  from ql_f join ql_l using (doc_id) left join ql_o using (doc_id)),
{''.join(compared(i) for i in (1, 2))}
quality as (select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and not diverges as kept from ql_j2)"""


SQL = {
    "op1_minhash_near_dup": f"with recursive {near_dup(3, 85)} select * from near_dup",
    "op2_decontamination": f"with {contamination(5, 80)} select * from contamination",
    "op3_jump_sharding": SHARDS,
    "op4_quality_divergence": f"with {quality()} select * from quality",
}
