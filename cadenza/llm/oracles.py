"""DuckDB SQL of the queries that SQL can express. The others are tested against brute force."""

from __future__ import annotations

from . import mixing, sharding

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
s AS (SELECT rid, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY md5(array_to_string(w[i:i + 34], ' '))) > 1 AS twice FROM s),
p AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
c AS (SELECT p.rid, p.i, p.x, coalesce(max(g.twice::INT) OVER (PARTITION BY p.rid ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) = 1 AS gone FROM p LEFT JOIN g ON g.rid = p.rid AND g.i = p.i),
a AS (SELECT rid, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (rid)
"""

OP3 = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT *, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS lead FROM p),
n AS (SELECT *, list_transform(range(8), lambda g: ('0x' || substr(h, 5 * g + 1, 5))::INTEGER) AS v FROM h)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
  array_to_string(list_transform(v, lambda n: list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n // k) % 32) + 1, 1) FOR k IN [32768, 1024, 32, 1]], 'string_agg', '')), '') AS payload_digest,
  CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lead THEN lead END AS refers_to, url, true AS valid FROM n
"""

#: CRC-32 a byte at a time; its table is made by the polynomial's rule.
OP5 = f"""
WITH t AS (SELECT [list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS tab),
b AS (SELECT row_number() OVER () AS rid, doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, [('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] AS raw FROM documents),
c AS (SELECT doc_id, source, size::BIGINT AS size, xor(list_reduce(list_prepend(4294967295, raw), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS crc FROM b, t),
k AS (SELECT *, coalesce('=' || source, '') AS stratum, md5(concat_ws('|', '{sharding.SEED}', coalesce(doc_id::VARCHAR, ''), crc)) AS key FROM c),
r AS (SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY key) - 1) / (2 * count(*) OVER (PARTITION BY stratum))::DOUBLE AS frac FROM k),
o AS (SELECT *, row_number() OVER (ORDER BY frac, stratum, key) - 1 AS pos, count(*) OVER () AS n FROM r)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (pos * {sharding.SHARDS} // n)::INTEGER AS shard, (pos - (pos * {sharding.SHARDS} // n * n + {sharding.SHARDS - 1}) // {sharding.SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM o
"""

OP6 = f"""
WITH i AS (SELECT row_number() OVER () AS k, item_id, regexp_extract_all({_FOLD}, {_ALNUM}) AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_FOLD}, {_ALNUM}) AS w FROM documents),
t AS (SELECT DISTINCT n FROM q),
s AS (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, t WHERE len(w) >= n),
m AS (SELECT s.rid, s.i, s.n, q.item_id FROM s JOIN q ON q.n = s.n AND q.gram = array_to_string(s.w[s.i:s.i + s.n - 1], ' ')),
c AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
l AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM m WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN l USING (rid)
"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, {_SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ') || ' ' || least(len(w), 5)) AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
f AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, f.v FROM r JOIN f ON f.u = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def _case(level: str) -> str:
    return "CASE " + level + "".join(f" WHEN '{k}' THEN {v}" for k, v in mixing.WEIGHTS[level].items()) + " ELSE 1 END" if mixing.WEIGHTS[level] else "1"


def _level(n: int) -> str:
    keys = mixing.LEVELS[: n + 1]
    level, parent = keys[-1], ", ".join(keys[:-1]) or "1"
    on = " AND ".join(f"b{n}.{k} = n{n}.{k}" for k in keys[:-1]) or "true"
    before = f"PARTITION BY {parent} ORDER BY cap / w, {level}"
    return f"""
n{n} AS (SELECT {", ".join(keys)}, sum(cap)::HUGEINT AS cap, any_value({_case(level)})::HUGEINT AS w FROM leaf GROUP BY {", ".join(keys)}),
m{n} AS (SELECT n{n}.*, b{n}.budget::HUGEINT AS budget FROM n{n} JOIN b{n} ON {on}),
s{n} AS (SELECT *, sum(w) OVER (PARTITION BY {parent}) AS wa, coalesce(sum(w) OVER p, 0) AS wb, coalesce(sum(cap) OVER p, 0) AS cb FROM m{n} WINDOW p AS ({before} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f{n} AS (SELECT *, min(CASE WHEN cap * (wa - wb) <= (budget - cb) * w THEN 1 ELSE 0 END) OVER ({before} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fu FROM s{n}),
g{n} AS (SELECT *, budget - coalesce(sum(CASE WHEN fu = 1 THEN cap END) OVER (PARTITION BY {parent}), 0) AS rest, sum(CASE WHEN fu = 0 THEN w ELSE 0 END) OVER (PARTITION BY {parent}) AS wl,
  sum(CASE WHEN fu = 0 THEN w ELSE 0 END) OVER ({before} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wt FROM f{n}),
b{n + 1} AS (SELECT {", ".join(keys)}, CASE WHEN fu = 1 THEN cap ELSE rest * wt // wl - rest * (wt - w) // wl END AS budget FROM g{n})"""


OP7 = f"""
WITH d AS (SELECT doc_id, coalesce(CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) <> '' THEN 'd' || (regexp_extract(coalesce(source, ''), '([0-9]+)$', 1)::BIGINT % 4) ELSE 'none' END, '') AS domain,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), {_SPACED}))::BIGINT AS n_tokens, md5(coalesce(text, '')) AS tie FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens) * {mixing.EPOCHS} AS cap FROM d GROUP BY ALL),
b0 AS (SELECT least(sum(tokens) * {mixing.PERCENT} // 100, sum(cap)) AS budget FROM leaf),{_level(0)},{_level(1)},{_level(2)},
l AS (SELECT domain, lang, source, tokens AS leaf_tokens, budget::BIGINT AS leaf_budget, CASE WHEN tokens > 0 THEN budget::BIGINT // tokens ELSE 0 END AS e FROM leaf JOIN b3 USING (domain, lang, source)),
o AS (SELECT d.*, leaf_tokens, leaf_budget, e, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws('|', '{mixing.SEED}', e, doc_id, tie)) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d JOIN l USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, leaf_tokens, leaf_budget, (e + CASE WHEN leaf_budget - e * leaf_tokens > 0 AND upto <= leaf_budget - e * leaf_tokens THEN 1 ELSE 0 END)::BIGINT AS copies FROM o
"""

SQL = {"op1_substring_dedup": OP1, "op3_warc": OP3, "op5_sharding": OP5, "op6_benchmark_decontamination": OP6, "op7_mixing": OP7, "op8_minhash_near_dedup": OP8}
