"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

from spanwise.llm.mixing import BLOCK, MAX_SHARDS, MOST, SEED, SHARD_ROWS, SHARE, WEIGHTS

_WEIGHT = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))


def _seeded(seed: int, *cols: str) -> str:
    """A whole number below 2**52 from md5."""
    parts = ", ".join([f"'{seed}'", *(f"coalesce({c}::VARCHAR, '')" for c in cols)])
    return f"('0x' || substr(md5(concat_ws('|', {parts})), 1, 13))::BIGINT"


#: Targets by filling up sources in order; quotas as the highest quotients, here as a list of all that can matter.
MIXING = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS h FROM documents),
r AS (SELECT *, {_seeded(SEED, "doc_id", "h")} AS at FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows FROM r GROUP BY source),
w AS (SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {_WEIGHT} END)::DOUBLE AS weight FROM s),
a AS (SELECT *, {MOST} * source_size / weight AS full_at FROM w),
l AS (SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - {MOST} * coalesce(sum(source_size) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
 FROM a WINDOW f AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, n_rows, least({MOST} * source_size::DOUBLE, coalesce(max(CASE WHEN level <= full_at THEN level END) OVER (), 'inf'::DOUBLE) * weight) AS target,
 least(ceil(n_rows / {SHARD_ROWS}), {MAX_SHARDS})::BIGINT AS shards FROM l),
p AS (SELECT r.*, t.source_size, t.target, r.at % t.shards AS shard FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
c AS (SELECT source, shard, sum(size)::BIGINT AS cell, any_value(target) AS target FROM p GROUP BY source, shard),
g AS (SELECT *, floor(target / {BLOCK} + 0.5)::BIGINT AS seats, sum(cell) OVER (PARTITION BY source) AS total, count(*) OVER (PARTITION BY source) AS n FROM c),
x AS (SELECT source, shard, seats, cell::DOUBLE / (2 * k - 1) AS q FROM (SELECT *, unnest(range(1, (ceil(cell * seats::DOUBLE / total) + n + 3)::BIGINT)) AS k FROM g WHERE cell > 0)),
y AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q DESC, shard) AS place FROM x),
z AS (SELECT source, shard, count(*) AS quota FROM y WHERE place <= seats GROUP BY source, shard),
b AS (SELECT c.source, c.shard, c.cell, coalesce(z.quota, 0) AS quota, greatest(ceil(c.cell / {BLOCK}), 1)::BIGINT AS n, {_seeded(SEED + 1, "c.source", "c.shard")} AS u FROM c LEFT JOIN z ON c.source IS NOT DISTINCT FROM z.source AND c.shard = z.shard),
e AS (SELECT *, least(quota // n, {MOST})::BIGINT AS complete, CASE WHEN quota // n >= {MOST} THEN 0 ELSE quota % n END AS more, u % n AS start FROM b),
o AS (SELECT p.doc_id, p.size, p.source_size, p.target, p.shard, p.source, e.quota, e.complete, e.more, e.start, e.n, sum(p.size) OVER (PARTITION BY p.source, p.shard ORDER BY p.at, p.doc_id, p.size, p.h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi
 FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source AND p.shard = e.shard)
SELECT doc_id, size, source_size, target, (complete * size + greatest(least(hi, (start + more) * {BLOCK}) - greatest(hi - size, start * {BLOCK}), 0) + greatest(least(hi, greatest(start + more - n, 0) * {BLOCK}) - (hi - size), 0))::BIGINT AS taken, shard, quota::BIGINT AS quota, source FROM o
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

#: Scores of every document that shares a term with an item.
SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS t FROM documents),
n AS (SELECT rid, doc_id, t, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
a AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
i AS (SELECT row_number() OVER () AS iid, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT iid, item_id, term, count(*)::BIGINT AS times FROM (SELECT iid, item_id, unnest({_TERMS}) AS term FROM i) GROUP BY ALL),
p AS (SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT rid, doc_id, n, unnest(t) AS term FROM n) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, a GROUP BY term, n_docs),
s AS (SELECT iid, item_id, rid, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
 FROM p JOIN w USING (term) JOIN q USING (term), a GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20
"""

_PART = "array_to_string(string_split(c.phrase, ' ')[{}:{}], ' ')"

#: All runs of up to five words, counted.
PHRASES = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, {_LOWER.format('text')} AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS phrase FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k),
n AS (SELECT lang, count(*)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a) AS score, j
 FROM c JOIN n USING (lang) JOIN f l ON l.lang = c.lang AND l.phrase = {_PART.format(1, "j")} JOIN f r ON r.lang = c.lang AND r.phrase = {_PART.format("j + 1", "c.k")}),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
u AS (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2),
v AS (SELECT *, unnest(range(1, k - m + 2)) AS i FROM u),
x AS (SELECT lang, {_PART.format("i", "i + m - 1")} AS phrase, max(a) AS longer FROM v c GROUP BY ALL),
y AS (SELECT b.* FROM b LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM y) WHERE rank <= 2000
"""

#: All strings of 100 bytes, in hexadecimal.
SUBSTRINGS = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT rid, doc_id, s, md5(substr(x, 2 * s + 1, 200)) AS h FROM (SELECT *, unnest(range(0, len(x) // 2 - 99)) AS s FROM d WHERE len(x) >= 200)),
f AS (SELECT rid, s FROM (SELECT rid, s, rank() OVER (PARTITION BY h ORDER BY doc_id NULLS FIRST, s) AS r FROM g) WHERE r > 1),
i AS (SELECT rid, s, sum(fresh) OVER (PARTITION BY rid ORDER BY s) AS span FROM (SELECT rid, s, (s - coalesce(lag(s) OVER (PARTITION BY rid ORDER BY s), -1000) > 100)::INT AS fresh FROM f)),
o AS (SELECT rid, min(s) AS b, max(s) + 100 AS e FROM i GROUP BY rid, span),
k AS (SELECT rid, count(*) AS n_spans, sum(e - b)::BIGINT AS n_removed FROM o GROUP BY rid),
l AS (SELECT rid, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY b), 0) AS b, b AS e FROM o UNION ALL SELECT rid, max(e), 1000000000 FROM o GROUP BY rid),
t AS (SELECT rid, string_agg(substr(x, 2 * b + 1, 2 * (e - b)), '' ORDER BY b) AS y FROM l JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM d LEFT JOIN k USING (rid) LEFT JOIN t USING (rid)
"""

ORACLE_SQL: dict[str, str] = {"op10_sainte_lague": MIXING, "op11_two_stage_suffixes": SUBSTRINGS, "op12_bit_sliced_impacts": SEARCH, "op13_apriori_phrases": PHRASES}
