"""The queries of this package that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

from cutpoint.llm.secrets import BASE, KINDS


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def secrets_sql() -> str:
    parts = []
    for i, kind in enumerate(KINDS):
        p = _quoted(kind.pattern)
        parts.append(
            f"SELECT rid, doc_id, source, lang, {i} AS kind, unnest(regexp_extract_all(t, {p}, 0)) AS m,"
            f" unnest(regexp_extract_all(t, {p}, {kind.group})) AS v,"
            f" unnest(string_split_regex(t, {p})[1:len(regexp_extract_all(t, {p}, 0))]) AS gap,"
            f" unnest(range(len(regexp_extract_all(t, {p}, 0)))) AS place FROM docs WHERE regexp_matches(t, {p})"
        )
    fits = " OR ".join(
        f"(kind = {i} AND length(v) >= {k.least}" + "".join(f" AND regexp_matches(v, {_quoted(h)})" for h in k.holds) + ")"
        for i, k in enumerate(KINDS)
    )
    names = "[" + ", ".join(_quoted(k.name) for k in KINDS) + "]"
    one = f"{names}[kind + 1] || ':' || \"start\" || ':' || stop"
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = {i}), 0) AS n_{k.name}" for i, k in enumerate(BASE))
    base = len(BASE)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(parts)}),
placed AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY rid, kind ORDER BY place) AS stop FROM raw),
fit AS (SELECT rid, source, lang, kind, v, CAST(stop - length(m) AS BIGINT) AS "start", CAST(stop AS BIGINT) AS stop
        FROM placed WHERE {fits}),
near AS (SELECT *,
  max(stop) OVER (PARTITION BY rid ORDER BY "start", kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached,
  min(CASE WHEN kind < {base} THEN "start" END)
    OVER (PARTITION BY rid ORDER BY "start", kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_base
  FROM fit),
clear AS (SELECT * FROM near WHERE kind < {base}
          OR ((reached IS NULL OR reached <= "start") AND (next_base IS NULL OR next_base >= stop))),
held AS (SELECT v, coalesce(source, chr(0)) AS o, count(DISTINCT coalesce(lang, chr(0))) AS r FROM clear GROUP BY ALL),
owners AS (SELECT v, count(*) AS n_owners, max(r) AS n_repositories FROM held GROUP BY v),
spans AS (SELECT rid, kind, "start", stop, n_owners = 1 AND n_repositories <= 2 AS live
          FROM clear JOIN owners USING (v) WHERE kind < {base} OR (n_owners = 1 AND n_repositories <= 2)),
per_row AS (SELECT rid, {counts},
  sha256(coalesce(string_agg({one}, ',' ORDER BY "start", kind) FILTER (kind < {base}), '')) AS base_sha256,
  string_agg({one}, ',' ORDER BY "start", kind) AS spans, count(*) FILTER (live) AS n_live
  FROM spans GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in BASE)},
  coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM docs LEFT JOIN per_row USING (rid)
"""


VECTOR_SEARCH = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""

#: crc32 of a number's digits is written out: bit by bit over its bytes.
PREFIX_TRIE = """
WITH RECURSIVE bits(i, c) AS (SELECT CAST(i AS BIGINT), CAST(i AS BIGINT) FROM range(256) t(i)),
steps AS (SELECT i, c, 0 AS k FROM bits UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS lookup FROM steps WHERE k = 8),
own AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda d: CAST(ascii(d) AS BIGINT))), lambda c, d: xor(c // 256, lookup[xor(c, d) % 256 + 1])), 4294967295) % 9 AS h FROM own, crc),
full_turns AS (SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
  FROM h a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
prefix AS (SELECT conv_id, len(turns) AS n, d, turns[1:d] AS p, turns[1:d - 1] AS up, coalesce(octet_length(encode(turns[d].t)), 0) AS bytes
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM full_turns)),
node AS (SELECT d, p, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS own_saved,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM prefix GROUP BY d, p),
kids AS (SELECT d - 1 AS d, up AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
known AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids ON node.d = kids.d AND node.p = kids.p),
under AS (SELECT a.d, a.p, sum(b.own_saved) AS saved, count(*) FILTER (b.n_children = 0) AS leaves
  FROM (SELECT DISTINCT x.d, x.p, y.d AS bd, y.p AS bp FROM prefix x JOIN prefix y ON x.conv_id = y.conv_id AND y.d >= x.d) a
  JOIN known b ON b.d = a.bd AND b.p = a.bp GROUP BY a.d, a.p)
SELECT k.conv_id, k.d AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.leaves AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, k.ends_sha256
FROM known k JOIN under s ON k.d = s.d AND k.p = s.p LEFT JOIN known u ON u.d = k.d - 1 AND u.p = k.up
"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

ORACLES = {"op11_prefix_trie": PREFIX_TRIE, "op13_hard_negatives": HARD_NEGATIVES, "op7_vector_search": VECTOR_SEARCH, "op10_secrets": secrets_sql()}
