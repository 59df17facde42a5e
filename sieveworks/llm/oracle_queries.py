"""SQL for the opN queries that SQL can express, in the dialect of the checking engine."""

from __future__ import annotations

from . import secrets

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
 late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
 each AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
 kept AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY p) FILTER (WHERE g.p IS NULL) AS k, count(g.p) AS n FROM each AS e LEFT JOIN gone AS g USING (doc_id, p) GROUP BY 1)
 SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""".replace("JOIN gone AS g USING (doc_id, p)", "JOIN gone AS g ON e.doc_id = g.doc_id AND e.p = g.p").replace("string_agg(x, ' ' ORDER BY p)", "string_agg(x, ' ' ORDER BY e.p)")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _spans(pattern: str, kind: int, keep: str) -> str:
    m, g = f"regexp_extract_all(t, {_quoted(pattern)})", f"string_split_regex(t, {_quoted(pattern)})"
    start = "coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    return f"(SELECT doc_id, s AS \"start\", {kind} AS kind, s + length(body) AS \"end\", body FROM (SELECT doc_id, m[i] AS body, CAST({start} AS BIGINT) AS s FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, {m} AS m, {g} AS g FROM d))) WHERE {keep})"


_LOWER_IN, _UPPER_IN, _DIGIT_IN, _MARK_IN, _LONG = "regexp_matches(body, '[a-z]')", "regexp_matches(body, '[A-Z]')", "regexp_matches(body, '[0-9]')", "regexp_matches(body, '[+/_=-]')", f"length(body) >= {secrets.WINDOW}"
_KIND = f"""CASE WHEN regexp_full_match(body, '[0-9a-f]+|[0-9A-F]+') AND {_DIGIT_IN} AND regexp_matches(body, '[a-zA-Z]') THEN 3.0 WHEN {_LOWER_IN} AND {_UPPER_IN} AND {_DIGIT_IN} AND {_MARK_IN} THEN CASE WHEN {_LONG} THEN 3.7 END WHEN {_MARK_IN} THEN NULL
 WHEN {_LOWER_IN} AND {_UPPER_IN} AND {_DIGIT_IN} THEN CASE WHEN {_LONG} THEN 3.6 ELSE 3.75 END WHEN {_UPPER_IN} AND {_DIGIT_IN} THEN CASE WHEN {_LONG} THEN 3.6 ELSE 3.75 END WHEN {_LOWER_IN} AND {_DIGIT_IN} THEN 3.9 WHEN {_LOWER_IN} AND {_UPPER_IN} THEN CASE WHEN {_LONG} THEN 4.1 END END"""
_WIDE = f"least({secrets.WINDOW}, length(body))"
_HIGH = f"list_filter(range(0, length(body) - {_WIDE} + 1), lambda k: list_entropy(string_split(substr(body, k + 1, {_WIDE}), '')) >= lim AND NOT regexp_matches(substr(' ' || body || ' ', k + 1, {_WIDE} + 2), {_quoted(secrets.EXAMPLES)}) AND NOT regexp_matches(substr(body, k + 1, {_WIDE}), {_quoted(secrets.STRETCHES)}))"
_LINE = "string_agg(['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || \"start\" || ':' || \"end\", ',' ORDER BY \"start\", kind)"
OP2 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 base AS (SELECT * FROM {_spans(secrets.ASSIGN, 0, f"length(regexp_extract(body, {_quoted(secrets.ASSIGN)}, 2)) >= 12")} UNION ALL SELECT * FROM {_spans(secrets.ACCESS, 1, 'length(body) >= 18')} UNION ALL SELECT * FROM {_spans(secrets.HEX, 2, 'true')}),
 cand AS (SELECT *, {_KIND} AS lim FROM {_spans(secrets.CANDIDATE, 3, f"NOT regexp_matches(body, {_quoted(secrets.UUID)})")}),
 high AS (SELECT doc_id, "start", kind, least({secrets.WINDOW}, length(body)) AS wide, {_HIGH} AS h FROM cand WHERE lim IS NOT NULL),
 added AS (SELECT doc_id, "start" + h[1] AS "start", kind, "start" + h[-1] + wide AS "end" FROM high WHERE len(h) > 0),
 fresh AS (SELECT a.* FROM added AS a WHERE NOT EXISTS (SELECT 1 FROM base AS b WHERE b.doc_id = a.doc_id AND b."start" < a."end" AND a."start" < b."end")),
 sums AS (SELECT doc_id, count_if(kind = 0) AS a, count_if(kind = 1) AS c, count_if(kind = 2) AS h, {_LINE} AS line FROM base GROUP BY 1),
 lines AS (SELECT doc_id, {_LINE} AS line FROM (SELECT doc_id, "start", kind, "end" FROM base UNION ALL SELECT * FROM fresh) GROUP BY 1)
 SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(sums.line, '')) AS base_sha256, coalesce(lines.line, '') AS spans FROM d LEFT JOIN sums ON d.doc_id = sums.doc_id LEFT JOIN lines ON d.doc_id = lines.doc_id"""


def _components(nodes: str, links: str) -> str:
    """CTEs reach (n, m) and comp (n, c): smallest node reachable."""
    return f"both_ways AS (SELECT a AS n, b AS m FROM {links} UNION SELECT b, a FROM {links}), reach(n, m) AS (SELECT id, id FROM {nodes} UNION SELECT r.n, e.m FROM reach AS r JOIN both_ways AS e ON r.m = e.n), comp AS (SELECT n, min(m) AS c FROM reach GROUP BY 1)"


OP5 = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
 ok AS (SELECT * FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
 links AS (SELECT a.id AS a, b.id AS b FROM ok AS a JOIN ok AS b ON a.id < b.id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
 {_components('v', 'links')}
 SELECT id AS vec_id, (SELECT count(*) FROM both_ways AS e WHERE e.n = id) AS n_links, c AS component_id, c = id AS kept FROM v JOIN comp ON n = id"""

OP10 = rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 sh AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
 sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
 inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh AS a JOIN sh AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 links AS MATERIALIZED (SELECT a, b FROM inter JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
 nodes AS (SELECT doc_id AS id FROM documents), {_components('nodes', 'links')}
 SELECT doc_id, coalesce(sizes.n, 0) AS n_shingles, c AS component_id, c = doc_id AS kept FROM (SELECT doc_id FROM documents) LEFT JOIN sizes USING (doc_id) JOIN comp ON comp.n = doc_id"""
