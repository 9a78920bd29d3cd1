"""SQL that checks the registered queries where SQL can express them."""

from __future__ import annotations

_HOST = "translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Five hex digits are four base-32 digits.
_FIVE = "CAST('0x' || substr(hex, CAST(5 * i + 1 AS INT), 5) AS INT)"
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_FIVE} >> {bits}) & 31) + 1, 1)" for bits in (15, 10, 5, 0)
)

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

CHECKS = {
    "op11_lexical_search": f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, t, CAST(len(t) AS BIGINT) AS n
  FROM (SELECT doc_id, {_TERMS} AS t FROM documents) WHERE len(t) > 0),
stats AS (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM docs),
held AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM docs) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * all_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), stats),
asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(t) AS term FROM (SELECT item_id, {_TERMS} AS t FROM benchmark)) GROUP BY ALL),
scored AS (
  SELECT a.item_id, h.r, h.doc_id, CAST(sum(a.times * w.w * ((1000000000 * h.tf)
           // (1000 * h.tf + 8 * (25 + (75 * h.n * s.all_docs) // s.all_terms)))) AS BIGINT) AS score
  FROM asked a JOIN held h USING (term) JOIN weights w USING (term), stats s GROUP BY a.item_id, h.r, h.doc_id)
SELECT item_id, CAST(place AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
WHERE place <= 10
""",
    "op12_hard_negatives": """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT * FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INT) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
""",
    "op8_url_filter": f"""
WITH split AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0
                       THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT p.page_id, r.*, row_number() OVER (
           PARTITION BY p.page_id ORDER BY length(rule_host) + length(rule_path) DESC) AS place
  FROM parts p JOIN rules r ON (p.host = rule_host OR p.host LIKE '%.' || rule_host)
                           AND starts_with(p.path, rule_path))
SELECT p.page_id, p.host, p.path, f.rule_host || f.rule_path AS rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.place = 1
""",
    "op5_warc": f"""
WITH copies AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda i: {_BASE32}), '') AS payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to
FROM copies
""",
}
