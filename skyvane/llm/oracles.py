"""SQL that gives the rows of those queries that SQL can express on small tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DEDUP = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                    '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
                      WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                      ELSE list_distinct(list_transform(
                        range(1, len(words) - 3),
                        lambda k: array_to_string(words[k : k + 4], ' '))) END AS shingles
  FROM worded
),
members AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS one, b.doc_id AS other
  FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
reached AS (
  SELECT doc_id AS one, doc_id AS other FROM sets
  UNION
  SELECT r.one, l.other FROM reached r JOIN links l ON r.other = l.one
),
grouped AS (SELECT one AS doc_id, min(other) AS component_id FROM reached GROUP BY one)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, g.component_id,
       s.doc_id = g.component_id AS kept
FROM sets s JOIN grouped g ON s.doc_id = g.doc_id
"""

# The given pages link to no other host, so trust and distrust stay where they start.
URL_FILTER = f"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
),
placed AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')
           AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
),
rules(action, top, start) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
         ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
),
judged AS (
  SELECT p.page_id, p.host, p.path, max_by(r.top || r.start, length(r.top || r.start)) AS rule,
         max_by(r.action, length(r.top || r.start)) AS action
  FROM placed p LEFT JOIN rules r
    ON (p.host = r.top OR ends_with(p.host, '.' || r.top)) AND starts_with(p.path, r.start)
  GROUP BY p.page_id, p.host, p.path
),
hosts AS (
  SELECT host, avg(CASE WHEN action = 'allow' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS trust,
         avg(CASE WHEN action = 'block' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS distrust
  FROM judged GROUP BY host
)
SELECT page_id, j.host, path, rule,
       coalesce(action, CASE WHEN distrust >= 0.5 AND distrust > trust THEN 'block'
                             ELSE 'allow' END) AS verdict,
       trust, distrust
FROM judged j JOIN hosts h ON j.host = h.host
"""

# A digit of base 32 is five bits of two neighbouring digits of base 16.
WARC = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
),
newest AS (SELECT hex, max(page_id) AS newest FROM payloads GROUP BY hex)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr(
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((strpos('0123456789abcdef', substr(hex, CAST(5 * k // 4 AS BIGINT) + 1, 1)) - 1) * 16
           + strpos('0123456789abcdef', substr(hex || '0', CAST(5 * k // 4 AS BIGINT) + 2, 1)) - 1)
          >> (3 - 5 * k % 4)) % 32 + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM payloads JOIN newest USING (hex)
"""

ORACLES: dict[str, str] = {
    "op1_near_dedup": NEAR_DEDUP,
    "op8_url_filter": URL_FILTER,
    "op9_warc": WARC,
}
