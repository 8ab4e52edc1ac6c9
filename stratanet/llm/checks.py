"""SQL that the queries on words, hosts and ranks must equal."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: One step of the reflected CRC-32 for each byte, with the table made by its polynomial.
SPELLING_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents) GROUP BY 1, 2),
bytes AS (SELECT w, c, flatten(list_transform(string_split(doc_id || ':' || w, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS b FROM runs),
sums AS (SELECT w, c, xor(4294967295, list_reduce(list_prepend(4294967295, b),
    lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1]))) AS h FROM bytes, crc),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM sums),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.d = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.d = b.word),
best AS (SELECT word, n, other, m, count(*) OVER (PARTITION BY word) AS n_near,
  row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS r FROM near),
f AS (SELECT word, n, n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM best WHERE r = 1),
walk AS (SELECT word, form AS tip FROM f WHERE form IS NOT NULL
  UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.tip WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, tip FROM walk JOIN f ON f.word = walk.tip WHERE f.form IS NULL)
SELECT words.word, form, coalesce(tip, words.word) AS root, words.n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN f USING (word) LEFT JOIN ends USING (word)"""

TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH_SQL = rf"""
WITH d AS (SELECT doc_id, {TERMS_SQL} AS ts FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS terms FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest({TERMS_SQL}) AS term FROM benchmark),
t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM t GROUP BY 1), s),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN w USING (term), s GROUP BY 1, 2),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""


def trust_sql(rules: list[tuple[str, str]], rounds: int) -> str:
    """Rules and propagation; each round is a table of its own."""
    values = ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in rules)
    keep, pass_on = "1 - 0.85::DOUBLE", "0.85::DOUBLE * CAST(r.mass AS DOUBLE) * share"
    steps = "".join(
        f"""
r{k + 1} AS MATERIALIZED (SELECT kind, host, CAST(sum(mass) AS BIGINT) AS mass FROM (
  SELECT kind, host, CAST(floor(({keep}) * CAST(mass AS DOUBLE)) AS BIGINT) AS mass FROM r0
  UNION ALL SELECT s.kind, target, CAST(floor({pass_on}) AS BIGINT) FROM r{k} r JOIN shares s ON r.kind = s.kind AND r.host = s.source) GROUP BY 1, 2),"""
        for k in range(rounds)
    )
    return rf"""
WITH rules AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rule_host, substr(rule, instr(rule, '/')) AS rule_path FROM (VALUES {values}) AS v(rule, verdict)),
p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, coalesce(html, '') AS html FROM pages),
b AS (SELECT p.page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS rule_verdict FROM p JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1),
ruled AS MATERIALIZED (SELECT p.page_id, host, path, rule, rule_verdict FROM p LEFT JOIN b USING (page_id)),
link AS (SELECT host, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?\s*([^"''\s>]+)', 1)) AS u FROM p WHERE host <> ''),
edge AS MATERIALIZED (SELECT source, target, count(*) AS n FROM (SELECT host AS source,
  CASE WHEN regexp_matches(u, '^([A-Za-z][A-Za-z0-9+.-]*:)?//') THEN nullif(translate(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '')
    WHEN regexp_matches(u, '^(#|[A-Za-z][A-Za-z0-9+.-]*:)') THEN NULL ELSE host END AS target FROM link) WHERE target IS NOT NULL GROUP BY 1, 2),
both_ways AS (SELECT 'trust' AS kind, source, target, n FROM edge UNION ALL SELECT 'distrust', target, source, n FROM edge),
shares AS MATERIALIZED (SELECT kind, source, target, n::DOUBLE / (sum(n) OVER (PARTITION BY kind, source))::DOUBLE AS share FROM both_ways),
seed AS (SELECT CASE rule_verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM ruled WHERE rule_verdict IS NOT NULL AND host <> '' GROUP BY 1, 2),
r0 AS MATERIALIZED (SELECT kind, host, CAST(floor(1099511627776::DOUBLE * n::DOUBLE / (SELECT sum(n) FROM seed)::DOUBLE) AS BIGINT) AS mass FROM seed),{steps}
m AS (SELECT host, CAST(coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS BIGINT) AS trust, CAST(coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS BIGINT) AS distrust FROM r{rounds} GROUP BY 1),
j AS (SELECT page_id, host, path, rule, rule_verdict, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM ruled LEFT JOIN m USING (host))
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN 100 * distrust > 50 * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict, trust, distrust FROM j"""
