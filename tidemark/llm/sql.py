"""DuckDB SQL that gives the rows of the corpus queries, where SQL can express them."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]+"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_VALUE = r"""(?is)[\s"''/]{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""


def _attribute(name: str) -> str:
    return "(" + " || ".join(f"regexp_extract(tag, '{_VALUE.replace('{name}', name)}', {g})" for g in (1, 2, 3)) + ")"


def _node(url: str) -> str:
    head = f"regexp_extract({url}, '^[^:/?#]+://[^/?#]*')"
    return f"translate({head}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(split_part({url}, '#', 1), length({head}) + 1)"


# but for . and .. segments of paths, which urls of the tables and the tests of this SQL don't have
URL_FILTER = rf"""
WITH RECURSIVE tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
refs AS (SELECT url, {_attribute("href")} AS ref FROM tags WHERE regexp_matches(tag, '(?i)^<link') AND regexp_matches({_attribute("rel")}, '(?i)(^|\s)canonical(\s|$)')
         UNION ALL SELECT url, regexp_extract({_attribute("content")}, '(?i)\burl\s*=\s*[''"]?\s*([^''"\s]+)', 1) FROM tags
         WHERE regexp_matches(tag, '(?i)^<meta') AND regexp_matches({_attribute("http-equiv")}, '(?i)^\s*refresh\s*$') AND regexp_matches({_attribute("content")}, '(?i)\burl\s*=\s*[''"]?\s*[^''"\s]')),
plain AS (SELECT url, split_part(trim(replace(replace(replace(ref, '&amp;', '&'), '&#38;', '&'), '&#x26;', '&')), '#', 1) AS ref, split_part(url, '#', 1) AS bare, regexp_extract(url, '^[^:/?#]+://[^/?#]*') AS root,
          regexp_extract(url, '^([^:/?#]+)://', 1) AS scheme, regexp_extract(split_part(url, '#', 1), '^[^:/?#]+://[^/?#]*([^?]*)', 1) AS path FROM refs),
goes AS (SELECT url, CASE WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN CASE WHEN contains(ref, '://') THEN ref END WHEN root = '' THEN NULL WHEN ref = '' THEN bare WHEN starts_with(ref, '//') THEN scheme || ':' || ref
         WHEN starts_with(ref, '/') THEN root || ref WHEN starts_with(ref, '?') THEN root || path || ref ELSE root || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || ref END AS target FROM plain),
e AS MATERIALIZED (SELECT DISTINCT {_node("url")} AS a, {_node("target")} AS b FROM goes WHERE target IS NOT NULL),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(node, c) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT both_ways.b, reach.c FROM reach JOIN both_ways ON both_ways.a = reach.node WHERE reach.c < both_ways.b),
classes AS MATERIALIZED (SELECT node, min(c) AS c FROM reach GROUP BY node),
u AS (SELECT url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM (SELECT url FROM pages UNION SELECT node FROM classes)),
p AS MATERIALIZED (SELECT url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
h AS MATERIALIZED (SELECT url, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
      FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY url),
passed AS (SELECT c, min(verdict) AS verdict FROM classes JOIN h ON h.url = classes.node GROUP BY c)
SELECT pages.page_id, p.host, p.path, h.rule, coalesce(h.verdict, passed.verdict, 'allow') AS verdict
FROM pages JOIN p ON p.url IS NOT DISTINCT FROM pages.url LEFT JOIN h ON h.url = pages.url LEFT JOIN classes ON classes.node = {_node("pages.url")} LEFT JOIN passed USING (c)
"""

SOURCE_MIX = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
l AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
k AS (SELECT d.*, CASE WHEN q >= 1 THEN 2.0 WHEN q < 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS w, md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':17') AS h FROM d LEFT JOIN l USING (doc_id)),
r AS (SELECT *, 1.0::DOUBLE - pow((CAST('0x' || substr(h, 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE, 1.0::DOUBLE / w) AS rank, substr(h, 14, 13) AS tie FROM k),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n),
t AS (SELECT source, source_size, least(cap, coalesce(w * (SELECT arg_min(level, cap / w) FROM f WHERE level * w <= cap), cap)) AS target FROM f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS epochs FROM t),
c AS (SELECT *, greatest(0, target - epochs * source_size) AS budget FROM b),
o AS (SELECT r.doc_id, r.size, r.rank, r.tie, c.*, sum(r.size) OVER (PARTITION BY c.source ORDER BY r.rank, r.tie, r.size ROWS UNBOUNDED PRECEDING) AS upto
      FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source),
g AS (SELECT *, budget - coalesce(max(CASE WHEN upto <= budget THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM o),
e AS (SELECT *, upto > budget AND abs(size - gap) < gap AND row_number() OVER (PARTITION BY source, upto > budget AND abs(size - gap) < gap ORDER BY abs(size - gap), rank, tie, size) = 1 AS top_up FROM g)
SELECT doc_id, size, source_size, target, CAST(size * CASE WHEN size = 0 THEN 0 ELSE epochs + CASE WHEN budget > 0 AND (upto <= budget OR top_up) THEN 1 ELSE 0 END END AS BIGINT) AS taken FROM e
"""

NGRAM_JOIN = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS s
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
both_ways AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT both_ways.y, reach.c FROM reach JOIN both_ways ON both_ways.x = reach.doc_id WHERE reach.c < both_ways.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id) r USING (doc_id)
"""

EMBEDDING_DEDUP = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) >= 0.95 * a.n * b.n),
reach(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.y, reach.c FROM reach JOIN e ON e.x = reach.vec_id WHERE reach.c < e.y),
m AS (SELECT vec_id, min(c) AS c FROM reach GROUP BY vec_id), k AS (SELECT x, count(*) AS n FROM e GROUP BY x)
SELECT v.vec_id, coalesce(k.n, 0) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept FROM v JOIN m USING (vec_id) LEFT JOIN k ON k.x = v.vec_id
"""

WARC_ROUND_TRIP = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + CAST((CAST('0x' || substr(x, 1 + 5 * CAST(floor(i / 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest FROM s),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM m
"""



def quality_rules(rules: int = 7, rounds: int = 100) -> str:
    """The counts and votes of the quality rules, and their expectation-maximisation as a recursive query over vote patterns."""
    j = range(rules)
    log_odds = "ln(prior / (1 - prior)) + " + " + ".join(f"CASE v{i} WHEN 1 THEN ln(s{i} / (1 - t{i})) WHEN -1 THEN ln((1 - s{i}) / t{i}) ELSE 0 END" for i in j)
    start = ", ".join(f"0.98::DOUBLE AS s{i}, 0.3::DOUBLE AS t{i}" for i in j)
    step = ", ".join(
        f"greatest(0.9, least(0.995, (1.96 + sum(CASE WHEN v{i} = 1 THEN p * n ELSE 0 END)) / (2.0 + sum(CASE WHEN v{i} <> 0 THEN p * n ELSE 0 END))))::DOUBLE AS s{i}, "
        f"greatest(0.05, least(0.95, (0.6 + sum(CASE WHEN v{i} = -1 THEN (1 - p) * n ELSE 0 END)) / (2.0 + sum(CASE WHEN v{i} <> 0 THEN (1 - p) * n ELSE 0 END))))::DOUBLE AS t{i}"
        for i in j
    )
    v = ", ".join(f"v{i}" for i in j)
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
             list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS tri FROM w),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS upper,
             len(list_filter(ws, lambda x: regexp_matches(x, '^[("'']?[\p{{L}}\p{{M}}\p{{N}}]+(?:[''’.,:‌‍-][\p{{L}}\p{{M}}\p{{N}}]+)*[.,;:!?।)"''%]?$'))) AS plain, tri FROM l),
u AS (SELECT doc_id, unnest(tri) AS g, unnest(range(len(tri))) AS i FROM f),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS twins FROM u) CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) WHERE twins > 1 GROUP BY doc_id),
x AS MATERIALIZED (SELECT f.*, coalesce(c.n, 0) AS n_repeat_words, greatest(n_words, 1)::DOUBLE AS n FROM f LEFT JOIN c USING (doc_id)),
votes AS MATERIALIZED (SELECT *,
  CASE WHEN n_words < 20 THEN -1 WHEN n_words >= 80 THEN 1 ELSE 0 END AS v0,
  CASE WHEN word_chars / n < 2.5 OR word_chars / n > 12 THEN -1 WHEN word_chars / n BETWEEN 3.5 AND 7 THEN 1 ELSE 0 END AS v1,
  CASE WHEN n_symbols / n > 0.2 THEN -1 WHEN n_symbols / n <= 0.02 THEN 1 ELSE 0 END AS v2,
  CASE WHEN plain / n < 0.6 THEN -1 WHEN plain / n >= 0.75 THEN 1 ELSE 0 END AS v3,
  CASE WHEN n_dup_lines / greatest(n_lines, 1)::DOUBLE > 0.4 THEN -1 WHEN n_dup_lines / greatest(n_lines, 1)::DOUBLE <= 0.05 THEN 1 ELSE 0 END AS v4,
  CASE WHEN n_repeat_words / n > 0.4 THEN -1 WHEN n_repeat_words / n <= 0.1 THEN 1 ELSE 0 END AS v5,
  CASE WHEN upper / greatest(word_chars, 1)::DOUBLE > 0.35 THEN -1 WHEN upper / greatest(word_chars, 1)::DOUBLE <= 0.08 THEN 1 ELSE 0 END AS v6 FROM x),
patterns AS MATERIALIZED (SELECT {v}, count(*) AS n FROM votes GROUP BY ALL),
em AS (SELECT 0 AS k, 0.9::DOUBLE AS prior, {start}
  UNION ALL
  SELECT k + 1, greatest(0.5, least(0.98, sum(p * n) / sum(n)))::DOUBLE AS prior, {step}
  FROM (SELECT em.k, patterns.*, 1 / (1 + exp(-({log_odds}))) AS p FROM em CROSS JOIN patterns) WHERE k < {rounds} GROUP BY k),
judged AS (SELECT votes.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 1 / (1 + exp(-({log_odds}))) AS posterior FROM votes CROSS JOIN (SELECT * FROM em WHERE k = {rounds}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND posterior >= 0.5 AS kept, round(posterior, 6) AS posterior FROM judged
"""


ORACLES = {
    "op3_url_filter": URL_FILTER,
    "op5_source_mix": SOURCE_MIX,
    "op7_quality_rules": quality_rules(),
    "op8_ngram_join": NGRAM_JOIN,
    "op9_embedding_dedup": EMBEDDING_DEDUP,
    "op10_warc_round_trip": WARC_ROUND_TRIP,
}
