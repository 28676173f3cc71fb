"""DuckDB SQL for the queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

_LINES = """
), totals AS (
  SELECT site, count(*) AS pages FROM l GROUP BY site
), counts AS (
  SELECT site, line, count(*) AS n
  FROM (SELECT site, unnest(list_distinct(list_filter(lines, lambda x: trim(x, ' ') <> ''))) AS line FROM l)
  GROUP BY site, line HAVING count(*) >= 3
), boiler AS (
  SELECT site, list(line) AS drops FROM counts JOIN totals USING (site) WHERE n > RATIO::DOUBLE * pages GROUP BY site
), kept AS (
  SELECT ID, text, lines, CASE WHEN drops IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(drops, x)) END AS k
  FROM l LEFT JOIN boiler USING (site)
)
SELECT ID,
       CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(k, chr(10)), '') END AS text,
       coalesce(len(lines), 0)::BIGINT AS n_lines,
       (coalesce(len(lines), 0) - coalesce(len(k), 0))::BIGINT AS n_dropped
FROM kept
"""

_LINE_DEDUP = """
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, text, string_split(text, chr(10)) AS lines FROM documents
""" + _LINES.replace("RATIO", "0.01").replace("ID", "doc_id")

_PAGE_BOILERPLATE = r"""
WITH l AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS site, text, string_split(text, chr(10)) AS lines
  FROM (SELECT page_id, url, regexp_replace(html, '<[^>]*>', chr(10), 'g') AS text FROM pages)
""" + _LINES.replace("RATIO", "0.05").replace("ID", "page_id")


_TEMPERED = "floor(sqrt(sum(tokens)::DOUBLE))::BIGINT"


def _level(nodes: str, parent: str, path: str, name: str, source: str, weight: str = _TEMPERED) -> str:
    """CTEs that deal the budget of each ``parent`` in ``source`` out to its children."""
    return f"""
{nodes}_n AS (
  SELECT {path}, sum(tokens) AS tokens, sum(tokens) * 4 AS cap, {weight} AS weight
  FROM leaves GROUP BY {path}
), {nodes}_o AS (
  SELECT n.*, s.budget, {name} AS name, cap::DOUBLE / weight::DOUBLE AS ratio FROM {nodes}_n n JOIN {source} s USING ({parent})
), {nodes}_c AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY ratio, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS room,
         (sum(weight) OVER (PARTITION BY {parent} ORDER BY ratio, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS weight_from
  FROM {nodes}_o
), {nodes}_f AS (
  SELECT *, min(CASE WHEN cap::DOUBLE * weight_from <= weight::DOUBLE * room THEN 1 ELSE 0 END)
         OVER (PARTITION BY {parent} ORDER BY ratio, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sated
  FROM {nodes}_c
), {nodes}_r AS (
  SELECT *, budget::DOUBLE - coalesce(sum(CASE WHEN sated = 1 THEN cap END) OVER (PARTITION BY {parent}), 0)::DOUBLE AS rest,
         (sum(CASE WHEN sated = 0 THEN weight END) OVER (PARTITION BY {parent}))::DOUBLE AS weights
  FROM {nodes}_f
), {nodes}_g AS (
  SELECT *, (CASE WHEN sated = 1 THEN cap WHEN weights > 0 THEN least(cap, floor(weight::DOUBLE * rest / weights)) ELSE 0 END)::BIGINT AS got
  FROM {nodes}_r
), {nodes}_l AS (
  SELECT *, budget - sum(got) OVER (PARTITION BY {parent}) AS over,
         sum(CASE WHEN sated = 0 AND weight > 0 AND got < cap THEN 1 ELSE 0 END) OVER (PARTITION BY {parent} ORDER BY name ROWS UNBOUNDED PRECEDING) AS rank
  FROM {nodes}_g
), {nodes} AS (
  SELECT {path}, tokens, (got + CASE WHEN sated = 0 AND weight > 0 AND got < cap AND rank <= over THEN 1 ELSE 0 END)::BIGINT AS budget
  FROM {nodes}_l
)"""


_MIXING = """
WITH d AS (
  SELECT doc_id,
         CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7') THEN 'web'
              WHEN source IN ('src8', 'src9', 'src10', 'src11') THEN 'books'
              WHEN source IN ('src12', 'src13', 'src14', 'src15') THEN 'news'
              WHEN source IN ('src16', 'src17', 'src18', 'src19') THEN 'code' ELSE 'other' END AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')), 0)::BIGINT AS tokens
  FROM documents
), units AS (
  SELECT doc_id, domain, lang, source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL
), leaves AS (
  SELECT 0 AS root, domain, lang, source, sum(tokens)::BIGINT AS tokens FROM units GROUP BY ALL HAVING sum(tokens) > 0
), top AS (
  SELECT 0 AS root, sum(tokens)::BIGINT AS budget FROM leaves
), {domains}, {langs}, {sources}, placed AS (
  SELECT u.doc_id, u.domain, u.lang, u.source, u.tokens, p.budget, p.budget // p.tokens AS epoch, p.budget % p.tokens AS rest,
         md5('17:' || (p.budget // p.tokens)::VARCHAR || ':' || coalesce(u.doc_id::VARCHAR, '')) AS key
  FROM units u LEFT JOIN sources p USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, tokens, coalesce(budget, 0)::BIGINT AS budget,
       (coalesce(epoch, 0) + CASE WHEN sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END)::INT AS copies
FROM placed
""".format(
    domains=_level("domains", "root", "root, domain", "domain", "top", f"CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 2 WHEN 'news' THEN 2 WHEN 'code' THEN 1 WHEN 'other' THEN 1 ELSE {_TEMPERED} END"),
    langs=_level("langs", "domain", "domain, lang", "lang", "domains", f"CASE lang WHEN 'en' THEN 6 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 WHEN 'es' THEN 2 WHEN '' THEN 1 ELSE {_TEMPERED} END"),
    sources=_level("sources", "domain, lang", "domain, lang, source", "source", "langs"),
)

_DECONTAMINATION = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT item_id, w, len(w) AS n
  FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL)
  WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, least(n, 10) AS n, array_to_string(w[i:i + least(n, 10) - 1], ' ') AS run FROM (SELECT *, unnest(range(1, greatest(n - 9, 1) + 1)) AS i FROM b)
), hits AS (
  SELECT r, i, x.n, item_id
  FROM (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS run
        FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows))) x JOIN windows v ON v.n = x.n AND v.run = x.run
), words AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r
), items AS (
  SELECT r, list(item_id::VARCHAR ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": _DECONTAMINATION,
    "op1_line_dedup": _LINE_DEDUP,
    "op1_page_boilerplate": _PAGE_BOILERPLATE,
    "op9_mixing": _MIXING,
}
