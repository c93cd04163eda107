"""DuckDB twins for ingest and statement queries (feed adapter, A1–A3, H5/H6, B16, C3, C4)."""

from __future__ import annotations

from .oracles import ART, NOW, with_

FEED = r"""pg AS (
  SELECT p.page_id, p.url, p.html, d.doc_id AS _doc, d.source AS _dsrc
  FROM pages p LEFT JOIN documents d ON p.page_id = d.doc_id),
fbase AS (
  SELECT page_id, 2 * page_id AS seq,
         CASE WHEN page_id % 13 = 0 THEN NULL
              WHEN page_id % 9 = 0 AND _doc IS NOT NULL THEN 'https://' || _dsrc || '.example/a/' || CAST(_doc AS VARCHAR)
              ELSE url END AS link,
         CASE WHEN page_id % 11 = 0 THEN '' ELSE regexp_extract(html, '<title>(.*?)</title>', 1) END AS title,
         CASE WHEN page_id % 3 = 0 THEN NULL ELSE html END AS content,
         url AS description,
         CASE WHEN page_id % 7 = 0 THEN NULL ELSE regexp_extract(url, '://([^/]+)', 1) END AS source_id,
         CASE page_id % 8 WHEN 0 THEN timezone('UTC', timezone('Europe/Kyiv', loc))
                          WHEN 1 THEN loc
                          WHEN 2 THEN loc - INTERVAL 2 HOUR
                          WHEN 3 THEN CASE page_id % 24 WHEN 3 THEN __NOW__ ELSE timezone('UTC', timezone('Europe/Kyiv', loc)) END
                          WHEN 4 THEN CASE WHEN page_id % 24 <> 20 THEN timezone('UTC', timezone('Europe/Kyiv', date_trunc('day', loc)))
                                           WHEN day(loc) > 12 OR day(loc) = month(loc) THEN loc
                                           ELSE make_timestamp(year(loc), day(loc), month(loc), hour(loc), minute(loc), 0) END
                          WHEN 5 THEN loc - INTERVAL 2 HOUR
                          WHEN 6 THEN loc + INTERVAL 250 MILLISECOND
                          ELSE loc + INTERVAL 210 MINUTE END AS published_date
  FROM (SELECT *, timestamp '2024-01-01 00:00:00' + to_minutes(CAST(page_id * 37 % 50400 AS BIGINT)) AS loc FROM pg)),
feed AS (
  SELECT seq, link, title, content, description, source_id, published_date FROM fbase
  UNION ALL
  SELECT seq + 1, link, '[update] ' || title, content, description, source_id, published_date FROM fbase WHERE page_id % 5 = 0),
norm AS (
  SELECT seq, link AS url, substring(title, 1, 500) AS title,
         coalesce(CASE WHEN length(content) > 0 THEN content END, description) AS content,
         coalesce(source_id, 'unknown') AS source,
         published_date
  FROM feed WHERE coalesce(length(title), 0) > 0 AND coalesce(length(link), 0) > 0)""".replace("__NOW__", NOW)

STMTS = r"""stm AS (
  SELECT conv_id, conv_id % (SELECT count(*) FROM documents) AS article_id,
         CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1
              + CASE WHEN conv_id % 10 = 9 THEN 1 ELSE 0 END AS INTEGER) AS item_pos,
         role AS actor, text AS action, '' AS reason, '' AS consequence, text AS full_statement,
         0.1 * (turn + 3) AS confidence, turn
  FROM conversations),
stmts AS (
  SELECT *, md5(CAST(conv_id AS VARCHAR) || ':' || CAST(item_pos AS VARCHAR)) AS id
  FROM stm
  WHERE (conv_id % 10 IN (0, 1, 9) OR (conv_id % 10 IN (5, 8) AND turn % 2 = 0))
    AND coalesce(length(actor), 0) > 0 AND coalesce(length(action), 0) > 0)"""


def ingest_queries() -> dict[str, str]:
    q = {}
    q["feed_normalise"] = with_(FEED) + """
SELECT seq, url, title, md5(coalesce(content, '')) AS content_md5, source, published_date FROM norm"""
    q["ingest_dedup"] = with_(ART, FEED) + """
SELECT seq, url, title, source, published_date FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS rn FROM norm) f
WHERE rn = 1 AND url NOT IN (SELECT url FROM art)"""
    q["statements_parse"] = with_(STMTS) + """
SELECT conv_id, article_id, item_pos, actor, action, reason, consequence, full_statement,
       round(CAST(confidence AS DOUBLE), 6) AS confidence FROM stmts"""
    q["statements_denorm"] = with_(ART, STMTS) + """
SELECT s.id AS statement_id, s.article_id, s.actor, round(CAST(s.confidence AS DOUBLE), 6) AS confidence,
       a.title AS article_title, a.source AS article_source
FROM stmts s JOIN art a ON a.id = s.article_id"""
    q["articles_unextracted"] = with_(ART, STMTS) + """
SELECT id, published_date FROM art WHERE id NOT IN (SELECT article_id FROM stmts)"""
    q["name_validate"] = with_(ART) + r""",
rw AS (SELECT id, CASE id % 3 WHEN 0 THEN '"' || title || '"'
                              WHEN 1 THEN '  ' || substring(title, 1, 40) || ' ' || chr(10)
                              ELSE title END AS raw FROM art),
cl AS (SELECT id, raw, replace(replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '"', ''), '''', '') AS cleaned FROM rw),
ck AS (SELECT id, raw, cleaned,
              len(list_filter(regexp_split_to_array(trim(cleaned), '\s+'), lambda w: w <> '')) <= 6
              AND length(cleaned) <= 50 AS ok FROM cl)
SELECT id, CASE WHEN raw IS NOT NULL AND ok THEN cleaned ELSE 'News Cluster ' || CAST(id AS VARCHAR) END AS name,
       ok AS accepted FROM ck"""
    return q
