"""DuckDB twins for the store tables of the weekly run and the listing/report queries."""

from __future__ import annotations

from .operators import responders as rsp
from .oracles import (NEAR_DUP, NOW, PAIRS, WEEKLY_BASE, WEEK_STATS, compress_ctes, gate_cte,
                      with_)

ID = "md5({x})"
NUM = "CAST(('0x' || substr(id, 1, 15)) AS BIGINT)"


def _id(expr: str) -> str:
    return ID.format(x=expr)


STORE = f"""compr AS (
  SELECT g.week, g.label, length(coalesce(ks.s_sp, '')) / length(c.combined) AS compression_ratio
  FROM gkey g JOIN comb c ON c.gid = g.gid LEFT JOIN ksj ks ON ks.gid = g.gid),
acc AS (
  SELECT g.*, n.near_dup_rate, g.coherence * g.diversity AS significance,
         {NOW} - to_days(CAST(7 * (g.week + 1) AS INTEGER)) AS week_start, cp.compression_ratio,
         'News Cluster ' || g.label AS name
  FROM gated g LEFT JOIN nd n ON g.week = n.week AND g.label = n.label
  LEFT JOIN compr cp ON cp.week = g.week AND cp.label = g.label
  WHERE g.reject_reason IS NULL),
nrows AS (
  SELECT name, printf('Weekly narrative with %d articles from %d sources. Compression: %.1f%%',
                      n_rows, n_sources, compression_ratio * 100) AS description,
         week AS seq, week_start AS created_at, diversity AS source_diversity_score,
         CAST(n_rows AS INTEGER) AS support_count, CAST(n_sources AS INTEGER) AS unique_sources_count,
         coherence AS coherence_score, coalesce(near_dup_rate, 0) AS near_duplicate_rate,
         CAST(n_days AS INTEGER) AS persistence_days
  FROM acc),
nagg AS (
  SELECT name, arg_min(description, seq) AS description, arg_min(created_at, seq) AS created_at,
         arg_max(source_diversity_score, seq) AS source_diversity_score, arg_max(support_count, seq) AS support_count,
         arg_max(unique_sources_count, seq) AS unique_sources_count, arg_max(coherence_score, seq) AS coherence_score,
         arg_max(near_duplicate_rate, seq) AS near_duplicate_rate, arg_max(persistence_days, seq) AS persistence_days
  FROM nrows GROUP BY name),
narr AS (
  SELECT {_id('name')} AS id, name, description, created_at, source_diversity_score, support_count,
         unique_sources_count, coherence_score, near_duplicate_rate, persistence_days
  FROM nagg),
narr2 AS (
  SELECT id, name, description, created_at, {NUM} % 5 <> 0 AS is_active, source_diversity_score,
         CAST(CASE WHEN {NUM} % 7 = 0 THEN 0 ELSE support_count END AS INTEGER) AS support_count,
         unique_sources_count, coherence_score, near_duplicate_rate, persistence_days
  FROM narr),
clus AS (
  SELECT {_id("name || '|' || CAST(week AS VARCHAR)")} AS id, {_id('name')} AS narrative_id,
         CAST(week_start AS DATE) AS cluster_date, week_start AS created_at, week, label
  FROM acc),
clart AS (SELECT c.id AS cluster_id, m.id AS article_id FROM mem m JOIN clus c ON c.week = m.week AND c.label = m.label),
events AS (
  SELECT {_id("'emergence|' || name || '|' || CAST(week AS VARCHAR)")} AS id, {_id('name')} AS narrative_id,
         'emergence' AS event_type,
         printf('Weekly narrative: %d articles, coherence %.3f', n_rows, coherence) AS description,
         week_start AS event_date, significance AS significance_score
  FROM acc),
tl AS (
  SELECT e.id AS event_id, e.narrative_id, n.name AS narrative_name, e.event_type, e.description, e.event_date,
         e.significance_score, CAST(0 AS BIGINT) AS n_related
  FROM events e JOIN narr2 n ON e.narrative_id = n.id WHERE n.support_count > 0)"""


def _base() -> str:
    return with_(*WEEKLY_BASE, gate_cte(), PAIRS, NEAR_DUP) + compress_ctes() + ",\n" + STORE


def store_queries() -> dict[str, str]:
    b = _base()
    q = {}
    q["narrative_upsert"] = b + """
SELECT id, name, description, created_at, is_active, round(source_diversity_score, 6) AS source_diversity_score,
       support_count, unique_sources_count, round(coherence_score, 6) AS coherence_score,
       round(near_duplicate_rate, 6) AS near_duplicate_rate, persistence_days
FROM narr2"""
    q["cluster_membership"] = b + """
SELECT c.id AS cluster_id, c.narrative_id, c.cluster_date, a.article_id
FROM clus c JOIN clart a ON a.cluster_id = c.id"""
    q["timeline_emit"] = b + """
SELECT id, narrative_id, event_type, description, event_date, round(significance_score, 6) AS significance_score
FROM events"""
    q["narratives_active"] = b + """
SELECT id, name, support_count, created_at, round(coherence_score, 6) AS coherence_score
FROM narr2 WHERE is_active AND support_count > 0"""
    q["timeline_list"] = b + """
SELECT event_id, narrative_id, narrative_name, event_type, description, event_date,
       round(significance_score, 6) AS significance_score, n_related FROM tl"""
    q["timeline_page"] = b + """
SELECT event_id, narrative_id, narrative_name, event_type, description, event_date,
       round(significance_score, 6) AS significance_score, n_related,
       (SELECT count(*) FROM tl WHERE event_type = 'emergence') AS total_count,
       (SELECT count(*) FROM tl WHERE event_type = 'emergence') > 10 AS has_next,
       2 AS page, 5 AS page_size
FROM tl WHERE event_type = 'emergence'
ORDER BY significance_score DESC, event_date DESC, event_id LIMIT 5 OFFSET 5"""
    q["clusters_list"] = b + """
SELECT c.id AS cluster_id, n.name AS narrative_name, c.cluster_date, x.n_articles, x.article_checksum
FROM clus c JOIN narr2 n ON n.id = c.narrative_id
LEFT JOIN (SELECT cluster_id, count(*) AS n_articles,
                  CAST(sum(CAST(('0x' || substr(md5(CAST(article_id AS VARCHAR)), 1, 8)) AS BIGINT)) AS BIGINT) AS article_checksum
           FROM clart GROUP BY cluster_id) x ON x.cluster_id = c.id"""
    q["weeks_unprocessed"] = b + ",\n" + WEEK_STATS + """
SELECT g.week_idx, g.week_start, g.week_end FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_date >= g.week_start AND e.event_date < g.week_end)"""
    q["weekly_report"] = b + f""",
rep_a AS (SELECT count(*) AS n FROM art WHERE published_date >= {NOW} - INTERVAL 7 DAY),
rep_e AS (SELECT count(*) AS n FROM events WHERE event_date >= {NOW} - INTERVAL 7 DAY),
rep_l AS (SELECT coalesce(string_agg(name || ': ' || event_type || ' - ' || description, ' | ' ORDER BY event_date DESC, id), '') AS s
          FROM (SELECT e.*, n.name FROM events e JOIN narr2 n ON n.id = e.narrative_id
                WHERE e.event_date >= {NOW} - INTERVAL 7 DAY ORDER BY e.event_date DESC, e.id LIMIT 10)),
rep_n AS (SELECT string_agg(name || ': ' || description, ' | ' ORDER BY support_count DESC, created_at DESC, id) AS s
          FROM (SELECT * FROM narr2 WHERE is_active ORDER BY support_count DESC, created_at DESC, id LIMIT 5))
SELECT rep_a.n AS recent_articles, rep_e.n AS recent_events, (rep_a.n > 0 OR rep_e.n > 0) AS has_activity,
       rep_l.s AS latest_events, rep_n.s AS top_narratives
FROM rep_a, rep_e, rep_l, rep_n"""
    q["run_summary"] = b + """,
pw AS (SELECT week, count(*) FILTER (WHERE reject_reason IS NULL) AS acc FROM gated GROUP BY week)
SELECT count(*) AS weeks_processed, 5 - count(*) AS weeks_skipped,
       CAST(sum(acc) AS BIGINT) AS narratives_created, CAST(sum(acc) AS BIGINT) AS naming_calls,
       count(*) FILTER (WHERE acc > 0) AS brief_calls,
       round(CAST(sum(acc) * 0.0001 + count(*) FILTER (WHERE acc > 0) * 0.001 AS DOUBLE), 6) AS estimated_cost_usd
FROM pw"""
    q["cluster_description"] = b + """,
smp AS (
  SELECT week, label, string_agg(title, ', ' ORDER BY r) AS samples FROM (
    SELECT m.week, m.label, m.title, row_number() OVER (PARTITION BY m.week, m.label ORDER BY m.published_date DESC, m.id) AS r
    FROM mem m WHERE (m.week, m.label) IN (SELECT week, label FROM acc)) WHERE r <= 3
  GROUP BY week, label)
SELECT a.week, a.label,
       printf('Weekly narrative with %d articles from %d sources. Compression: %.1f%%', a.n_rows, a.n_sources, a.compression_ratio * 100) AS description_weekly,
       printf('Cluster containing %d articles. Sample: %s', a.n_rows, s.samples) AS description_sample
FROM acc a JOIN smp s ON s.week = a.week AND s.label = a.label"""
    q["shift_events"] = b + f""",
rec AS (SELECT label, count(*) AS n_articles FROM art
        WHERE published_date >= {NOW} - INTERVAL 7 DAY AND embedding IS NOT NULL GROUP BY label),
cand AS (SELECT label, n_articles, 'Narrative Cluster 20240205 - ' || CAST(label AS VARCHAR) AS name FROM rec)
SELECT name, n_articles, round(n_articles / 10.0, 6) AS significance_score,
       printf('New narrative cluster emerged with %d articles', n_articles) AS description,
       {NOW} AS event_date
FROM cand
WHERE n_articles > 5
  AND NOT EXISTS (SELECT 1 FROM clus c WHERE c.narrative_id = {_id('cand.name')} AND c.cluster_date = DATE '2024-02-05')"""
    return q


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def model_queries() -> dict[str, str]:
    """Twins of the model steps; the stub's answers are md5-based, so SQL can give them."""
    from .oracles import ART
    from .oracles_ingest import STMTS

    q = {}
    q["extract_statements"] = with_(ART, STMTS) + f""",
pr AS (SELECT id, md5({_lit(rsp.EXTRACT_HEAD)} || title || {_lit(rsp.EXTRACT_CONTENT)} || substring(content, 1, 3000)
                   || {_lit(rsp.EXTRACT_SOURCE)} || source || {_lit(rsp.EXTRACT_TAIL)}) AS h
       FROM art WHERE id NOT IN (SELECT article_id FROM stmts))
SELECT id AS article_id, 0 AS item_pos, 'Actor ' || substr(h, 2, 2) AS actor, 'did ' || substr(h, 4, 6) AS action,
       '' AS reason, '' AS consequence, 'Actor ' || substr(h, 2, 2) || ' did ' || substr(h, 4, 6) AS full_statement,
       round(CAST(('0x' || substr(h, 10, 1)) AS INTEGER) / 16.0, 6)::DOUBLE AS confidence
FROM pr WHERE substr(h, 1, 1) NOT IN ('0', '1')"""
    titles = with_(ART) + f""",
tr AS (SELECT label, title, row_number() OVER (PARTITION BY label ORDER BY published_date DESC, id) AS r
       FROM art WHERE published_date >= {NOW} - INTERVAL 7 DAY AND embedding IS NOT NULL),
tp AS (SELECT label, {_lit(rsp.TITLES_HEAD)} || string_agg('- ' || title, chr(10) ORDER BY r) || {_lit(rsp.TITLES_TAIL)} AS prompt
       FROM tr WHERE r <= 5 GROUP BY label)"""
    q["name_by_titles"] = titles + """
SELECT label, 'Topic ' || substr(md5(prompt), 1, 6) AS name, CAST(length(prompt) AS INTEGER) AS prompt_chars FROM tp"""
    q["llm_cache_put"] = titles + f"""
SELECT 'naming' AS task_type, md5(prompt) AS content_hash, '"Topic ' || substr(md5(prompt), 1, 6) || '"' AS response,
       round(length(prompt) / 1000.0 * 0.00015, 9)::DOUBLE AS cost, {NOW} AS cached_at, {NOW} + INTERVAL 7 DAY AS expires_at FROM tp"""
    q["name_by_statements"] = with_(STMTS) + f""",
sr AS (SELECT actor, full_statement,
              row_number() OVER (PARTITION BY actor ORDER BY {NOW} + to_seconds(CAST(conv_id AS BIGINT)) DESC, id) AS r FROM stmts),
sp AS (SELECT actor, {_lit(rsp.STATEMENTS_HEAD)} || string_agg('- ' || substring(full_statement, 1, 200) || '...', {_lit(rsp.STATEMENTS_JOIN)} ORDER BY r)
              || {_lit(rsp.STATEMENTS_TAIL)} AS prompt FROM sr WHERE r <= 5 GROUP BY actor)
SELECT actor, 'Topic ' || substr(md5(prompt), 1, 6) AS name, md5(prompt) AS prompt_md5 FROM sp"""
    return q


def job_queries() -> dict[str, str]:
    from .oracles import compress_ctes as _cc
    from .oracles_ingest import ingest_queries

    q = {}
    hashes = with_(*WEEKLY_BASE) + _cc() + """,
hsh AS (SELECT g.week, g.label, md5(coalesce(ks.s_cat, '') || coalesce(kt.t_cat, '')) AS content_hash
        FROM gkey g LEFT JOIN ksj ks ON ks.gid = g.gid LEFT JOIN ktj kt ON kt.gid = g.gid),
fx AS (SELECT content_hash, __NOW__ - to_days(CAST(CAST(('0x' || substr(content_hash, 3, 1)) AS INTEGER) % 10 AS INTEGER)) AS cached_at
       FROM hsh WHERE CAST(('0x' || substr(content_hash, 1, 2)) AS INTEGER) % 2 = 0),
cache AS (
  SELECT 'naming' AS task_type, content_hash, 'Cached ' || substr(content_hash, 1, 6) AS response, cached_at,
         cached_at + INTERVAL 7 DAY AS expires_at FROM fx
  UNION ALL
  SELECT 'naming', content_hash, 'Old ' || substr(content_hash, 1, 6), cached_at - INTERVAL 1 DAY,
         cached_at + INTERVAL 37 DAY FROM fx
  UNION ALL
  SELECT 'brief', content_hash, 'Cached ' || substr(content_hash, 1, 6), cached_at, cached_at + INTERVAL 7 DAY FROM fx),
latest AS (SELECT task_type, content_hash, arg_max(response, cached_at) AS response, arg_max(expires_at, cached_at) AS expires_at
           FROM cache GROUP BY task_type, content_hash)""".replace("__NOW__", NOW)
    q["llm_cache_lookup"] = hashes + f"""
SELECT h.week, h.label, h.content_hash, l.response IS NOT NULL AS hit, l.response AS cached_response
FROM hsh h LEFT JOIN (SELECT * FROM latest WHERE task_type = 'naming' AND expires_at > {NOW}) l
  ON l.content_hash = h.content_hash"""
    brief = _base() + """,
bul AS (SELECT week, label, printf('• %s (%d articles, %d sources, coherence: %.2f)', name, n_rows, n_sources, coherence) AS bullet FROM acc),
bw AS (SELECT week, count(*) AS n, string_agg(bullet, chr(10) ORDER BY label) AS bullets FROM bul GROUP BY week),
bp AS (SELECT week, n, 'Create a concise weekly news narrative summary:' || chr(10) || chr(10) || 'Detected Narratives ('
              || CAST(n AS VARCHAR) || '):' || chr(10) || bullets || chr(10) || chr(10)
              || 'Write a 2-3 sentence summary highlighting:' || chr(10)
              || '1. The main themes/topics that dominated the week' || chr(10)
              || '2. Any notable narrative shifts or emerging stories' || chr(10)
              || '3. Overall media focus trends' || chr(10) || chr(10) || 'Weekly Summary:' AS prompt FROM bw)"""
    q["weekly_brief_input"] = brief + """
SELECT week, CAST(n AS INTEGER) AS n_narratives, CAST(length(prompt) AS INTEGER) AS prompt_chars, md5(prompt) AS prompt_md5 FROM bp"""
    failed = _lit(rsp.FAILED_WEEK[0]) + " || CAST(bp.n AS VARCHAR) || " + _lit(rsp.FAILED_WEEK[1])
    q["weekly_brief"] = brief + f"""
SELECT CAST(w.week AS INTEGER) AS week, CAST(coalesce(bp.n, 0) AS INTEGER) AS n_narratives,
       CASE WHEN bp.n IS NULL THEN {_lit(rsp.EMPTY_WEEK)}
            WHEN substr(md5(bp.prompt), 1, 1) IN ('0', '1', '2', '3') THEN {failed}
            ELSE 'Brief ' || substr(md5(bp.prompt), 1, 8) END AS brief
FROM range(5) w(week) LEFT JOIN bp ON bp.week = w.week"""
    q["run_cost"] = brief + """
SELECT week, count(*) AS calls, CAST(sum(length(prompt)) AS BIGINT) AS chars,
       round(sum(length(prompt)) / 1000.0 * 0.001, 6) AS cost_usd
FROM bp GROUP BY ROLLUP (week)"""
    q["stream_ingest"] = ingest_queries()["ingest_dedup"]
    return q


def statement_ctes() -> str:
    """Clusters of recent confident statements with their scores (after the article and the statement tables)."""
    from .oracles import hash_vectors

    return f"""sm AS (
  SELECT s.actor AS label, s.id, a.source, a.published_date, s.article_id, s.full_statement,
         {NOW} + to_seconds(CAST(s.conv_id AS BIGINT)) AS created_at
  FROM stmts s JOIN art a ON a.id = s.article_id
  WHERE a.published_date >= {NOW} - INTERVAL 14 DAY AND s.confidence >= 0.5),
ssrc AS (SELECT id, full_statement AS txt FROM sm),
""" + hash_vectors("ssrc", "svec") + """,
stm_sp AS (SELECT label, count(*) AS n_rows, count(DISTINCT source) AS n_sources,
              count(DISTINCT CAST(published_date AS DATE)) AS n_days FROM sm GROUP BY label),
stm_sc AS (SELECT label, source, count(*) AS c FROM sm GROUP BY label, source),
stm_sd AS (SELECT label, CASE WHEN count(*) <= 1 THEN CAST(0 AS DOUBLE)
                          ELSE (log2(CAST(sum(c) AS DOUBLE)) - sum(c * log2(CAST(c AS DOUBLE))) / sum(c)) / log2(CAST(count(*) AS DOUBLE)) END AS diversity
       FROM stm_sc GROUP BY label),
stm_ss AS (SELECT m.label, v.slot, sum(v.value) AS s, sum(v.value * v.value) AS q FROM sm m JOIN svec v ON v.id = m.id GROUP BY m.label, v.slot),
stm_st AS (SELECT label, sum(s * s) AS s2, sum(q) AS q FROM stm_ss GROUP BY label),
stm_sg AS (
  SELECT p.label, p.n_rows, p.n_sources, p.n_days, d.diversity,
         CASE WHEN p.n_rows < 2 THEN CAST(0 AS DOUBLE)
              ELSE (coalesce(t.s2, 0) - coalesce(t.q, 0)) / CAST(p.n_rows * (p.n_rows - 1) AS DOUBLE) END AS coherence
  FROM stm_sp p JOIN stm_sd d ON d.label = p.label LEFT JOIN stm_st t ON t.label = p.label),
sgt AS (
  SELECT *, CASE WHEN n_rows < 5 THEN 'too_few_rows' WHEN n_sources < 3 THEN 'too_few_sources'
                 WHEN n_days < 2 THEN 'too_few_days' WHEN coherence < 0.1 THEN 'low_coherence' END AS reject_reason
  FROM stm_sg),
svm AS (SELECT m.label, m.id, v.slot, v.value FROM sm m JOIN svec v ON v.id = m.id),
spairs AS (
  SELECT a.label, a.id AS id_a, b.id AS id_b, sum(a.value * b.value) AS cosine
  FROM svm a JOIN svm b ON a.label = b.label AND a.slot = b.slot AND a.id < b.id GROUP BY a.label, a.id, b.id),
snd AS (
  SELECT g.label, CASE WHEN g.n_rows < 2 THEN CAST(0 AS DOUBLE)
                       ELSE coalesce(c.n, 0) / (g.n_rows * (g.n_rows - 1) / 2.0) END AS near_dup_rate
  FROM sgt g LEFT JOIN (SELECT label, count(*) AS n FROM spairs WHERE cosine > 0.95 GROUP BY label) c ON c.label = g.label),
ssamp AS (
  SELECT label, string_agg(substring(full_statement, 1, 100), ' | ' ORDER BY r) AS samples FROM (
    SELECT label, full_statement, row_number() OVER (PARTITION BY label ORDER BY created_at DESC, id) AS r FROM sm)
  WHERE r <= 3 GROUP BY label),
srel AS (SELECT label, least(count(DISTINCT article_id), 5) AS n_related FROM sm GROUP BY label)"""


def statement_queries() -> dict[str, str]:
    from .oracles import ART
    from .oracles_ingest import STMTS

    q = {}
    q["statement_narratives"] = with_(ART, STMTS) + ",\n" + statement_ctes() + """
SELECT g.label, g.n_rows AS n_statements, g.n_sources, g.n_days, round(g.coherence, 6) AS coherence,
       round(g.diversity, 6) AS diversity,
       CASE WHEN g.reject_reason IS NULL THEN round(n.near_dup_rate, 6) END AS near_dup_rate,
       g.reject_reason IS NULL AS accepted, g.reject_reason,
       printf('Narrative with %d statements from %d sources. Sample statements: %s', g.n_rows, g.n_sources, s.samples) AS description,
       CASE WHEN g.reject_reason IS NULL THEN printf('Narrative detected with %d statements (coherence: %.3f, diversity: %.3f)',
                                                     g.n_rows, g.coherence, g.diversity) END AS event_description,
       CASE WHEN g.reject_reason IS NULL THEN round(g.coherence * g.diversity, 6) END AS significance,
       CASE WHEN g.reject_reason IS NULL THEN r.n_related END AS n_related
FROM sgt g LEFT JOIN snd n ON n.label = g.label JOIN ssamp s ON s.label = g.label JOIN srel r ON r.label = g.label"""
    return q


def sample_queries() -> dict[str, str]:
    from .oracles import ART, ART_WEEK, MEMBERS, hash_vectors
    from .oracles_ingest import STMTS

    q = {}
    q["recent_statements"] = with_(ART, STMTS) + f"""
SELECT s.id AS statement_id, s.article_id, s.actor, round(CAST(s.confidence AS DOUBLE), 6) AS confidence,
       a.published_date, a.source AS article_source
FROM stmts s JOIN art a ON a.id = s.article_id
WHERE a.published_date >= {NOW} - INTERVAL 14 DAY AND s.confidence >= 0.5"""
    q["cluster_samples"] = with_(ART, ART_WEEK, MEMBERS) + """
SELECT week, label, sample_rank, id, title FROM (
  SELECT week, label, id, title,
         CAST(row_number() OVER (PARTITION BY week, label ORDER BY published_date DESC, id) AS INTEGER) AS sample_rank
  FROM mem) WHERE sample_rank <= 5"""
    checks = with_(ART, "hsrc AS (SELECT id, content AS txt FROM art)", hash_vectors("hsrc", "hv")) + """
SELECT a.id, 768 AS n_dims,
       round(coalesce(sum(CAST(CAST(v.value AS FLOAT) AS DOUBLE)), 0), 6) AS total,
       round(coalesce(sum(CAST(CAST(v.value AS FLOAT) AS DOUBLE) * (v.slot + 1)), 0), 6) AS weighted
FROM art a LEFT JOIN hv v ON v.id = a.id{where} GROUP BY a.id"""
    q["stream_embed"] = checks.replace("{where}", " WHERE a.embedding IS NULL")
    q["hash_embed"] = checks.replace("{where}", "")
    q["hash_backfill"] = "SELECT count(*) AS with_vector, count(*) AS total FROM documents"
    q["statement_samples"] = with_(STMTS) + f""",
sct AS (SELECT *, {NOW} + to_seconds(CAST(conv_id AS BIGINT)) AS created_at FROM stmts)
SELECT actor, sample_rank, statement_id, excerpt FROM (
  SELECT actor, id AS statement_id, substring(full_statement, 1, 200) AS excerpt,
         CAST(row_number() OVER (PARTITION BY actor ORDER BY created_at DESC, id) AS INTEGER) AS sample_rank
  FROM sct) WHERE sample_rank <= 5"""
    return q
