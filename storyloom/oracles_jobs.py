"""DuckDB twins of the jobs' writes and the nested lists over them."""

from __future__ import annotations

from .operators import responders as rsp
from .oracles import ART, ART_WEEK, DOC_TEXT, NOW, WEEKLY_BASE, compress_ctes, with_
from .oracles_ingest import STMTS
from .oracles_store import _base, _id, _lit, statement_ctes

TODAY = "2024-02-05"


def digit(name: str) -> str:
    return f"CAST(('0x' || substr(md5({name}), 1, 1)) AS INTEGER)"


ITEM = """concat_ws('|', CAST(a.id AS VARCHAR), a.title, md5(a.content), a.url, strftime(a.published_date, '%Y-%m-%d %H:%M:%S'),
         a.source, strftime(a.published_date + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S'))"""


def statement_store() -> str:
    """What the statement job writes, over a store that holds every second name already."""
    return statement_ctes() + f""",
sacc AS (SELECT g.*, n.near_dup_rate FROM sgt g LEFT JOIN snd n ON n.label = g.label WHERE g.reject_reason IS NULL),
srk AS (SELECT label, full_statement, row_number() OVER (PARTITION BY label ORDER BY created_at DESC, id) AS r FROM sm),
spt AS (SELECT label, {_lit(rsp.STATEMENTS_HEAD)} || string_agg('- ' || substring(full_statement, 1, 200) || '...', {_lit(rsp.STATEMENTS_JOIN)} ORDER BY r)
              || {_lit(rsp.STATEMENTS_TAIL)} AS prompt FROM srk WHERE r <= 5 GROUP BY label),
snm AS (SELECT a.*, 'Topic ' || substr(md5(p.prompt), 1, 6) AS name,
               printf('Narrative with %d statements from %d sources. Sample statements: %s', a.n_rows, a.n_sources, s.samples) AS description
        FROM sacc a JOIN spt p ON p.label = a.label JOIN ssamp s ON s.label = a.label),
snarr AS (
  SELECT {_id('name')} AS id, name,
         CASE WHEN {digit('name')} % 2 = 0 THEN 'Stored ' || name ELSE arg_min(description, label) END AS description,
         CASE WHEN {digit('name')} % 2 = 0 THEN {NOW} - INTERVAL 30 DAY ELSE {NOW} END AS created_at, true AS is_active,
         arg_max(diversity, label) AS source_diversity_score, CAST(arg_max(n_rows, label) AS INTEGER) AS support_count,
         CAST(arg_max(n_sources, label) AS INTEGER) AS unique_sources_count, arg_max(coherence, label) AS coherence_score,
         arg_max(coalesce(near_dup_rate, 0), label) AS near_duplicate_rate, CAST(arg_max(n_days, label) AS INTEGER) AS persistence_days
  FROM snm GROUP BY name),
sclus AS (SELECT {_id(f"'statements|' || name || '|' || label || '|{TODAY}'")} AS id, {_id('name')} AS narrative_id, label,
                 DATE '{TODAY}' AS cluster_date FROM snm),
sclart AS (SELECT DISTINCT c.id AS cluster_id, c.label, m.article_id FROM sclus c JOIN sm m ON m.label = c.label),
sev AS (SELECT {_id(f"'emergence|statements|' || name || '|' || label || '|{TODAY}'")} AS id, {_id('name')} AS narrative_id, label,
               'emergence' AS event_type,
               printf('Narrative detected with %d statements (coherence: %.3f, diversity: %.3f)', n_rows, coherence, diversity) AS description,
               {NOW} AS event_date, coherence * diversity AS significance_score FROM snm),
sevart AS (SELECT e.id AS event_id, c.cluster_id, c.article_id FROM sev e JOIN (
             SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY article_id) AS r FROM sclart) c ON c.label = e.label WHERE c.r <= 5)"""


def all_tables() -> str:
    """The store after the weekly and the statement job."""
    return _base() + ",\n" + STMTS + ",\n" + statement_store() + """,
all_narr AS (SELECT id, name, support_count FROM narr2 UNION ALL SELECT id, name, support_count FROM snarr),
all_clus AS (SELECT id, narrative_id, cluster_date FROM clus UNION ALL SELECT id, narrative_id, cluster_date FROM sclus),
all_clart AS (SELECT cluster_id, article_id FROM clart UNION ALL SELECT cluster_id, article_id FROM sclart)"""


#: The texts hold no Cyrillic letters, so of the Ukrainian patterns only amounts of money can match.
MONEY = r"(?i)(?:₴|грн\.?|\$|€)\s?[\d\s,]+(?:\.\d{2})?(?:\s*(?:мільйон|мільярд|трильйон|тисяч|млн|млрд))?"
SEP = "'\\n'"


def prompt_ctes() -> str:
    """``prm(week, label, prompt)``: the naming prompt's content of each cluster (after the compression's tables)."""
    return f"""pk AS (SELECT gid, 'Key points:' || {SEP} || string_agg(CAST(rank AS VARCHAR) || '. ' || sentence, {SEP} ORDER BY rank) AS x FROM ranked WHERE rank <= 6 GROUP BY gid),
pt AS (SELECT gid, {SEP} || 'Important terms: ' || string_agg(term, ', ' ORDER BY rank) FILTER (WHERE rank <= 10) AS x FROM kterms GROUP BY gid),
pm AS (SELECT gid, list_sort(list_distinct(regexp_extract_all(combined, '{MONEY}'))) AS m FROM comb),
psrc AS (SELECT g.gid, {SEP} || 'Sources (' || CAST(count(DISTINCT m.source) AS VARCHAR) || '): ' || string_agg(DISTINCT m.source, ', ' ORDER BY m.source) AS x
         FROM rk r JOIN mem m ON r.week = m.week AND r.label = m.label AND r.id = m.id JOIN gkey g ON g.week = r.week AND g.label = r.label
         WHERE r.medoid_rank <= 3 GROUP BY g.gid),
prm AS (SELECT g.week, g.label, array_to_string(list_filter([pk.x, pt.x,
          CASE WHEN len(pm.m) > 0 THEN {SEP} || 'Key entities: MONEY: ' || array_to_string(pm.m[1:3], ', ') END, psrc.x], lambda v: v IS NOT NULL), {SEP}) AS prompt
        FROM gkey g LEFT JOIN pk ON pk.gid = g.gid LEFT JOIN pt ON pt.gid = g.gid LEFT JOIN pm ON pm.gid = g.gid LEFT JOIN psrc ON psrc.gid = g.gid)"""


def run_ctes() -> str:
    """The weekly job with the stub model's names."""
    return _base() + ",\n" + prompt_ctes() + f""",
rq AS (SELECT a.*, {_lit(rsp.NAMING_HEAD)} || p.prompt || {_lit(rsp.NAMING_TAIL)} AS prompt FROM acc a JOIN prm p ON p.week = a.week AND p.label = a.label),
rn AS (SELECT *, 'Topic ' || substr(md5(prompt), 1, 6) AS tname FROM rq)"""


def prompt_queries() -> dict[str, str]:
    q = {}
    clusters = with_(*WEEKLY_BASE) + compress_ctes() + ",\n" + prompt_ctes()
    q["prompt_content"] = clusters + """
SELECT week, label, prompt, CAST(length(prompt) AS INTEGER) AS prompt_chars FROM prm"""
    q["name_clusters"] = clusters + f""",
hsh AS (SELECT g.week, g.label, md5(coalesce(ks.s_cat, '') || coalesce(kt.t_cat, '')) AS h
        FROM gkey g LEFT JOIN ksj ks ON ks.gid = g.gid LEFT JOIN ktj kt ON kt.gid = g.gid),
full_prompt AS (SELECT p.week, p.label, h.h, {_lit(rsp.NAMING_HEAD)} || p.prompt || {_lit(rsp.NAMING_TAIL)} AS prompt
                FROM prm p JOIN hsh h ON h.week = p.week AND h.label = p.label),
hit AS (SELECT *, CAST(('0x' || substr(h, 1, 2)) AS INTEGER) % 2 = 0 AND CAST(('0x' || substr(h, 3, 1)) AS INTEGER) % 10 < 7 AS cached FROM full_prompt)
SELECT week, label, CASE WHEN cached THEN 'Cached ' || substr(h, 1, 6) ELSE 'Topic ' || substr(md5(prompt), 1, 6) END AS name,
       cached AS from_cache, CAST(length(prompt) AS INTEGER) AS prompt_chars FROM hit"""
    q["weekly_run"] = run_ctes() + f"""
SELECT {_id("'emergence|' || tname || '|' || strftime(week_start, '%Y-%m-%d %H:%M:%S') || '|' || label")} AS event_id, {_id('tname')} AS narrative_id,
       week_start AS event_date, printf('Weekly narrative: %d articles, coherence %.3f', n_rows, coherence) AS event_description,
       round(significance, 6) AS significance_score, tname AS name,
       printf('Weekly narrative with %d articles from %d sources. Compression: %.1f%%', n_rows, n_sources, compression_ratio * 100) AS description,
       CAST(n_rows AS INTEGER) AS support_count, n_rows AS n_articles FROM rn"""
    head, tail = (_lit(x) for x in (rsp.BRIEF_HEAD, rsp.BRIEF_TAIL))
    q["weekly_run_cost"] = run_ctes() + f""",
bl AS (SELECT week, count(*) AS n, string_agg(printf('• %s (%d articles, %d sources, coherence: %.2f)', tname, n_rows, n_sources, coherence),
              chr(10) ORDER BY label) AS bullets FROM rn GROUP BY week),
bq AS (SELECT {head} || CAST(n AS VARCHAR) || '):' || chr(10) || bullets || {tail} AS prompt FROM bl),
bc AS (SELECT count(*) AS brief_calls, CAST(coalesce(sum(length(prompt) + length(' Brief ') + 8 + 1), 0) AS BIGINT) AS brief_chars
       FROM bq WHERE substr(md5(prompt), 1, 1) NOT IN ('0', '1', '2', '3')),
nc AS (SELECT count(*) AS n, CAST(sum(length(prompt)) AS BIGINT) AS chars FROM rn),
t AS (SELECT nc.n AS narratives_created, nc.n AS naming_calls, nc.chars AS naming_chars, brief_calls, brief_chars,
             chars / 1000.0 * 0.00015 + brief_chars / 1000.0 * 0.001 AS total FROM nc, bc)
SELECT narratives_created, naming_calls, naming_chars, brief_calls, brief_chars, round(CAST(total AS DOUBLE), 9) AS total_cost_usd,
       round(CAST(total / narratives_created AS DOUBLE), 9) AS cost_per_narrative_usd FROM t"""
    return q


def more_queries() -> dict[str, str]:
    from .oracles import _stops
    from .oracles_ingest import FEED

    q = {}
    letters = "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'абцдефгхіжклмнопярстувшиїз')"
    q["keywords_uk_texts"] = with_(ART, DOC_TEXT) + f""",
w AS (SELECT gid, unnest(regexp_extract_all(lower({letters}), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM dtx),
c AS (SELECT gid, word, count(*) AS cnt FROM w WHERE regexp_full_match(word, '[а-яіїєґ]{{3,}}') AND NOT list_contains({_stops()[2]}, word) GROUP BY gid, word)
SELECT * FROM (SELECT gid AS id, word, cnt, CAST(row_number() OVER (PARTITION BY gid ORDER BY cnt DESC, word) AS INTEGER) AS rank FROM c) WHERE rank <= 10"""
    q["feed_limited"] = with_(FEED) + """,
lim AS (SELECT seq FROM feed ORDER BY seq LIMIT 50)
SELECT seq, url, title, source, published_date FROM norm WHERE seq IN (SELECT seq FROM lim)"""
    q["narratives_public"] = _base() + """
SELECT id, name, description, created_at, is_active, round(source_diversity_score, 6) AS source_diversity_score, support_count,
       unique_sources_count, round(coherence_score, 6) AS coherence_score, round(near_duplicate_rate, 6) AS near_duplicate_rate, persistence_days
FROM narr2 WHERE is_active AND support_count > 0"""
    far = "list_sum(list_transform(list_zip({a}, {b}), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    near = "arg_min({c}.cluster, (" + far.format(a="p.vec", b="{c}.cv") + ", {c}.cluster))"
    q["kmeans_converged"] = "WITH RECURSIVE " + with_(ART, ART_WEEK)[5:] + f""",
pts AS (SELECT week, id, label, CAST(embedding AS DOUBLE[]) AS vec FROM artw WHERE embedding IS NOT NULL AND week >= 0 AND week < 5),
px AS (SELECT week, id, label, generate_subscripts(vec, 1) AS i, unnest(vec) AS v FROM pts),
c0 AS (SELECT week, label AS cluster, list(v ORDER BY i) AS cv FROM (SELECT week, label, i, avg(v) AS v FROM px GROUP BY week, label, i) GROUP BY week, label),
st(round, week, cluster, cv, moved) AS (
  SELECT 0, week, cluster, cv, CAST(1 AS DOUBLE) FROM c0
  UNION ALL
  SELECT round + 1, week, cluster, nv, sum({far.format(a='nv', b='cv')}) OVER (PARTITION BY week) FROM (
    SELECT s.round, s.week, s.cluster, s.cv, coalesce(m.cv, s.cv) AS nv FROM st s LEFT JOIN (
      SELECT a.week, a.cluster, list(v ORDER BY i) AS cv FROM (
        SELECT a.week, a.cluster, x.i, avg(x.v) AS v FROM (
          SELECT p.week, p.id, {near.format(c='c')} AS cluster FROM pts p JOIN st c ON p.week = c.week GROUP BY p.week, p.id) a
        JOIN px x ON a.week = x.week AND a.id = x.id GROUP BY a.week, a.cluster, x.i) a GROUP BY a.week, a.cluster) m
    ON m.week = s.week AND m.cluster = s.cluster WHERE s.moved > 1e-9)),
fin AS (SELECT * FROM st QUALIFY round = max(round) OVER (PARTITION BY week))
SELECT p.week, p.id, {near.format(c='c')} AS cluster FROM pts p JOIN fin c ON p.week = c.week GROUP BY p.week, p.id"""
    q["silhouette_sq"] = """WITH v AS (
  SELECT vec_id AS id, label, generate_subscripts(embedding, 1) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
y AS (SELECT label, k, sum(x) AS y, sum(x * x) AS s FROM v GROUP BY label, k),
psi AS (SELECT label, sum(s) AS psi FROM y GROUP BY label),
sq AS (SELECT id, any_value(label) AS label, sum(x * x) AS q FROM v GROUP BY id),
dt AS (SELECT v.id, y.label AS other, sum(v.x * y.y) AS d FROM v JOIN y ON y.k = v.k GROUP BY v.id, y.label),
m AS (SELECT sq.id, sq.label, dt.other, n.n, sq.q + psi.psi / n.n - 2 * dt.d / n.n AS far
      FROM sq JOIN dt ON dt.id = sq.id JOIN n ON n.label = dt.other JOIN psi ON psi.label = dt.other),
ab AS (SELECT id, max(CASE WHEN other = label THEN n END) AS own, max(CASE WHEN other = label AND n > 1 THEN far * n / (n - 1) END) AS a,
              min(CASE WHEN other <> label THEN far END) AS b FROM m GROUP BY id)
SELECT round(avg(CASE WHEN own = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END), 6) AS silhouette, count(*) AS n_rows FROM ab"""
    return q


def job_write_queries() -> dict[str, str]:
    q = prompt_queries() | more_queries()
    own = with_(ART, STMTS) + ",\n" + statement_store()
    q["statement_store"] = own + """
SELECT id, name, description, created_at, is_active, round(source_diversity_score, 6) AS source_diversity_score, support_count,
       unique_sources_count, round(coherence_score, 6) AS coherence_score, round(near_duplicate_rate, 6) AS near_duplicate_rate, persistence_days
FROM snarr"""
    q["statement_membership"] = own + """
SELECT c.cluster_id, c.label, c.article_id, e.article_id IS NOT NULL AS in_event
FROM sclart c LEFT JOIN sevart e ON e.cluster_id = c.cluster_id AND e.article_id = c.article_id"""
    q["clusters_nested"] = all_tables() + f""",
nrk AS (SELECT l.cluster_id, a.id, {ITEM} AS item,
              row_number() OVER (PARTITION BY l.cluster_id ORDER BY a.published_date DESC, a.id) AS r
       FROM all_clart l JOIN art a ON a.id = l.article_id),
npg AS (SELECT cluster_id, CAST(ceil(r / 20.0) AS INTEGER) AS page, string_agg(CAST(id AS VARCHAR), ',' ORDER BY r) AS article_ids,
              md5(string_agg(item, '~' ORDER BY r)) AS articles_md5 FROM nrk GROUP BY ALL),
ntot AS (SELECT cluster_id, count(*) AS n_total FROM nrk GROUP BY cluster_id)
SELECT c.id AS cluster_id, c.narrative_id, n.name AS narrative_name, n.support_count, c.cluster_date, p.page, t.n_total,
       p.article_ids, p.articles_md5
FROM all_clus c JOIN all_narr n ON n.id = c.narrative_id JOIN npg p ON p.cluster_id = c.id JOIN ntot t ON t.cluster_id = c.id"""
    q["timeline_nested"] = all_tables() + f""",
nrk AS (SELECT l.event_id, a.id, {ITEM} AS item, row_number() OVER (PARTITION BY l.event_id ORDER BY a.published_date DESC, a.id) AS r
       FROM sevart l JOIN art a ON a.id = l.article_id),
npg AS (SELECT event_id, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY r) AS article_ids,
              md5(string_agg(item, '~' ORDER BY r)) AS articles_md5 FROM nrk GROUP BY event_id),
nev AS (SELECT id, narrative_id, event_type, description, event_date, significance_score FROM events
       UNION ALL SELECT id, narrative_id, event_type, description, event_date, significance_score FROM sev)
SELECT e.id AS event_id, e.narrative_id, n.name AS narrative_name, e.event_type, e.description, e.event_date,
       round(e.significance_score, 6) AS significance_score, coalesce(p.n, 0) AS n_related, coalesce(p.article_ids, '') AS article_ids, p.articles_md5
FROM nev e JOIN all_narr n ON n.id = e.narrative_id LEFT JOIN npg p ON p.event_id = e.id WHERE n.support_count > 0"""
    q["articles_page"] = with_(ART) + """
SELECT id, title, md5(content) AS content_md5, url, published_date, source, published_date + INTERVAL 1 HOUR AS created_at,
       row_number() OVER (ORDER BY published_date DESC, id) AS rank, (SELECT count(*) FROM art) AS total_count,
       (SELECT count(*) FROM art) > 140 AS has_next, 7 AS page, 20 AS page_size
FROM art ORDER BY published_date DESC, id LIMIT 20 OFFSET 120"""
    q["shift_store"] = with_(ART) + f""",
rec AS (SELECT label, id, title, published_date, embedding, row_number() OVER (PARTITION BY label ORDER BY published_date DESC, id) AS r
        FROM art WHERE published_date >= {NOW} - INTERVAL 7 DAY AND embedding IS NOT NULL AND label IS NOT NULL),
grp AS (SELECT label, count(*) AS n_articles, max(len(embedding)) AS dims, CAST(sum(id) AS BIGINT) AS id_sum,
               {_lit(rsp.TITLES_HEAD)} || string_agg('- ' || title, chr(10) ORDER BY r) FILTER (WHERE r <= 5) || {_lit(rsp.TITLES_TAIL)} AS prompt,
               string_agg(title, ', ' ORDER BY r) FILTER (WHERE r <= 3) AS sample
        FROM rec WHERE (SELECT count(*) FROM rec) >= 5 GROUP BY label),
nm AS (SELECT *, 'Topic ' || substr(md5(prompt), 1, 6) AS name FROM grp),
fl AS (SELECT *, {_id('name')} AS narrative_id, {digit('name')} % 2 <> 0 AND row_number() OVER (PARTITION BY name ORDER BY label) = 1 AS narrative_created,
              {digit('name')} % 4 <> 0 AND row_number() OVER (PARTITION BY name ORDER BY label) = 1 AS cluster_created FROM nm)
SELECT label, name, narrative_id, printf('Cluster containing %d articles. Sample: %s', n_articles, sample) AS description,
       narrative_created, cluster_created,
       CASE WHEN cluster_created THEN {_id(f"'shift|' || narrative_id || '|{TODAY}'")} END AS cluster_id,
       CASE WHEN cluster_created THEN CAST(dims AS INTEGER) END AS n_dims,
       CASE WHEN cluster_created THEN n_articles ELSE 0 END AS n_links, CASE WHEN cluster_created THEN id_sum ELSE 0 END AS link_sum,
       CASE WHEN cluster_created AND n_articles > 5 THEN round(n_articles / 10.0, 6)::DOUBLE END AS significance_score
FROM fl"""
    q["narrative_versions"] = _base() + """
SELECT id, name, description, created_at, round(source_diversity_score, 6) AS source_diversity_score, support_count, unique_sources_count,
       round(coherence_score, 6) AS coherence_score, round(near_duplicate_rate, 6) AS near_duplicate_rate, persistence_days FROM narr"""
    q["windows_covered"] = with_(ART) + """,
w AS (SELECT id, timestamp '2024-01-01 00:00:00' + to_minutes(CAST(id * 104729 % 50400 AS BIGINT)) AS s FROM art),
x AS (SELECT id, s AS start, s + to_minutes(CAST(1 + id * 31 % 90 AS BIGINT)) AS "end" FROM w)
SELECT * FROM x WHERE EXISTS (SELECT 1 FROM art a WHERE a.published_date >= x.start AND a.published_date < x."end")"""
    return q
