"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each query in ``storyloom.catalog`` has a SQL string here computing the same
rows from the driver tables (pre-registered views).  Shared derivations are
CTE fragments so the adapters are written once per dialect.
"""

from __future__ import annotations

NOW = "timestamp '2024-02-05 00:00:00'"

ART = """art AS (
  SELECT d.doc_id AS id,
         substring(split_part(d.text, chr(10), 1), 1, 500) AS title,
         d.text AS content,
         'https://' || d.source || '.example/a/' || CAST(d.doc_id AS VARCHAR) AS url,
         timestamp '2024-01-01 00:00:00' + to_minutes(CAST((d.doc_id * 7919) % 50400 AS BIGINT)) AS published_date,
         d.source, d.lang, e.embedding, e.label
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""

ART_WEEK = f"""artw AS (
  SELECT *, CAST(floor((epoch_us({NOW}) - epoch_us(published_date) - 1) / (7 * 86400 * 1e6)) AS INTEGER) AS week
  FROM art)"""


def hash_vectors(src: str, out: str = "vec") -> str:
    """CTEs turning ``src(id, txt)`` into unit-norm long-form hashed vectors ``out(id, slot, value)``."""
    return f"""{out}_tok AS (
  SELECT id, unnest(regexp_extract_all(lower(txt), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS tok FROM {src}),
{out}_tf AS (SELECT id, tok, count(*) AS tf FROM {out}_tok GROUP BY id, tok),
{out}_w AS (
  SELECT id, CAST(CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % 768 AS INTEGER) AS slot,
         (CASE WHEN CAST('0x' || substr(md5(tok), 9, 1) AS INTEGER) % 2 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END)
           * (1 + ln(CAST(tf AS DOUBLE))) AS w
  FROM {out}_tf),
{out}_raw AS (SELECT id, slot, sum(w) AS raw FROM {out}_w GROUP BY id, slot),
{out}_norm AS (SELECT id, sqrt(sum(raw * raw)) AS norm FROM {out}_raw GROUP BY id),
{out} AS (
  SELECT r.id, r.slot, r.raw / n.norm AS value
  FROM {out}_raw r JOIN {out}_norm n ON r.id = n.id WHERE n.norm > 0)"""


def dense_unit(src_table: str = "embeddings", id_col: str = "vec_id", out: str = "ev") -> str:
    """CTEs: dense ``embedding`` arrays → unit-norm long form ``out(id, slot, value)``."""
    return f"""{out}_x AS (
  SELECT {id_col} AS id, generate_subscripts(embedding, 1) - 1 AS slot, CAST(unnest(embedding) AS DOUBLE) AS raw
  FROM {src_table} WHERE embedding IS NOT NULL),
{out}_n AS (SELECT id, sqrt(sum(raw * raw)) AS norm FROM {out}_x GROUP BY id),
{out} AS (
  SELECT x.id, x.slot, x.raw / n.norm AS value FROM {out}_x x JOIN {out}_n n ON x.id = n.id
  WHERE n.norm > 0 AND x.raw <> 0)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# Members of the label-clustered weekly run: weeks 0..4, label = lang, weeks with ≥ 8 rows.
MEMBERS = """mem AS (
  SELECT week, lang AS label, id, source, published_date, title, content, url FROM artw
  WHERE week >= 0 AND week < 5
    AND week IN (SELECT week FROM artw WHERE week >= 0 AND week < 5 GROUP BY week HAVING count(*) >= 8)),
msrc AS (SELECT id, content AS txt FROM mem)"""

CLUSTER_STATS = """prof AS (
  SELECT week, label, count(*) AS n_rows, count(DISTINCT source) AS n_sources,
         count(DISTINCT CAST(published_date AS DATE)) AS n_days
  FROM mem GROUP BY week, label),
srcc AS (SELECT week, label, source, count(*) AS c FROM mem GROUP BY week, label, source),
div AS (
  SELECT week, label,
         CASE WHEN count(*) <= 1 THEN CAST(0 AS DOUBLE)
              ELSE (log2(CAST(sum(c) AS DOUBLE)) - sum(c * log2(CAST(c AS DOUBLE))) / sum(c)) / log2(CAST(count(*) AS DOUBLE)) END AS diversity
  FROM srcc GROUP BY week, label),
csum AS (
  SELECT m.week, m.label, v.slot, sum(v.value) AS s, sum(v.value * v.value) AS q
  FROM mem m JOIN vec v ON m.id = v.id GROUP BY m.week, m.label, v.slot),
ctot AS (SELECT week, label, sum(s * s) AS s2, sum(q) AS q FROM csum GROUP BY week, label),
coh AS (
  SELECT p.week, p.label,
         CASE WHEN p.n_rows < 2 THEN CAST(1 AS DOUBLE)
              ELSE (coalesce(t.s2, 0) - coalesce(t.q, 0)) / CAST(p.n_rows * (p.n_rows - 1) AS DOUBLE) END AS coherence
  FROM prof p LEFT JOIN ctot t ON p.week = t.week AND p.label = t.label)"""


def gate_cte(min_rows=5, min_sources=3, min_days=2, threshold=0.27) -> str:
    return f"""gated AS (
  SELECT p.week, p.label, p.n_rows, p.n_sources, p.n_days, c.coherence, d.diversity,
         CASE WHEN p.n_rows < {min_rows} THEN 'too_few_rows'
              WHEN p.n_sources < {min_sources} THEN 'too_few_sources'
              WHEN p.n_days < {min_days} THEN 'too_few_days'
              WHEN c.coherence < {threshold} THEN 'low_coherence' END AS reject_reason
  FROM prof p JOIN coh c ON p.week = c.week AND p.label = c.label
              JOIN div d ON p.week = d.week AND p.label = d.label)"""


PAIRS = """vm AS (SELECT m.week, m.label, m.id, v.slot, v.value FROM mem m JOIN vec v ON m.id = v.id),
pairs AS (
  SELECT a.week, a.label, a.id AS id_a, b.id AS id_b, sum(a.value * b.value) AS cosine
  FROM vm a JOIN vm b ON a.week = b.week AND a.label = b.label AND a.slot = b.slot AND a.id < b.id
  GROUP BY a.week, a.label, a.id, b.id)"""

NEAR_DUP = """ndc AS (SELECT week, label, count(*) AS n_dup FROM pairs WHERE cosine > 0.95 GROUP BY week, label),
nd AS (
  SELECT p.week, p.label,
         CASE WHEN p.n_rows < 2 THEN CAST(0 AS DOUBLE)
              ELSE coalesce(n.n_dup, 0) / (p.n_rows * (p.n_rows - 1) / 2.0) END AS near_dup_rate
  FROM prof p LEFT JOIN ndc n ON p.week = n.week AND p.label = n.label)"""

WEEKLY_BASE = [ART, ART_WEEK, MEMBERS, hash_vectors("msrc"), CLUSTER_STATS]


def weekly_narratives_sql(threshold=0.27) -> str:
    return with_(*WEEKLY_BASE, gate_cte(threshold=threshold), PAIRS, NEAR_DUP) + f"""
SELECT g.week, g.label, g.n_rows, g.n_sources, g.n_days,
       round(g.coherence, 6) AS coherence, round(g.diversity, 6) AS diversity,
       g.reject_reason, g.reject_reason IS NULL AS accepted,
       CASE WHEN g.reject_reason IS NULL THEN round(n.near_dup_rate, 6) END AS near_dup_rate,
       CASE WHEN g.reject_reason IS NULL THEN round(g.coherence * g.diversity, 6) END AS significance,
       {NOW} - to_days(CAST(7 * (g.week + 1) AS INTEGER)) AS week_start
FROM gated g LEFT JOIN nd n ON g.week = n.week AND g.label = n.label"""




FWD_START = f"({NOW} - INTERVAL 60 DAY)"

WEEK_STATS = f"""grid AS (
  SELECT CAST(i AS INTEGER) AS week_idx,
         {FWD_START} + to_days(CAST(7 * i AS INTEGER)) AS week_start,
         least({FWD_START} + to_days(CAST(7 * (i + 1) AS INTEGER)), {NOW}) AS week_end
  FROM range(9) t(i)),
fidx AS (
  SELECT CASE WHEN published_date >= {FWD_START} AND published_date < {NOW}
              THEN CAST(floor((epoch_us(published_date) - epoch_us({FWD_START})) / (7 * 86400 * 1e6)) AS INTEGER) END AS week_idx,
         embedding, source
  FROM art),
fagg AS (
  SELECT week_idx, count(*) AS total_articles, count(embedding) AS with_vector,
         count(DISTINCT source) AS unique_sources
  FROM fidx WHERE week_idx IS NOT NULL GROUP BY week_idx),
wstats AS (
  SELECT g.week_idx, g.week_start, g.week_end,
         coalesce(f.total_articles, 0) AS total_articles, coalesce(f.with_vector, 0) AS with_vector,
         coalesce(f.unique_sources, 0) AS unique_sources,
         CASE WHEN coalesce(f.total_articles, 0) > 0 THEN f.with_vector / f.total_articles ELSE 0.0 END AS coverage
  FROM grid g LEFT JOIN fagg f ON g.week_idx = f.week_idx),
wplan AS (SELECT * FROM wstats WHERE with_vector >= 6)"""

EMB = """emb AS (SELECT vec_id AS id, embedding, label FROM embeddings)"""


def _a_queries() -> dict[str, str]:
    q = {}
    q["week_slice"] = with_(ART) + """
SELECT id, published_date, source, label FROM art
WHERE published_date >= timestamp '2024-01-22 00:00:00' AND published_date < timestamp '2024-01-29 00:00:00'
  AND embedding IS NOT NULL"""
    q["recent_articles"] = with_(ART) + f"""
SELECT id, published_date, source FROM art
WHERE published_date >= {NOW} - INTERVAL 7 DAY AND embedding IS NOT NULL"""
    q["weeks_backward"] = with_(ART, ART_WEEK) + f"""
SELECT week, {NOW} - to_days(CAST(7 * (week + 1) AS INTEGER)) AS week_start,
       {NOW} - to_days(CAST(7 * week AS INTEGER)) AS week_end,
       count(*) AS n_articles, count(embedding) AS n_with_vector
FROM artw WHERE week >= 0 GROUP BY week"""
    q["week_stats"] = with_(ART, WEEK_STATS) + """
SELECT week_idx, week_start, week_end, total_articles, with_vector, unique_sources, round(coverage, 6) AS coverage
FROM wstats"""
    q["weeks_forward"] = with_(ART, WEEK_STATS) + """
SELECT week_idx, week_start, week_end, total_articles FROM wstats"""
    q["week_plan"] = with_(ART, WEEK_STATS) + """
SELECT plan_rank, week_start, week_end, with_vector, unique_sources, more_weeks FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY week_idx) AS INTEGER) AS plan_rank,
         greatest(count(*) OVER () - 5, 0) AS more_weeks
  FROM wplan) WHERE plan_rank <= 5"""
    q["cost_estimate"] = with_(ART, WEEK_STATS) + """
SELECT count(*) AS weeks, count(*) * 6 AS estimated_clusters, count(*) * 6 AS cluster_naming_calls,
       count(*) AS weekly_brief_calls, round(CAST(count(*) * 6 * 0.0001 AS DOUBLE), 6) AS cluster_naming_cost,
       round(CAST(count(*) * 0.001 AS DOUBLE), 6) AS weekly_brief_cost,
       round(CAST(count(*) * 6 * 0.0001 + count(*) * 0.001 AS DOUBLE), 6) AS estimated_cost_usd
FROM wplan"""
    q["embed_coverage"] = with_(ART) + """
SELECT count(embedding) AS with_vector, count(*) AS total,
       round(CASE WHEN count(*) > 0 THEN count(embedding) / count(*) END, 6) AS coverage FROM art"""
    q["embed_backlog"] = with_(ART) + """
SELECT id, published_date, title FROM art WHERE embedding IS NULL"""
    q["embed_input"] = with_(ART) + """,
ein AS (SELECT id, title || chr(10) || chr(10) || content AS t FROM art)
SELECT id,
       CAST(length(CASE WHEN length(t) > 8000 THEN substring(t, 1, 7000) || '...' ELSE t END) AS INTEGER) AS n_chars,
       md5(CASE WHEN length(t) > 8000 THEN substring(t, 1, 7000) || '...' ELSE t END) AS input_md5,
       length(t) > 8000 AS truncated
FROM ein"""
    q["articles_filter"] = with_(ART) + """
SELECT id, title, url, published_date, source FROM art WHERE source = 'src3'"""
    q["articles_search"] = with_(ART) + """
SELECT id, title, source FROM art
WHERE (coalesce(contains(lower(title), 'le'), false) OR coalesce(contains(lower(content), 'le'), false))
  AND (coalesce(contains(lower(title), 'de'), false) OR coalesce(contains(lower(content), 'de'), false))"""
    base = [ART, ART_WEEK, MEMBERS]
    q["cluster_profile"] = with_(*base) + """
SELECT week, label, count(*) AS n_rows, count(DISTINCT source) AS n_sources,
       count(DISTINCT CAST(published_date AS DATE)) AS n_days
FROM mem GROUP BY week, label"""
    q["source_diversity"] = with_(*WEEKLY_BASE) + """
SELECT week, label, round(diversity, 6) AS diversity FROM div"""
    q["near_dup_rate"] = with_(*WEEKLY_BASE, PAIRS, NEAR_DUP) + """
SELECT week, label, round(near_dup_rate, 6) AS near_dup_rate FROM nd"""
    q["near_dup_pairs"] = with_(*WEEKLY_BASE, PAIRS) + """
SELECT week, label, id_a, id_b, round(cosine, 6) AS cosine FROM pairs WHERE cosine > 0.95"""
    q["medoids"] = with_(*WEEKLY_BASE) + """,
dots AS (
  SELECT m.week, m.label, m.id, sum(v.value * c.s) AS score
  FROM mem m JOIN vec v ON m.id = v.id JOIN csum c ON c.week = m.week AND c.label = m.label AND c.slot = v.slot
  GROUP BY m.week, m.label, m.id),
sc AS (
  SELECT m.week, m.label, m.id, m.published_date, coalesce(d.score, 0) AS score,
         count(*) OVER (PARTITION BY m.week, m.label) AS n_in
  FROM mem m LEFT JOIN dots d ON d.week = m.week AND d.label = m.label AND d.id = m.id),
rk AS (
  SELECT week, label, id,
         CAST(CASE WHEN n_in <= 3 THEN row_number() OVER (PARTITION BY week, label ORDER BY published_date DESC, id)
              ELSE row_number() OVER (PARTITION BY week, label ORDER BY round(score, 9) DESC, id) END AS INTEGER) AS medoid_rank
  FROM sc)
SELECT week, label, id, medoid_rank FROM rk WHERE medoid_rank <= 3"""
    q["coherence"] = with_(EMB, dense_unit("embeddings", "vec_id", "ev")) + """,
cs AS (SELECT e.label, v.slot, sum(v.value) AS s, sum(v.value * v.value) AS q FROM emb e JOIN ev v ON e.id = v.id GROUP BY e.label, v.slot),
ct AS (SELECT label, sum(s * s) AS s2, sum(q) AS q FROM cs GROUP BY label),
cn AS (SELECT label, count(*) AS n_rows FROM emb GROUP BY label)
SELECT n.label, n.n_rows,
       round(CASE WHEN n.n_rows < 2 THEN 1.0 ELSE (coalesce(t.s2, 0) - coalesce(t.q, 0)) / (n.n_rows * (n.n_rows - 1)) END, 6) AS coherence
FROM cn n LEFT JOIN ct t ON n.label = t.label"""
    q["centroids"] = with_(EMB) + """,
x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS slot, CAST(unnest(embedding) AS DOUBLE) AS v FROM emb WHERE embedding IS NOT NULL),
n AS (SELECT label, count(*) AS n FROM emb GROUP BY label)
SELECT x.label, CAST(x.slot AS INTEGER) AS slot, round(sum(x.v) / n.n, 6) AS value
FROM x JOIN n ON x.label = n.label GROUP BY x.label, x.slot, n.n"""
    q["cosine_pairs"] = with_(EMB, dense_unit("embeddings", "vec_id", "ev")) + """,
lv AS (SELECT e.label, v.id, v.slot, v.value FROM emb e JOIN ev v ON e.id = v.id),
pr AS (
  SELECT a.label, a.id AS id_a, b.id AS id_b, sum(a.value * b.value) AS cosine
  FROM lv a JOIN lv b ON a.label = b.label AND a.slot = b.slot AND a.id < b.id
  GROUP BY a.label, a.id, b.id)
SELECT label, id_a, id_b, round(cosine, 6) AS cosine FROM pr WHERE cosine > 0.3"""
    q["kmeans_assign"] = with_(EMB) + """,
x AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM emb),
c AS (SELECT label AS cluster, list(v ORDER BY i) AS cv FROM (SELECT label, i, avg(v) AS v FROM x GROUP BY label, i) GROUP BY label),
d AS (
  SELECT e.id, e.label, c.cluster,
         list_sum(list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), c.cv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS sqdist
  FROM emb e CROSS JOIN c)
SELECT id AS vec_id, label, arg_min(cluster, (sqdist, cluster)) AS cluster, round(min(sqdist), 6) AS sqdist
FROM d GROUP BY id, label"""
    q["kmeans_lloyd"] = with_(ART, ART_WEEK) + """,
pts AS (SELECT week, id, label, CAST(embedding AS DOUBLE[]) AS vec FROM artw WHERE embedding IS NOT NULL AND week >= 0 AND week < 5),
px AS (SELECT week, id, label, generate_subscripts(vec, 1) AS i, unnest(vec) AS v FROM pts),
c0 AS (SELECT week, label AS cluster, list(v ORDER BY i) AS cv FROM (SELECT week, label, i, avg(v) AS v FROM px GROUP BY week, label, i) GROUP BY week, label),
a1 AS (
  SELECT p.week, p.id, arg_min(c.cluster, (list_sum(list_transform(list_zip(p.vec, c.cv), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), c.cluster)) AS cluster
  FROM pts p JOIN c0 c ON p.week = c.week GROUP BY p.week, p.id),
m1 AS (SELECT a.week, a.cluster, list(v ORDER BY i) AS cv FROM (
         SELECT a.week, a.cluster, x.i, avg(x.v) AS v FROM a1 a JOIN px x ON a.week = x.week AND a.id = x.id GROUP BY a.week, a.cluster, x.i) a
       GROUP BY a.week, a.cluster),
c1 AS (SELECT c.week, c.cluster, coalesce(m.cv, c.cv) AS cv FROM c0 c LEFT JOIN m1 m ON c.week = m.week AND c.cluster = m.cluster),
a2 AS (
  SELECT p.week, p.id, arg_min(c.cluster, (list_sum(list_transform(list_zip(p.vec, c.cv), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), c.cluster)) AS cluster
  FROM pts p JOIN c1 c ON p.week = c.week GROUP BY p.week, p.id),
m2 AS (SELECT a.week, a.cluster, list(v ORDER BY i) AS cv FROM (
         SELECT a.week, a.cluster, x.i, avg(x.v) AS v FROM a2 a JOIN px x ON a.week = x.week AND a.id = x.id GROUP BY a.week, a.cluster, x.i) a
       GROUP BY a.week, a.cluster),
c2 AS (SELECT c.week, c.cluster, coalesce(m.cv, c.cv) AS cv FROM c1 c LEFT JOIN m2 m ON c.week = m.week AND c.cluster = m.cluster)
SELECT p.week, p.id, arg_min(c.cluster, (list_sum(list_transform(list_zip(p.vec, c.cv), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), c.cluster)) AS cluster
FROM pts p JOIN c2 c ON p.week = c.week GROUP BY p.week, p.id"""
    q["silhouette_exact"] = with_(EMB) + """,
e2 AS (SELECT id, label, CAST(embedding AS DOUBLE[]) AS v FROM emb WHERE embedding IS NOT NULL),
d AS (SELECT a.id, a.label AS own, b.label AS other, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS dist
      FROM e2 a JOIN e2 b ON a.id <> b.id),
per AS (SELECT id, own, other, sum(dist) AS s, count(*) AS c FROM d GROUP BY id, own, other),
cn AS (SELECT label, count(*) AS n FROM e2 GROUP BY label),
aa AS (SELECT e.id, e.label, cn.n AS own_n, p.s / p.c AS a FROM e2 e JOIN cn ON cn.label = e.label LEFT JOIN per p ON p.id = e.id AND p.other = e.label),
bb AS (SELECT id, min(s / c) AS b FROM per WHERE other <> own GROUP BY id),
sv AS (SELECT CASE WHEN aa.own_n <= 1 OR bb.b IS NULL THEN 0.0
                   WHEN greatest(aa.a, bb.b) = 0 THEN 0.0
                   ELSE (bb.b - aa.a) / greatest(aa.a, bb.b) END AS s FROM aa LEFT JOIN bb ON aa.id = bb.id)
SELECT round(avg(s), 6) AS silhouette, count(*) AS n_rows FROM sv"""
    return q




def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in sorted(set(words))) + "]"


def _stops():
    from .functions.text import STOP_EN, STOP_UK, STOP_UK_SHORT
    return _sql_list(STOP_UK), _sql_list(STOP_EN), _sql_list(STOP_UK_SHORT)


DOC_TEXT = """dtx AS (SELECT id AS gid, 0 AS ord, title || '. ' || content AS text FROM art)"""


def sentences_cte(src: str, out: str = "sents", min_len: int = 20) -> str:
    return f"""{out}_raw AS (
  SELECT gid, ord, unnest(parts) AS s, generate_subscripts(parts, 1) AS p
  FROM (SELECT gid, ord, regexp_split_to_array(coalesce(text, ''), '[.!?]+') AS parts FROM {src})),
{out} AS (
  SELECT gid, CAST(row_number() OVER (PARTITION BY gid ORDER BY ord, p) - 1 AS INTEGER) AS sent_pos, sentence
  FROM (SELECT gid, ord, p, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS sentence FROM {out}_raw)
  WHERE length(sentence) > {min_len})"""


def tfidf_cte(sents: str = "sents") -> str:
    stop_uk, _, _ = _stops()
    return f"""t_tok AS (
  SELECT gid, sent_pos, unnest(list_filter(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                                           lambda t: NOT list_contains({stop_uk}, t))) AS term FROM {sents}),
t_tf AS (SELECT gid, sent_pos, term, count(*) AS tf FROM t_tok GROUP BY gid, sent_pos, term),
t_n AS (SELECT gid, count(*) AS n FROM {sents} GROUP BY gid),
t_df AS (SELECT gid, term, count(*) AS df FROM t_tf GROUP BY gid, term),
t_w AS (
  SELECT f.gid, f.sent_pos, f.term,
         f.tf * (ln(CAST(1 + n.n AS DOUBLE) / CAST(1 + d.df AS DOUBLE)) + 1) AS w
  FROM t_tf f JOIN t_df d ON f.gid = d.gid AND f.term = d.term JOIN t_n n ON f.gid = n.gid),
tfidf AS (SELECT gid, sent_pos, term, w / sqrt(sum(w * w) OVER (PARTITION BY gid, sent_pos)) AS weight FROM t_w)"""


def rank_cte(sents: str = "sents", k: int = 6) -> str:
    return f"""r_sc AS (SELECT gid, sent_pos, sum(weight) AS score FROM tfidf GROUP BY gid, sent_pos),
r_all AS (
  SELECT s.gid, s.sent_pos, s.sentence, coalesce(r.score, 0) AS score,
         count(*) OVER (PARTITION BY s.gid) AS n_s, max(coalesce(r.score, 0)) OVER (PARTITION BY s.gid) AS any_s
  FROM {sents} s LEFT JOIN r_sc r ON s.gid = r.gid AND s.sent_pos = r.sent_pos),
r_rk AS (
  SELECT gid, sent_pos, sentence, score,
         CAST(CASE WHEN n_s <= {k} OR any_s <= 0 THEN row_number() OVER (PARTITION BY gid ORDER BY sent_pos)
              ELSE row_number() OVER (PARTITION BY gid ORDER BY round(score, 9) DESC, sent_pos DESC) END AS INTEGER) AS rank
  FROM r_all),
ranked AS (SELECT * FROM r_rk WHERE rank <= {k})"""


def key_terms_cte(src: str, k: int = 12) -> str:
    stop_uk, _, _ = _stops()
    return f"""kt_j AS (SELECT gid, string_agg(text, ' ' ORDER BY ord) AS joined FROM {src} GROUP BY gid),
kt_t AS (SELECT gid, list_filter(regexp_extract_all(lower(joined), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                                lambda t: NOT list_contains({stop_uk}, t)) AS toks FROM kt_j),
kt_g AS (SELECT gid, unnest(list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]))) AS term FROM kt_t),
kt_c AS (SELECT gid, term, count(*) AS cnt FROM kt_g GROUP BY gid, term),
kterms AS (
  SELECT * FROM (SELECT gid, term, cnt, CAST(row_number() OVER (PARTITION BY gid ORDER BY cnt DESC, term) AS INTEGER) AS rank FROM kt_c)
  WHERE rank <= {k})"""


MEDOID_TEXT = """,
dots AS (
  SELECT m.week, m.label, m.id, sum(v.value * c.s) AS score
  FROM mem m JOIN vec v ON m.id = v.id JOIN csum c ON c.week = m.week AND c.label = m.label AND c.slot = v.slot
  GROUP BY m.week, m.label, m.id),
sc AS (
  SELECT m.week, m.label, m.id, m.published_date, coalesce(d.score, 0) AS score,
         count(*) OVER (PARTITION BY m.week, m.label) AS n_in
  FROM mem m LEFT JOIN dots d ON d.week = m.week AND d.label = m.label AND d.id = m.id),
rk AS (
  SELECT week, label, id,
         CASE WHEN n_in <= 3 THEN row_number() OVER (PARTITION BY week, label ORDER BY published_date DESC, id)
              ELSE row_number() OVER (PARTITION BY week, label ORDER BY round(score, 9) DESC, id) END AS medoid_rank
  FROM sc),
gkey AS (SELECT DISTINCT week, label, week * 100 + dense_rank() OVER (ORDER BY label) AS gid FROM mem),
ctx AS (
  SELECT g.gid, r.medoid_rank AS ord, m.title || '. ' || m.content AS text
  FROM rk r JOIN mem m ON r.week = m.week AND r.label = m.label AND r.id = m.id
  JOIN gkey g ON g.week = r.week AND g.label = r.label WHERE r.medoid_rank <= 3)"""


def compress_ctes() -> str:
    """CTEs after WEEKLY_BASE: medoids → texts → sentences → TF-IDF ranking → key terms → joins."""
    return MEDOID_TEXT + ",\n" + ",\n".join([sentences_cte("ctx"), tfidf_cte(), rank_cte(), key_terms_cte("ctx")]) + """,
ksj AS (SELECT gid, string_agg(sentence, '' ORDER BY rank) AS s_cat, string_agg(sentence, ' ' ORDER BY rank) AS s_sp, count(*) AS n_s FROM ranked GROUP BY gid),
ktj AS (SELECT gid, string_agg(term, '' ORDER BY rank) AS t_cat, count(*) AS n_t FROM kterms GROUP BY gid),
comb AS (SELECT gid, string_agg(text, ' ' ORDER BY ord) AS combined FROM ctx GROUP BY gid),
tot AS (SELECT week, label, count(*) AS total_articles FROM mem GROUP BY week, label)"""


def _text_queries() -> dict[str, str]:
    stop_uk, stop_en, stop_uk_short = _stops()
    q = {}
    q["sentences"] = with_(ART, DOC_TEXT, sentences_cte("dtx")) + """
SELECT gid AS id, sent_pos, sentence FROM sents"""
    q["tokens"] = with_(ART, DOC_TEXT) + f""",
tk AS (SELECT gid, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: NOT list_contains({stop_uk}, t)) AS toks FROM dtx)
SELECT gid AS id, CAST(len(toks) AS INTEGER) AS n_tokens, CAST(len(list_distinct(toks)) AS INTEGER) AS n_distinct FROM tk"""
    q["sentence_tfidf"] = with_(ART, DOC_TEXT, sentences_cte("dtx"), tfidf_cte()) + """
SELECT gid AS id, sent_pos, count(*) AS n_terms, round(sum(weight), 6) AS weight_sum, round(max(weight), 6) AS weight_max
FROM tfidf GROUP BY gid, sent_pos"""
    q["rank_sentences"] = with_(ART, DOC_TEXT, sentences_cte("dtx"), tfidf_cte(), rank_cte()) + """
SELECT gid AS id, sent_pos, sentence, round(score, 6) AS score, rank FROM ranked"""
    q["key_terms"] = with_(ART, DOC_TEXT, key_terms_cte("dtx")) + """
SELECT gid AS id, term, cnt, rank FROM kterms"""
    q["term_freq_en"] = with_(ART, DOC_TEXT) + f""",
w AS (SELECT gid, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM dtx),
c AS (SELECT gid, word, count(*) AS cnt FROM w WHERE regexp_full_match(word, '[a-z]{{3,}}') AND NOT list_contains({stop_en}, word) GROUP BY gid, word)
SELECT * FROM (SELECT gid AS id, word, cnt, CAST(row_number() OVER (PARTITION BY gid ORDER BY cnt DESC, word) AS INTEGER) AS rank FROM c) WHERE rank <= 10"""
    q["keywords_uk"] = with_(ART, DOC_TEXT) + f""",
w AS (SELECT gid, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM dtx),
c AS (SELECT gid, word, count(*) AS cnt FROM w WHERE regexp_full_match(word, '[а-яіїєґ]{{3,}}') AND NOT list_contains({stop_uk_short}, word) GROUP BY gid, word)
SELECT * FROM (SELECT gid AS id, word, cnt, CAST(row_number() OVER (PARTITION BY gid ORDER BY cnt DESC, word) AS INTEGER) AS rank FROM c) WHERE rank <= 10"""
    q["language_stats"] = with_(ART, DOC_TEXT) + """
SELECT gid AS id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS INTEGER) AS token_count,
       CAST(len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 10)) AS INTEGER) AS sentence_count,
       coalesce(regexp_matches(lower(text), '[іїєґ]'), false) AS is_ukrainian
FROM dtx"""
    q["content_hash"] = with_(*WEEKLY_BASE) + compress_ctes() + """
SELECT g.week, g.label, md5(coalesce(ks.s_cat, '') || coalesce(kt.t_cat, '')) AS content_hash, t.total_articles,
       round(length(coalesce(ks.s_sp, '')) / length(c.combined), 6) AS compression_ratio,
       CAST(coalesce(ks.n_s, 0) AS INTEGER) AS n_sentences, CAST(coalesce(kt.n_t, 0) AS INTEGER) AS n_terms
FROM gkey g JOIN comb c ON c.gid = g.gid JOIN tot t ON t.week = g.week AND t.label = g.label
LEFT JOIN ksj ks ON ks.gid = g.gid LEFT JOIN ktj kt ON kt.gid = g.gid"""
    return q




def oracle_sql() -> dict[str, str]:
    from .oracles_ingest import ingest_queries
    from .oracles_jobs import job_write_queries
    from .oracles_store import (job_queries, model_queries, sample_queries, statement_queries,
                                store_queries)

    d = {"weekly_narratives": weekly_narratives_sql()}
    d.update(_a_queries())
    d.update(_text_queries())
    d.update(ingest_queries())
    d.update(store_queries())
    d.update(job_queries())
    d.update(statement_queries())
    d.update(sample_queries())
    d.update(model_queries())
    d.update(job_write_queries())
    return d
