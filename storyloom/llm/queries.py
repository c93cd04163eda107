"""The contract queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from ..sources.tables import read_table
from . import (ann, divergence, embed_dedup, fill_middle, langid, line_dedup, lm_score, mixing, near_dedup, packing, pii, quality,
               secret_scan)
from .common import bounded_batches


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return mixing.taken_words(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


#: Targets by rounds of resharing would need recursion; the level at which the unfilled sources settle is a closed
#: form over the sources sorted by words per weight.  The words taken are the first ``want`` words of the source's
#: shuffled stream, which may run twice.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE
         WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM s0),
s2 AS (SELECT *, (sum(n) OVER () * 1.5::DOUBLE - coalesce(sum(n * 2.0::DOUBLE) OVER (ORDER BY n * 2.0::DOUBLE / w, source NULLS LAST
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY n * 2.0::DOUBLE / w, source NULLS LAST
         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM s1),
s3 AS (SELECT *, CASE WHEN lev >= n * 2.0::DOUBLE / w THEN n * 2.0::DOUBLE
         ELSE max(CASE WHEN lev < n * 2.0::DOUBLE / w THEN lev END) OVER () * w END AS target FROM s2),
s4 AS (SELECT source, n, target, floor(target + 0.5)::BIGINT AS want FROM s3),
p AS (SELECT d.doc_id, d.size, s4.n, s4.target, s4.want,
        (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST, d.size
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS b
      FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source)
SELECT doc_id, size, n AS source_size, target,
       (greatest(0, least(b, want) - (b - size)) + greatest(0, least(b, want - n) - (b - size)))::BIGINT AS taken
FROM p
"""


def spans_text(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"])))
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def span_digest(found: DataFrame, kinds: tuple[str, ...], base_kinds: int) -> DataFrame:
    def count(kind: int) -> Column:  # a second argument of the lambda would be the place in the array
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kinds[kind]}")

    counts = [count(k) for k in range(base_kinds)]
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("base"), kinds), 256).alias("base_sha256"),
                        spans_text(F.concat("base", "found"), kinds).alias("spans"),
                        F.size("found").cast("long").alias("n_found"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(configure(spark))
    return span_digest(pii.find(read_table(spark, sf_dir, "documents")), pii.KINDS, 4)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(configure(spark), sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(configure(spark))
    docs = read_table(spark, sf_dir, "documents")
    scored, name = quality.score(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.col(name).alias("score"), (F.col(name).isNull() | (F.col(name) >= 0.5)).alias("kept"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(configure(spark))
    return span_digest(secret_scan.find(read_table(spark, sf_dir, "documents")), secret_scan.KINDS, 3)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(configure(spark))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.size(F.split("text", "\n", -1))
    kept = line_dedup.dedup_lines(docs.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(lines).cast("long")))
    return kept.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
                       F.coalesce(F.array_join(F.transform("dropped", lambda x: x.cast("string")), ","), F.lit("")).alias("dropped"),
                       F.sha2("text", 256).alias("text_sha256"))


#: The whole deletion neighbourhood of every line, without sieves.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, text, md5(text) AS c, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, c, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM d),
p AS (SELECT DISTINCT *, dense_rank() OVER (ORDER BY doc_id NULLS LAST, c, i) AS pos FROM o
      WHERE length(trim(l, chr(32) || chr(9) || chr(13) || chr(11) || chr(12))) >= 4),
f AS (SELECT l, min(pos) AS first FROM p GROUP BY l),
v AS (SELECT l, first, k, substr(l, 1, k - 1) || substr(l, k + 1) AS v
      FROM (SELECT l, first, unnest(range(1, length(l) + 1)) AS k FROM f WHERE length(l) >= 12)),
near AS (
  SELECT l FROM (SELECT l, first, min(first) OVER (PARTITION BY v, k) AS m FROM v) WHERE m < first
  UNION SELECT v.l FROM v JOIN f ON f.l = v.v AND length(f.l) >= 12 WHERE f.first < v.first
  UNION SELECT f.l FROM v JOIN f ON f.l = v.v AND length(f.l) >= 12 WHERE v.first < f.first),
g AS (SELECT p.doc_id, p.c, p.i FROM p JOIN f ON p.l = f.l LEFT JOIN near n ON n.l = p.l WHERE p.pos <> f.first OR n.l IS NOT NULL),
a AS (SELECT doc_id, c, list_sort(list(i)) AS gone FROM g GROUP BY doc_id, c)
SELECT t.doc_id, CASE WHEN t.text IS NULL THEN 0 ELSE len(string_split(t.text, chr(10))) END::BIGINT AS n_lines,
       coalesce(len(a.gone), 0)::BIGINT AS n_dropped, coalesce(array_to_string(a.gone, ','), '') AS dropped,
       sha256(CASE WHEN a.gone IS NULL THEN t.text ELSE array_to_string(list_filter(string_split(t.text, chr(10)),
              lambda x, k: NOT list_contains(a.gone, k - 1)), chr(10)) END) AS text_sha256
FROM documents t LEFT JOIN a ON t.doc_id IS NOT DISTINCT FROM a.doc_id AND md5(t.text) = a.c
"""


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(configure(spark))
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read_table(configure(spark), sf_dir, "embeddings"))


#: The definition taken literally: all pairs, and reachability over the links.
OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT m.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.c, m.vec_id) AS component_id,
       coalesce(c.c, m.vec_id) = m.vec_id AS kept
FROM embeddings m LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = m.vec_id
LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = m.vec_id
"""


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(configure(spark))
    good = lm_score.good_documents(read_table(spark, sf_dir, "labels"))
    return lm_score.score(read_table(spark, sf_dir, "documents"), good)


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(configure(spark), sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(configure(spark))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = langid.train(docs.filter(~langid.held_out()))
    return langid.predict(docs, models).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(configure(spark))
    return divergence.audit(read_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
o AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM d),
t AS (SELECT r, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM o),
l AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
k AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN l USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS size FROM l GROUP BY lang),
g0 AS (SELECT DISTINCT lang, source FROM d),
g AS (SELECT g0.lang, g0.source, coalesce(s.total, 0)::HUGEINT AS total, v.size FROM g0 LEFT JOIN v USING (lang)
      LEFT JOIN (SELECT lang, source, sum(n) AS total FROM k GROUP BY ALL) s USING (lang, source)),
p AS (SELECT g.lang, g.source, l.term, coalesce(k.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(k.n, 0) + 1)) // (g.total + g.size) AS p,
        1 + (1000000000::HUGEINT * (l.n + 1)) // (v.total + v.size) AS q
      FROM g JOIN l USING (lang) JOIN v USING (lang) LEFT JOIN k USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM r QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200
"""


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(configure(spark))
    cut = fill_middle.transform(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))


OP13_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
                  sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
d AS (SELECT doc_id, t, n, ('0x' || substr(s, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(s, 9, 8))::BIGINT % (n + 1) AS c2,
             ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM h),
c AS (SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_pii": op2_pii,
        "op3_line_dedup": op3_line_dedup,
        "op4_minhash_dedup": op4_minhash_dedup,
        "op5_embed_dedup": op5_embed_dedup,
        "op6_packing": op6_packing,
        "op7_quality": op7_quality,
        "op8_secret_scan": op8_secret_scan,
        "op9_lm_score": op9_lm_score,
        "op10_ann": op10_ann,
        "op11_langid": op11_langid,
        "op12_divergence": op12_divergence,
        "op13_fill_middle": op13_fill_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op3_line_dedup": OP3_SQL, "op5_embed_dedup": OP5_SQL, "op12_divergence": OP12_SQL,
            "op13_fill_middle": OP13_SQL}
