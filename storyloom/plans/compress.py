"""Cluster compression (G15–G17): medoid texts → key sentences, key terms,
entities, content hash, compression ratio, and the naming-prompt content.

Input ``texts`` holds the ≤ 3 medoid rows per cluster (keys…, id, doc_order,
source, title, url, published_date, text), so every per-cluster collect here
is bounded by the medoid count; the cluster size comes from ``members`` (the
member rows, or already-counted sizes as (keys…, n_rows)).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import summarize as sm

# Prompt layout of the reference (its joiner is a literal backslash-n).
PROMPT_SEP = "\\n"
PROMPT_SENTENCES = 6
PROMPT_TERMS = 10
PROMPT_ENTITIES = 3


def compress_clusters(members: DataFrame, texts: DataFrame, keys: Sequence[str],
                      ranker: str = "textrank", max_sentences: int = 6, max_terms: int = 12,
                      language: str = "uk", stop_words=tx.STOP_UK) -> DataFrame:
    keys = list(keys)
    sents = sm.sentence_table(texts, keys, "text", "doc_order", 20)
    if ranker == "textrank":
        ranked = sm.textrank(sents, keys, max_sentences, stop_words)
    else:
        ranked = sm.rank_sentences(sents, keys, max_sentences, stop_words)
    ks = ranked.groupBy(*keys).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "sentence"))), lambda x: x["sentence"])
        .alias("key_sentences"))
    kt = sm.key_terms(texts, keys, max_terms, "text", "doc_order", stop_words).groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"])
        .alias("key_terms"))
    iso = F.concat(F.date_format("published_date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    med = texts.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("doc_order", "text"))).alias("_t"),
        F.sort_array(F.collect_list(F.struct(
            "doc_order", "title", "source", "url", iso.alias("published_date")))).alias("_m"))
    med = med.select(*keys, F.array_join(F.transform("_t", lambda x: x["text"]), " ").alias("combined_text"),
                     F.transform("_m", lambda x: F.struct(x["title"].alias("title"), x["source"].alias("source"),
                                                          x["url"].alias("url"),
                                                          x["published_date"].alias("published_date")))
                     .alias("medoid_articles"))
    if "n_rows" in members.columns:   # cluster sizes already known: (keys…, n_rows)
        n = members.select(*keys, F.col("n_rows").alias("total_articles"))
    else:
        n = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_articles"))
    empty = F.array().cast("array<string>")
    out = (med.join(ks, keys, "left").join(kt, keys, "left").join(n, keys)
           .withColumn("key_sentences", F.coalesce("key_sentences", empty))
           .withColumn("key_terms", F.coalesce("key_terms", empty))
           .withColumn("entities", tx.entities(F.col("combined_text"), language)))
    return out.select(
        *keys, "medoid_articles", "key_sentences", "key_terms", "entities",
        F.md5(F.concat(F.array_join("key_sentences", ""), F.array_join("key_terms", ""))).alias("content_hash"),
        "total_articles",
        (F.length(F.array_join("key_sentences", " ")) / F.length("combined_text")).alias("compression_ratio"))


def prompt_content(c: DataFrame) -> Column:
    """Numbered key points, terms, entities (3 per type), distinct sources."""
    ks = F.col("key_sentences")
    kt = F.col("key_terms")
    ents = F.col("entities")
    empty = F.array().cast("array<string>")
    points = F.when(F.size(ks) > 0, F.concat(
        F.array(F.lit("Key points:")),
        F.transform(F.slice(ks, 1, PROMPT_SENTENCES),
                    lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)))).otherwise(empty)
    terms = F.when(F.size(kt) > 0, F.array(F.concat(
        F.lit(PROMPT_SEP + "Important terms: "), F.array_join(F.slice(kt, 1, PROMPT_TERMS), ", ")))
    ).otherwise(empty)
    per_type = F.filter(F.array(*[
        F.when(F.size(F.coalesce(ents[t], empty)) > 0,
               F.concat(F.lit(t + ": "), F.array_join(F.slice(ents[t], 1, PROMPT_ENTITIES), ", ")))
        for t in tx.ENTITY_TYPES]), lambda x: x.isNotNull())
    ent_part = F.when(F.size(per_type) > 0, F.array(F.concat(
        F.lit(PROMPT_SEP + "Key entities: "), F.array_join(per_type, "; ")))).otherwise(empty)
    srcs = F.array_sort(F.array_distinct(F.transform("medoid_articles", lambda a: a["source"])))
    src_part = F.when(F.size(srcs) > 0, F.array(F.concat(
        F.lit(PROMPT_SEP + "Sources ("), F.size(srcs).cast("string"), F.lit("): "),
        F.array_join(srcs, ", ")))).otherwise(empty)
    return F.array_join(F.concat(points, terms, ent_part, src_part), PROMPT_SEP)
