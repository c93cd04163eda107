"""Cluster summarisation on DataFrames.

A *group* is any key tuple (a cluster, or a document in the showcase queries);
its corpus is the sentences of its texts.  TF-IDF, sentence scores, key terms
and word counts are grouped aggregates and windows keyed by the group, so
groups run in parallel and no vocabulary ever reaches the driver.

Only the PageRank power iteration (G6) runs in Python: one group's sentence ×
term matrix per packed row in ``mapInPandas``.  Groups too large for a task are
iterated by joins instead.  The iteration never forms the sentence × sentence graph: with W = T·Tᵀ
(T = L2-normalised TF-IDF rows) every product is taken as T·(Tᵀ·x).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as tx
from ..session import materialize

# The library defaults the reference relies on.
PAGERANK_ALPHA = 0.85
PAGERANK_TOL = 1.0e-6
PAGERANK_MAX_ITER = 100


def sentence_table(docs: DataFrame, keys: Sequence[str], text_col: str = "text",
                   order_col: str = "doc_order", min_len: int = 20) -> DataFrame:
    """G1 per group: (keys…, sent_pos, sentence) — sentences numbered in text order
    across the group's texts (texts ordered by ``order_col``)."""
    keys = list(keys)
    s = docs.select(*keys, order_col, F.posexplode(tx.sentences(F.col(text_col), min_len))
                    .alias("_p", "sentence"))
    w = Window.partitionBy(*keys).orderBy(order_col, "_p")
    return s.select(*keys, (F.row_number().over(w) - 1).alias("sent_pos"), "sentence")


#: Sentences of a group up to which one task ranks it.
LARGE_GROUP = 50_000


def _packed_tfidf(keys: Sequence[str]):
    """Rows (keys…, _s = sentences of the group as (sent_pos, terms)) to rows (keys…, sent_pos, term, weight)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column("_s")
            n = packed.value_lengths().to_numpy(zero_copy_only=False)
            each = packed.flatten()
            group, place = np.repeat(np.arange(len(n)), n), each.field("sent_pos").to_numpy(zero_copy_only=False).astype(np.int64)
            lists = each.field("terms")
            terms = lists.flatten().dictionary_encode()
            size = max(len(terms.dictionary), 1)
            sentence = np.repeat(np.arange(len(group)), lists.value_lengths().to_numpy(zero_copy_only=False))
            cells, tf = np.unique(sentence * size + terms.indices.to_numpy(), return_counts=True)
            sentence, term = np.divmod(cells, size)
            _, at, df = np.unique(group[sentence] * size + term, return_inverse=True, return_counts=True)
            weight = tf * (np.log((1.0 + n[group[sentence]]) / (1.0 + df[at])) + 1.0)
            norm = np.sqrt(np.bincount(sentence, weight * weight, len(group)))
            columns = [batch.column(k).take(pa.array(group[sentence])) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(place[sentence], each.field("sent_pos").type), terms.dictionary.take(pa.array(term)),
                 pa.array(weight / norm[sentence])], names=[*keys, "sent_pos", "term", "weight"])
    return run


def sentence_tfidf(sents: DataFrame, keys: Sequence[str], stop_words=tx.STOP_UK, large: int | None = None) -> DataFrame:
    """Smooth-idf TF-IDF, L2-normalised per sentence; corpus = the group's sentences.

    idf = ln((1 + n) / (1 + df)) + 1.  Output (keys…, sent_pos, term, weight).

    Plan: groups of up to ``large`` sentences (``LARGE_GROUP``) are packed, a row per group
    with its sentences' terms, and weighted in the task that packs them, so that no
    aggregate or window holds or spills a row per term.  Larger groups, if there are
    any, are weighted by aggregates and windows over all executors.
    """
    keys = list(keys)
    large = LARGE_GROUP if large is None else large
    huge = materialize(sents.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > large).select(*keys), "tfidf-large")
    some = not huge.isEmpty()
    small = sents.join(huge, keys, "left_anti") if some else sents
    packed = small.groupBy(*keys).agg(F.collect_list(F.struct(
        "sent_pos", tx.tokens(F.col("sentence"), stop_words).alias("terms"))).alias("_s"))
    schema = T.StructType([*(sents.schema[k] for k in keys), sents.schema["sent_pos"], T.StructField("term", T.StringType()),
                           T.StructField("weight", T.DoubleType())])
    weights = packed.mapInArrow(_packed_tfidf(keys), schema)
    return weights.unionByName(_spread_tfidf(sents.join(huge, keys, "left_semi"), keys, stop_words)) if some else weights


def _spread_tfidf(sents: DataFrame, keys: Sequence[str], stop_words) -> DataFrame:
    """The same by aggregates and windows keyed by the group first: one exchange of the sentences."""
    keys = list(keys)
    grp = sents.repartition(*keys)
    n = F.max("_n").over(Window.partitionBy(*keys))
    tf = (grp.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
          .select(*keys, "sent_pos", "_n", F.explode(tx.tokens(F.col("sentence"), stop_words)).alias("term"))
          .groupBy(*keys, "sent_pos", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("_n").alias("_n")))
    df = F.count(F.lit(1)).over(Window.partitionBy(*keys, "term"))
    w = tf.withColumn("_w", F.col("tf") * (F.log((F.lit(1.0) + F.col("_n")) / (F.lit(1.0) + df)) + 1.0))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(*keys, "sent_pos")))
    return w.select(*keys, "sent_pos", "term", (F.col("_w") / norm).alias("weight"))


def rank_sentences(sents: DataFrame, keys: Sequence[str], k: int = 6,
                   stop_words=tx.STOP_UK) -> DataFrame:
    """Top k sentences by TF-IDF weight sum; groups of ≤ k keep all in order.

    Ties: score (rounded to 1e-9) desc, then later position first — the
    reversed stable ascending sort of the reference.  A group whose sentences
    have no term at all keeps its first k (the reference's fallback).
    Output (keys…, sent_pos, sentence, score, rank).
    """
    keys = list(keys)
    score = (sentence_tfidf(sents, keys, stop_words)
             .groupBy(*keys, "sent_pos").agg(F.sum("weight").alias("score")))
    s = sents.join(score, [*keys, "sent_pos"], "left").withColumn(
        "score", F.coalesce(F.col("score"), F.lit(0.0)))
    g = Window.partitionBy(*keys)
    s = s.withColumn("_n", F.count(F.lit(1)).over(g)).withColumn("_any", F.max("score").over(g))
    by_score = F.row_number().over(Window.partitionBy(*keys).orderBy(
        F.round("score", 9).desc(), F.col("sent_pos").desc()))
    by_pos = F.row_number().over(Window.partitionBy(*keys).orderBy("sent_pos"))
    rank = F.when((F.col("_n") <= k) | (F.col("_any") <= 0), by_pos).otherwise(by_score)
    return (s.withColumn("rank", rank).where(F.col("rank") <= k)
            .select(*keys, "sent_pos", "sentence", "score", "rank"))


def _pagerank_sparse(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n: int) -> np.ndarray:
    """PageRank of the graph W = T·Tᵀ given T in coordinate form (n sentences).

    Same iteration as the reference's library: uniform start and teleport,
    out-weight normalisation, dangling mass spread evenly, stop when the L1
    change is below n·tol, at most 100 rounds (then raise).
    """
    n_terms = int(cols.max()) + 1 if len(cols) else 0
    colsum = np.bincount(cols, weights=vals, minlength=n_terms) if n_terms else np.zeros(0)
    out_w = np.bincount(rows, weights=vals * colsum[cols], minlength=n) if n_terms else np.zeros(n)
    dangling = out_w <= 0
    inv = np.where(dangling, 0.0, 1.0 / np.where(dangling, 1.0, out_w))
    x = np.full(n, 1.0 / n)
    p = np.full(n, 1.0 / n)
    for _ in range(PAGERANK_MAX_ITER):
        last = x
        y = last * inv
        z = np.bincount(cols, weights=vals * y[rows], minlength=n_terms) if n_terms else np.zeros(0)
        xw = np.bincount(rows, weights=vals * z[cols], minlength=n) if n_terms else np.zeros(n)
        x = PAGERANK_ALPHA * (xw + last[dangling].sum() * p) + (1 - PAGERANK_ALPHA) * p
        if np.abs(x - last).sum() < n * PAGERANK_TOL:
            return x
    raise RuntimeError("pagerank did not converge")


def large_pagerank(matrix: DataFrame, sents: DataFrame, keys: Sequence[str], rounds: int = PAGERANK_MAX_ITER) -> DataFrame:
    """PageRank of W = T·Tᵀ for groups of any size: (keys…, sent_pos, score), without the groups that do not converge.

    ``matrix`` holds T's entries (keys…, sent_pos, term, weight), ``sents`` every
    sentence (keys…, sent_pos, _n = sentences of the group).  A round takes z = Tᵀ·y and T·z as
    two joins with sums over the entries, so no task holds a group, and writes the
    new scores to the shared folder.  Groups stop one by one; rounds go on over
    those still open.
    """
    keys = list(keys)
    place, word = [*keys, "sent_pos"], [*keys, "term"]
    matrix = materialize(matrix.select(*place, "term", "weight"), "pagerank-matrix")
    sums = matrix.groupBy(*word).agg(F.sum("weight").alias("_c"))
    out = matrix.join(sums, word).groupBy(*place).agg(F.sum(F.col("weight") * F.col("_c")).alias("out"))
    state = materialize(sents.select(*place, "_n").join(out, place, "left").select(
        *place, "_n", F.coalesce("out", F.lit(0.0)).alias("out"), (F.lit(1.0) / F.col("_n")).alias("x")), "pagerank-state")
    done = None
    for _ in range(rounds):
        y = state.where(F.col("out") > 0).select(*place, (F.col("x") / F.col("out")).alias("y"))
        z = matrix.join(y, place).groupBy(*word).agg(F.sum(F.col("weight") * F.col("y")).alias("z"))
        flow = matrix.join(z, word).groupBy(*place).agg(F.sum(F.col("weight") * F.col("z")).alias("flow"))
        lost = state.groupBy(*keys).agg(F.sum(F.when(F.col("out") <= 0, F.col("x")).otherwise(0.0)).alias("lost"))
        new = (F.lit(PAGERANK_ALPHA) * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") / F.col("_n")) + (1 - PAGERANK_ALPHA) / F.col("_n"))
        stepped = materialize(state.join(flow, place, "left").join(lost, keys)
                              .select(*place, "_n", "out", new.alias("x"), F.abs(new - F.col("x")).alias("moved")), "pagerank-round")
        still = materialize(stepped.groupBy(*keys).agg(F.sum("moved").alias("moved"), F.first("_n").alias("_n"))
                            .select(*keys, (F.col("moved") >= F.col("_n") * PAGERANK_TOL).alias("open")), "pagerank-groups")
        over = stepped.join(still.where(~F.col("open")), keys, "left_semi").select(*place, F.col("x").alias("score"))
        done = over if done is None else done.unionByName(over)
        state = stepped.drop("moved").join(still.where("open"), keys, "left_semi")
        if still.where("open").isEmpty():
            break
    return done


def textrank(sents: DataFrame, keys: Sequence[str], k: int = 6, stop_words=tx.STOP_UK, large: int = LARGE_GROUP) -> DataFrame:
    """TextRank key sentences per group; groups of ≤ k keep all in order.

    TF-IDF weights come from ``sentence_tfidf`` (Spark); the power iteration
    runs per group in ``mapInPandas`` (one packed row per group), and by joins over
    all executors for groups of more than ``large`` sentences (``large_pagerank``).
    Ranking: (score, sentence) both descending (E10).  A group whose iteration fails falls back to G5.
    Output (keys…, sent_pos, sentence, score, rank).
    """
    keys = list(keys)
    g = Window.partitionBy(*keys)
    # Three branches read the sentence table and two read the ranking: write each once.
    sized = materialize(sents.withColumn("_n", F.count(F.lit(1)).over(g)), "textrank-sentences")
    small = sized.where(F.col("_n") <= k).select(
        *keys, "sent_pos", "sentence", F.lit(None).cast("double").alias("score"),
        (F.col("sent_pos") + 1).cast("int").alias("rank"))
    big = sized.where((F.col("_n") > k) & (F.col("_n") <= large)).drop("_n")
    w = sentence_tfidf(big, keys, stop_words)
    # One row per group (its sentences and its sparse TF-IDF matrix): the group is
    # bounded by its texts, and mapInPandas then ranks many groups per batch.
    # Both packs are keyed by the group only, so they join without a reshuffle.
    mat = (w.withColumn("_t", F.dense_rank().over(Window.partitionBy(*keys).orderBy("term")) - 1)
           .groupBy(*keys).agg(F.collect_list(F.struct("sent_pos", "_t", "weight")).alias("_m")))
    txt = big.groupBy(*keys).agg(F.collect_list(F.struct("sent_pos", "sentence")).alias("_s"))
    packed = txt.join(mat, keys, "left")
    schema = T.StructType([big.schema[c] for c in keys] + [
        T.StructField("sent_pos", T.IntegerType()), T.StructField("sentence", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType()),
        T.StructField("converged", T.BooleanType())])
    out_cols = [*keys, "sent_pos", "sentence", "score", "rank", "converged"]

    def kernel(batches):
        for pdf in batches:
            out = {c: [] for c in out_cols}
            key_cols = [pdf[kk].tolist() for kk in keys]
            mats = pdf["_m"].tolist()
            for gi, srows in enumerate(pdf["_s"].tolist()):
                srows = sorted(srows, key=lambda x: x["sent_pos"])
                n = len(srows)
                pos_index = {srow["sent_pos"]: i for i, srow in enumerate(srows)}
                r, c, v = [], [], []
                for item in (mats[gi] if mats[gi] is not None else ()):
                    r.append(pos_index[item["sent_pos"]])
                    c.append(item["_t"])
                    v.append(item["weight"])
                try:
                    scores = _pagerank_sparse(np.asarray(r, dtype=np.int64), np.asarray(c, dtype=np.int64),
                                              np.asarray(v, dtype=np.float64), n)
                    converged = True
                except RuntimeError:
                    scores = np.full(n, np.nan)
                    converged = False
                # (score, sentence) both descending; scores rounded to 1e-12 so exact ties
                # (e.g. isolated sentences, all 1/n) are decided by the sentence, not float noise.
                rounded = np.round(scores, 12)
                order = sorted(range(n), key=lambda t: (rounded[t], srows[t]["sentence"]), reverse=True)[:k]
                for rank, t in enumerate(order, 1):
                    for kk, col in zip(keys, key_cols):
                        out[kk].append(col[gi])
                    out["sent_pos"].append(srows[t]["sent_pos"])
                    out["sentence"].append(srows[t]["sentence"])
                    out["score"].append(float(scores[t]))
                    out["rank"].append(rank)
                    out["converged"].append(converged)
            if out["rank"]:
                frame = pd.DataFrame(out)
                frame["sent_pos"] = frame["sent_pos"].astype(np.int32)
                frame["rank"] = frame["rank"].astype(np.int32)
                yield frame

    ranked = materialize(packed.mapInPandas(kernel, schema), "textrank-ranked")
    ok = ranked.where(F.col("converged")).drop("converged")
    failed = ranked.where(~F.col("converged")).select(*keys).distinct()
    fallback = rank_sentences(big.join(failed, keys, "left_semi"), keys, k, stop_words)
    out = small.unionByName(ok).unionByName(fallback)
    huge = sized.where((F.col("_n") > k) & (F.col("_n") > large))
    if huge.isEmpty():
        return out
    scores = materialize(large_pagerank(sentence_tfidf(huge.drop("_n"), keys, stop_words), huge, keys), "textrank-large")
    best = Window.partitionBy(*keys).orderBy(F.round("score", 12).desc(), F.col("sentence").desc())
    top = (huge.drop("_n").join(scores, [*keys, "sent_pos"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
           .select(*keys, "sent_pos", "sentence", "score", "rank"))
    failed = huge.drop("_n").join(scores.select(*keys).distinct(), keys, "left_anti")
    return out.unionByName(top).unionByName(rank_sentences(failed, keys, k, stop_words))


def key_terms(texts: DataFrame, keys: Sequence[str], k: int = 12, text_col: str = "text",
              order_col: str = "doc_order", stop_words=tx.STOP_UK, max_features: int = 1000) -> DataFrame:
    """Top 1- and 2-grams of the group's texts joined by a space.

    One document, so idf is constant and TF-IDF order is count order; ties by
    term ascending.  Bigrams may span two joined texts, as in the reference.
    Output (keys…, term, cnt, rank).
    """
    keys = list(keys)
    # The group's texts are joined first (bounded: its medoid texts); its n-grams are
    # sorted and counted inside that row, so that no n-gram becomes a row of its own
    # that an aggregate or a window would have to hold or spill.
    joined = texts.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order_col, text_col))),
                                 lambda s: s[text_col]), " ").alias("_joined"))
    grams = F.sort_array(tx.ngrams12(tx.tokens(F.col("_joined"), stop_words)))
    top = joined.select(*keys, F.posexplode(F.slice(tx.counted(grams), 1, min(k, max_features))).alias("_p", "_t"))
    return top.select(*keys, "_t.term", (-F.col("_t.minus")).alias("cnt"), (F.col("_p") + 1).alias("rank"))


def word_freq(docs: DataFrame, keys: Sequence[str], words_col, k: int = 10) -> DataFrame:
    """Top-k words per group by count (ties by word) from an array column."""
    keys = list(keys)
    c = (docs.select(*keys, F.explode(words_col).alias("word"))
         .groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("cnt")))
    w = Window.partitionBy(*keys).orderBy(F.col("cnt").desc(), F.col("word"))
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
