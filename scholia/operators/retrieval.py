"""Lexical and dense search, and their fusion, as DataFrame plans."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.functions.tokens import token_rows

K1, B = 1.5, 0.75


def postings(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(doc_id, term, tf, doc_len): one row per distinct term of a document. Documents without terms have none."""
    each = token_rows(docs.withColumnRenamed(id_column, "doc_id"), "doc_id", text)
    tf = each.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return tf.withColumn("doc_len", F.sum("tf").over(Window.partitionBy("doc_id")))


def bm25_scores(posts: DataFrame, queries: DataFrame, n_docs: int, avg_len: float) -> DataFrame:
    """(query_id, doc_id, score): BM25 over the greatest score that the query could have, at most 1.

    ``queries`` has query_id and text. The greatest score is the sum of idf over
    the query's distinct terms, those of no document included. Only the postings
    of query terms are joined; the document frequency is counted on them.
    """
    q = token_rows(queries, "query_id", "text").distinct()
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    held = q.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    held = held.withColumn("idf", idf)
    most = held.groupBy("query_id").agg(F.sum("idf").alias("most"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.lit(avg_len)))
    raw = held.join(posts, "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("raw"))
    return raw.join(most, "query_id").select("query_id", "doc_id", F.least(F.lit(1.0), F.when(F.col("most") > 0, F.col("raw") / F.col("most")).otherwise(0.0)).alias("score"))


def top_k(scores: DataFrame, key: str, by: str, tie: str, k: int) -> DataFrame:
    """The k best rows per key, ties to the smaller ``tie``, with their rank."""
    w = Window.partitionBy(key).orderBy(F.desc(by), F.asc(tie))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked(scores: DataFrame, key: str, by: str, tie: str) -> DataFrame:
    """(key, tie, rank): all rows of a positive score, ranked per key, ties to the smaller ``tie``."""
    w = Window.partitionBy(key).orderBy(F.desc(by), F.asc(tie))
    return scores.where(F.col(by) > 0).select(key, tie, F.row_number().over(w).alias("rank"))


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = 20_000) -> DataFrame:
    """(query_id, doc_id, score): exact inner products, the k best per query.

    ``vectors`` (doc_id, embedding) and ``queries`` (query_id, embedding) are
    cut into blocks of at most about ``block_rows``; each pair of blocks is one
    group, in which a matrix product leaves the k best of each query, so what
    is shuffled after that is k rows per query and block. Null vectors are left
    out; all others must have one length.
    """
    n, m = vectors.count(), queries.count()
    nb, mb = max(1, -(-n // block_rows)), max(1, -(-m // block_rows))
    v = vectors.where("embedding IS NOT NULL").select("doc_id", "embedding", F.pmod(F.xxhash64("doc_id"), F.lit(nb)).alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(mb - 1))).alias("qb"))
    q = queries.where("embedding IS NOT NULL").select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(mb)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nb - 1).cast("bigint"))).alias("vb"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        ids = left["doc_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], np.stack(left["embedding"].to_numpy()[order]).astype(np.float64)
        qid, out = right["query_id"].to_numpy(), []
        y = np.stack(right["embedding"].to_numpy()).astype(np.float64)
        for at in range(0, len(qid), 512):
            s = y[at : at + 512] @ x.T
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query_id": np.repeat(qid[at : at + 512], best.shape[1]), "doc_id": ids[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()}))
        return pd.concat(out)

    pairs = v.groupBy("vb", "qb").cogroup(q.groupBy("vb", "qb")).applyInPandas(run, "query_id bigint, doc_id bigint, score double")
    return top_k(pairs, "query_id", "score", "doc_id", k)


def packed(rows: DataFrame, key: str) -> DataFrame:
    """(key, terms, weights): one row per key out of rows of ``key``, ``term`` and ``w``; terms by their 64-bit hash."""
    return rows.groupBy(key).agg(F.collect_list(F.xxhash64("term")).alias("terms"), F.collect_list("w").alias("weights"))


def sparse_top_k(docs: DataFrame, queries: DataFrame, k: int, block_docs: int = 100_000, block_queries: int = 1_000) -> DataFrame:
    """(query_id, doc_id, score): sums of query weight times document weight over shared terms, the k best per query with a positive score.

    ``docs`` (doc_id, terms, weights) and ``queries`` (query_id, terms, weights)
    are ``packed``: one row with its distinct terms each, null weights in neither. Both
    are cut into blocks; in each pair of blocks the scores of a query are one
    vector over the block's documents, to which the postings of its terms are
    added, so pairs of a query and a document exist only there: what is shuffled
    after it is k rows per query and block. Terms meet by their 64-bit hash.
    Scores are rounded to nine decimals, ties go to the smaller doc_id.
    """
    n, m = docs.count(), queries.count()
    nb, mb = max(1, -(-n // block_docs)), max(1, -(-m // block_queries))
    each = lambda b: F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    block = lambda c, b: F.pmod(F.xxhash64(c), F.lit(b)).cast("int")
    d = docs.select("doc_id", "terms", "weights", block("doc_id", nb).alias("vb"), each(mb).alias("qb"))
    q = queries.select("query_id", "terms", "weights", block("query_id", mb).alias("qb"), each(nb).alias("vb"))

    def rows(names: list, found: list, scores: list) -> pd.DataFrame:
        return pd.DataFrame({"query_id": pd.Series(names, dtype=object), "doc_id": pd.Series(found, dtype=object), "score": pd.Series(scores, dtype="float64")})

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return rows([], [], [])
        left = left.sort_values("doc_id", ignore_index=True)
        ids = left["doc_id"].to_numpy(object)
        doc = np.repeat(np.arange(len(ids)), [len(t) for t in left["terms"]])
        term, weight = np.concatenate(left["terms"].to_list()), np.concatenate(left["weights"].to_list()).astype(np.float64)
        order = np.argsort(term, kind="stable")
        doc, weight, term = doc[order], weight[order], term[order]
        names, found, scores = [], [], []
        for query, terms, weights in zip(right["query_id"], right["terms"], right["weights"]):
            score = np.zeros(len(ids))
            lo, hi = np.searchsorted(term, terms, "left"), np.searchsorted(term, terms, "right")
            for a, b, w in zip(lo, hi, weights):
                if a < b:
                    score[doc[a:b]] += w * weight[a:b]
            score = np.round(score, 9)
            held = np.flatnonzero(score > 0)
            if len(held) > k:
                least = np.partition(score[held], len(held) - k)[len(held) - k]
                held = held[score[held] >= least]
                held = held[np.lexsort((held, -score[held]))[:k]]
            names += [query] * len(held)
            found += ids[held].tolist()
            scores += score[held].tolist()
        return rows(names, found, scores)

    pairs = d.groupBy("vb", "qb").cogroup(q.groupBy("vb", "qb")).applyInPandas(run, "query_id string, doc_id string, score double")
    return top_k(pairs.withColumn("score", F.round("score", 9)), "query_id", "score", "doc_id", k)


def bm25_weights(posts: DataFrame, queries: DataFrame, n_docs: int, avg_len: float) -> tuple[DataFrame, DataFrame]:
    """The BM25 score as weights: of terms in documents, and of terms in queries over the greatest score that the query could have."""
    q = token_rows(queries, "query_id", "text").distinct()
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    held = q.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    held = held.withColumn("w", F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    # Over the sum of the weights, which is the greatest score that a query could have.
    asked = packed(held, "query_id").withColumn("most", F.aggregate("weights", F.lit(0.0), lambda a, x: a + x))
    asked = asked.select("query_id", "terms", F.transform("weights", lambda x: F.when(F.col("most") > 0, x / F.col("most")).otherwise(0.0)).alias("weights"))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.lit(avg_len)))
    return packed(posts.select("doc_id", "term", part.alias("w")), "doc_id"), asked


def cosine_weights(docs: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cosine of term counts as weights: counts over the length of their vector."""
    def weighed(df: DataFrame, key: str) -> DataFrame:
        tf = token_rows(df, key, "text").groupBy(key, "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
        norm = tf.groupBy(key).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
        return packed(tf.join(norm, key).select(key, "term", (F.col("tf") / F.col("norm")).alias("w")), key)

    return weighed(docs, "doc_id"), weighed(queries, "query_id")


def fused(ranked: DataFrame, key: str, doc: str, rank: str = "rank", weight: str | None = None, k: float = 60.0) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (k + rank) over the lists of a key."""
    w = F.col(weight) if weight else F.lit(1.0)
    return ranked.groupBy(key, doc).agg(F.sum(w / (F.lit(k) + F.col(rank))).alias("fused"))


def token_cosine(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, cosine) of term counts, for pairs that share a term."""
    def counted(df: DataFrame, key: str) -> DataFrame:
        return token_rows(df, key, "text").groupBy(key, "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))

    d, q = counted(docs, "doc_id"), counted(queries, "query_id")
    norm = lambda df, key, name: df.groupBy(key).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias(name))
    dot = d.join(q.withColumnRenamed("tf", "qtf"), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("tf") * F.col("qtf")).alias("dot"))
    return dot.join(norm(d, "doc_id", "dn"), "doc_id").join(norm(q, "query_id", "qn"), "query_id").select("query_id", "doc_id", (F.col("dot") / (F.col("dn") * F.col("qn"))).alias("cosine"))
