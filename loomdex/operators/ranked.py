"""Ranked disjunction: TF-IDF, top k of every query of a workload in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.weights import TFIDF, Ranker
from .boolean import hits, named
from .index import Index
from .lookup import resolve

#: Scores are compared after rounding to so many places, so that equal ones tie on any partitioning.
PLACES = 6


def scores(queries: DataFrame, index: Index, n: int | None = None, ranker: Ranker = TFIDF) -> DataFrame:
    """(query_ord, qid, docid, score) with a score above 0. n: number of documents for idf, else that of the index."""
    known = resolve(queries, index.lexicon)
    total = index.n_docs.withColumnRenamed("n", "_n") if n is None else known.sparkSession.range(1).select(F.lit(n).cast("bigint").alias("_n"))
    known = known.crossJoin(total).select("query_ord", "term", ranker.idf(F.col("_n"), F.col("df")).alias("_idf"))  # one row
    weight = (ranker.tf(F.col("tf")) * F.col("_idf")).cast("double")
    s = hits(known, index).groupBy("query_ord", "docid").agg(F.round(F.sum(weight), PLACES).alias("score"))
    return named(s.where("score > 0"), queries)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """(query_ord, qid, rank from 0, docid, score): the best k of each query, ties by docid. k = 0 gives no rows."""
    if k <= 0:
        return scored.select("query_ord", "qid", F.lit(0).cast("bigint").alias("rank"), "docid", "score").limit(0)
    order = Window.partitionBy("query_ord").orderBy(F.col("score").desc(), "docid")
    ranked = scored.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k)
    return ranked.select("query_ord", "qid", (F.col("_place") - 1).cast("bigint").alias("rank"), "docid", "score")


def ranked(queries: DataFrame, index: Index, k: int = 10, n: int | None = None, ranker: Ranker = TFIDF) -> DataFrame:
    """Top k of each query."""
    return top_k(scores(queries, index, n, ranker), k)


def returned_count(queries: DataFrame, index: Index, k: int = 10, n: int | None = None) -> DataFrame:
    """(query_ord, qid, returned): rows that a ranked query gives, at most k."""
    per = scores(queries, index, n).groupBy("query_ord", "qid").agg(F.count("*").alias("_c"))
    return per.select("query_ord", "qid", F.least(F.col("_c"), F.lit(k)).cast("bigint").alias("returned")).where("returned > 0")


def threshold(scored: DataFrame, k: int) -> DataFrame:
    """(query_ord, threshold): the score that another document must exceed to enter; 0 until k are there."""
    t = top_k(scored, k).groupBy("query_ord").agg(F.count("*").alias("_c"), F.min("score").alias("_s"))
    return t.select("query_ord", F.when(F.col("_c") >= k, F.col("_s")).otherwise(F.lit(0.0)).alias("threshold"))


def trec_run(run: DataFrame, tag: str = "loomdex") -> DataFrame:
    """Lines of a TREC run: qid Q0 docid rank score tag, with the rank from 0."""
    return run.select("query_ord", "rank", F.concat_ws(" ", "qid", F.lit("Q0"), F.col("docid").cast("string"), F.col("rank").cast("string"), F.format_string("%.6f", "score"), F.lit(tag)).alias("line"))
