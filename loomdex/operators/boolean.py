"""Boolean queries over a whole workload in one plan.

Unknown terms are dropped, so ``the zzz`` asks for ``the``; a query without a known term matches nothing and has no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .index import Index
from .lookup import resolve


def known_terms(queries: DataFrame, index: Index) -> DataFrame:
    """(query_ord, qid, term, df, n_found) of the known terms of a workload."""
    return resolve(queries, index.lexicon).withColumn("n_found", F.count("*").over(Window.partitionBy("query_ord")))


def hits(known: DataFrame, index: Index) -> DataFrame:
    """(docid, tf) and the columns of ``known`` for each posting of each known term of each query.

    The known terms of a workload are few beside the postings. They are written first, so that Spark knows their size: it
    sends them to the postings where that allows it, and then parts by docid stay as they are; else it shuffles by term.
    """
    return index.postings.join(kept(known, "known_terms"), "term")


def named(found: DataFrame, queries: DataFrame) -> DataFrame:
    """``found`` with the qid of its query_ord, behind it. Hits are grouped by numbers only."""
    names = queries.groupBy("query_ord").agg(F.first("qid").alias("qid"))
    return found.join(names, "query_ord").select("query_ord", "qid", *[c for c in found.columns if c != "query_ord"])


def _all_of(queries: DataFrame, index: Index) -> DataFrame:
    met = hits(known_terms(queries, index).select("query_ord", "term", "n_found"), index)
    return met.groupBy("query_ord", "docid").agg(F.count("*").alias("_k"), F.first("n_found").alias("_n")).where("_k = _n").select("query_ord", "docid")


def _any_of(queries: DataFrame, index: Index) -> DataFrame:
    return hits(resolve(queries, index.lexicon).select("query_ord", "term"), index).select("query_ord", "docid").distinct()


def and_docs(queries: DataFrame, index: Index) -> DataFrame:
    """(query_ord, qid, docid) of the documents that hold all known terms."""
    return named(_all_of(queries, index), queries)


def or_docs(queries: DataFrame, index: Index) -> DataFrame:
    """(query_ord, qid, docid) of the documents that hold any term."""
    return named(_any_of(queries, index), queries)


def and_count(queries: DataFrame, index: Index) -> DataFrame:
    """(query_ord, qid, matches) of the queries with a match."""
    return named(_all_of(queries, index).groupBy("query_ord").agg(F.count("*").alias("matches")), queries)


def or_count(queries: DataFrame, index: Index) -> DataFrame:
    """(query_ord, qid, matches) of the queries with a match."""
    return named(_any_of(queries, index).groupBy("query_ord").agg(F.count("*").alias("matches")), queries)


def and_chain(terms: list[str], index: Index) -> DataFrame:
    """(docid) of one query, as semi joins from the rarest known term to the most frequent."""
    known = index.lexicon.where(F.col("term").isin(terms)).select("term", "df").collect()  # the terms of one query
    order = [r["term"] for r in sorted(known, key=lambda r: (r["df"], r["term"]))]
    lists = [index.postings.where(F.col("term") == t).select("docid") for t in order]
    if not lists:
        return index.postings.select("docid").limit(0)
    out = lists[0]
    for other in lists[1:]:
        out = out.join(other, "docid", "left_semi")
    return out


def and_profile(queries: DataFrame, index: Index) -> DataFrame:
    """(query_ord, qid, i, term, df, next_geq_count): terms from rare to frequent, and the probes each one gets.

    The rarest list is walked (its count is its df); the list at place i is probed once for every document that all
    rarer ones hold, which are the documents whose terms cover the places before i.
    """
    known = resolve(queries, index.lexicon)
    place = Window.partitionBy("query_ord").orderBy("df", "term")
    known = known.withColumn("i", (F.row_number().over(place) - 1).cast("bigint"))
    posts = index.postings.select("term", "docid").join(known.select("query_ord", "term", "i"), "term")
    # places of a document in order; the prefix it covers ends at the first gap
    held = posts.groupBy("query_ord", "docid").agg(F.sort_array(F.collect_list("i")).alias("at"))  # a list of the query's terms
    covered = held.select("query_ord", F.size(F.filter(F.transform("at", lambda x, k: x == k), lambda x: x)).alias("_same"), "at")
    covered = covered.select("query_ord", F.when(F.array_contains(F.transform("at", lambda x, k: x == k), False), F.expr("array_position(transform(at, (x, k) -> x = k), false) - 1")).otherwise(F.col("_same")).cast("bigint").alias("_upto"))
    reached = covered.where("_upto > 0").groupBy("query_ord", "_upto").agg(F.count("*").alias("_docs"))
    probes = known.join(reached, "query_ord", "left").groupBy("query_ord", "qid", "i", "term", "df").agg(F.coalesce(F.sum(F.when(F.col("_upto") >= F.col("i"), F.col("_docs"))), F.lit(0)).alias("_probes"))
    return probes.select("query_ord", "qid", "i", "term", "df", F.when(F.col("i") == 0, F.col("df")).otherwise(F.col("_probes")).alias("next_geq_count"))
