"""Lookups of terms and postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .ranges import SPAN


def term_scan(postings: DataFrame, term: str) -> DataFrame:
    """Postings of one term. The filter reaches the Parquet scan, where files sorted by term skip the rest."""
    return postings.where(F.col("term") == term)


def next_geq(postings: DataFrame, targets: DataFrame, span: int = SPAN) -> DataFrame:
    """First posting at or after each target: (term, target, docid, tf), null when there is none.

    targets: (term, target), in any number. Targets and the postings of their terms are laid on one line for each term,
    cut into ranges of ``span`` docids, and walked backwards once, so the work is that of a sort and no target meets
    a posting twice. Where a range has none left, the answer is the first posting of a later one: one row for a range.
    """
    asked = targets.groupBy("term", "target").agg(F.count("*").alias("_n"))  # repeated targets travel once
    there = postings.join(asked.select("term").distinct(), "term", "left_semi")
    posted = there.select("term", F.col("docid").alias("_at"), F.struct("docid", "tf").alias("_p"), F.lit(0).cast("bigint").alias("_n"))
    line = posted.unionByName(asked.select("term", F.col("target").alias("_at"), "_n"), allowMissingColumns=True).withColumn("_range", F.expr(f"_at div {span}"))
    back = Window.partitionBy("term", "_range").orderBy(F.col("_at").desc(), "_n")  # a posting before the targets at its place
    met = F.last("_p", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    line = line.select("term", "_range", "_at", "_n", met.alias("_p"), F.lead("_n").over(back).isNull().alias("_lowest")).where("_n > 0 OR _lowest")
    line = kept(line, "skips")  # targets and one row for a range, without the postings
    later = Window.partitionBy("term").orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ahead = line.where("_lowest").select("term", "_range", F.last("_p", ignorenulls=True).over(later).alias("_later")).where("_later IS NOT NULL")
    found = line.where("_n > 0").join(ahead, ["term", "_range"], "left").withColumn("_p", F.coalesce("_p", "_later"))
    return found.select("term", F.col("_at").alias("target"), F.col("_p.docid").alias("docid"), F.col("_p.tf").alias("tf"), F.explode(F.expr("sequence(1L, _n)")).alias("_copy")).drop("_copy")


def explode_terms(queries: DataFrame) -> DataFrame:
    """(query_ord, qid, term), each term of a query once."""
    return queries.select("query_ord", "qid", F.explode(F.array_distinct("terms")).alias("term"))


def resolve(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(query_ord, qid, term, df) of the terms that the lexicon has; the others are dropped."""
    return explode_terms(queries).join(lexicon.select("term", "df"), "term").select("query_ord", "qid", "term", "df")


def unknown_terms(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(query_ord, qid, term) of the terms that the lexicon lacks."""
    return explode_terms(queries).join(lexicon, "term", "left_anti").select("query_ord", "qid", "term")
