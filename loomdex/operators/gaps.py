"""Gaps of postings lists and their inverse. Lists are worked on in ranges of ``span`` docids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import SPAN, carried, within


def dgaps(postings: DataFrame, span: int = SPAN) -> DataFrame:
    """(term, docid, tf, dgap): distance to the term's document before; the first has its docid."""
    before = F.coalesce(F.lag("docid").over(within("docid")), F.col("_carry"), F.lit(0))
    return carried(postings, F.max("docid"), F.max, span).select(*postings.columns, (F.col("docid") - before).alias("dgap"))


def from_dgaps(gaps: DataFrame, order: str = "docid", span: int = SPAN) -> DataFrame:
    """(term, docid, tf) from gaps in the order of the list, a number from 1."""
    upto = within(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docid = F.sum("dgap").over(upto) + F.coalesce("_carry", F.lit(0))
    return carried(gaps, F.sum("dgap"), F.sum, span, order).select("term", docid.alias("docid"), "tf")


def _word_gap(*keys: str):
    own = Window.partitionBy(*keys).orderBy("position")
    return (F.col("position") - F.coalesce(F.lag("position").over(own), F.lit(0))).cast("bigint").alias("wgap")


def word_gaps(tokens: DataFrame) -> DataFrame:
    """(term, docid, position, wgap): distance to the occurrence before in the document; the first has its position."""
    return tokens.select("term", "docid", "position", _word_gap("term", "docid"))


def positional_gaps(tokens: DataFrame, span: int = SPAN) -> DataFrame:
    """(term, docid, position, wgap, dgap): pairs of a positional list.

    A term's first occurrence has its docid as dgap; the first in a later document has the distance plus 1; a repeat in
    the same document has 1.
    """
    rows = carried(tokens, F.max("docid"), F.max, span)
    before = F.coalesce(F.lag("docid").over(within("docid", "position")), F.col("_carry"))
    gap = F.when(before.isNull(), F.col("docid")).when(before == F.col("docid"), F.lit(1)).otherwise(F.col("docid") - before + 1)
    return rows.select("term", "docid", "position", _word_gap("term", "_range", "docid"), gap.cast("bigint").alias("dgap"))
