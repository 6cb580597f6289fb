"""Postings lists in ranges of docids, so that a list of any length is the work of many tasks.

A range needs of the ones before only a number (their last docid, their count, their sum). That number is worked out
over one row for each range of a list and joined to the rows; lists within one range, as nearly all are, need no carry
and leave no row for the join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: Docids in a range: at most so many postings of a term meet in one sort.
SPAN = 1 << 20


def carried(rows: DataFrame, of_range: Column, over: Callable[[str], Column], span: int = SPAN, at: str = "docid") -> DataFrame:
    """The rows (term, ``at``, ...) with ``_range`` and ``_carry``: ``over`` of ``of_range`` in the term's earlier ranges.

    The carry is null in a list's first range. The rows are written first and read for what the ranges need; where all of
    them lie in one range, which a look at their last place tells, no carry is worked out and nothing moves for it.
    """
    rows = kept(rows, "listed").withColumn("_range", F.floor((F.col(at) - 1) / span))
    if (rows.agg(F.max("_range") - F.min("_range")).first()[0] or 0) == 0:
        return rows.withColumn("_carry", F.lit(None).cast("bigint"))
    earlier = Window.partitionBy("term").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("term", "_range").agg(of_range.alias("_of"))
    ranges = ranges.select("term", "_range", over("_of").over(earlier).alias("_carry")).where("_carry IS NOT NULL")
    return rows.join(ranges, ["term", "_range"], "left")


def within(*order: str) -> WindowSpec:
    """Rows of a range of a list in order."""
    return Window.partitionBy("term", "_range").orderBy(*order)


def placed(rows: DataFrame, order: list[str], **sizes: Column) -> DataFrame:
    """Add, for each of ``sizes``, its sum over all rows before, in ``order``.

    The rows are cut into ranges of their order; a range counts on from the sums of the ones before, a row for each.
    """
    cut = kept(rows.withColumns({f"_{n}": c.cast("bigint") for n, c in sizes.items()}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("_range").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sizes])
    sums = sums.select("_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_above_{n}") for n in sizes])  # a row for each range
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(F.broadcast(sums), "_range")
    return out.select(*rows.columns, *[(F.col(f"_above_{n}") + F.coalesce(F.sum(f"_{n}").over(own), F.lit(0))).alias(n) for n in sizes])
