"""Ranks and running sums over groups of any size, without one task for a group or for the whole table.

Rows are dealt to fine buckets by a key that grows with the order, the buckets' totals are summed in a small table, and
each bucket is finished on its own. A bucket is a fixed share of a group, so a group with a third of all rows is spread
over as many tasks as its size asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest value of ``seeded`` plus one.
SPAN = 1 << 60
#: Rows that one bucket should have.
BUCKET_ROWS = 4000


def seeded(seed: str, *columns: str) -> Column:
    """A number from 0 to 2^60 - 1 that a seed and the columns decide: the first 15 hexadecimal digits of an MD5."""
    said = F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("bigint")


def running(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group that come before, in (bucket, order...).

    ``bucket`` must grow with the order. The table of buckets is a window over groups; it has one row for some
    thousands of rows, and its own prefix sums are taken in two levels, so that it stays small at any size.
    """
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    coarse = (F.col(bucket) / F.lit(1024)).cast("bigint")
    totals = totals.withColumn("_coarse", F.floor(coarse))
    tops = totals.groupBy(*group, "_coarse").agg(F.sum("_sum").alias("_top"))
    within = Window.partitionBy(*group, "_coarse").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1) if group else Window.partitionBy(F.lit(0)).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*group, "_coarse", F.coalesce(F.sum("_top").over(across), F.lit(0)).alias("_above"))
    starts = totals.join(tops, [*group, "_coarse"]) if group else totals.join(tops, "_coarse")
    starts = starts.select(*group, bucket, (F.coalesce(F.sum("_sum").over(within), F.lit(0)) + F.col("_above")).alias("_start"))
    own = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(starts, [*group, bucket])
        .withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(own), F.lit(0)))
        .drop("_start")
    )
