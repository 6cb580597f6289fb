"""Order statistics by rank: the element floor(p * n / 100) of the sorted values, counted from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import placed
from ..sources.scratch import kept


def rank_of(p: int, n: Column) -> Column:
    """Index of percentile p among n sorted values."""
    return F.floor(F.lit(p) * n / 100).cast("bigint")


def percentiles(df: DataFrame, value: str, ps: tuple[int, ...] = (50, 90, 95, 99)) -> DataFrame:
    """One row: n, mean, min, max and p<k> for each k; nulls where there are no values.

    Values are counted per distinct value first. The counts are cut into ranges of values, each of which counts on from
    the ones below, so the value at a rank is found in its range and no task sees all distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    ranked = kept(placed(counts, ["v"], below=F.col("c")), "value_counts")
    total = ranked.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("_n"))
    at = [F.min(F.when(F.col("below") + F.col("c") > rank_of(p, F.col("_n")), F.col("v"))).alias(f"p{p}") for p in ps]
    met = ranked.crossJoin(total)  # one row
    n = F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("n")
    return met.agg(n, (F.sum(F.col("v").cast("double") * F.col("c")) / F.sum("c")).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), *at)
