"""Lists that grow as documents arrive, with the head of each term kept beside them.

The head of a term is what the next posting of its list needs: how many it has and the last docid. Each batch counts its
documents, lays their postings behind the heads of their terms, and writes them with their gaps and their places in the
list, so what is written is the list's code in order of arrival and nothing written is read again but the heads. Heads lie
in runs, one for each batch with the terms that it changed; every ``FOLD``-th run holds all terms, so a batch reads at
most ``FOLD`` runs. Gaps and heads of a batch lie in folders of its number: a replayed batch writes over its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.index import postings

GAPS = "term string, docid bigint, tf bigint, dgap bigint, place bigint"
HEADS = "term string, df bigint, last_docid bigint"
#: Runs of heads after which one holds all terms.
FOLD = 8


def _heads(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """(term, df, last_docid) before a batch; None before the first."""
    first = max(batch_id // FOLD * FOLD - 1, 0)
    runs = [f"{path}/_heads/{k}" for k in range(first, batch_id)]
    if not runs:
        return None
    return spark.read.schema(HEADS).parquet(*runs).groupBy("term").agg(F.max("df").alias("df"), F.max("last_docid").alias("last_docid"))


def gaps(counted: DataFrame, heads: DataFrame | None) -> DataFrame:
    """(term, docid, tf, dgap, place from 1) of postings, counted on from heads. Docids must increase from batch to batch.

    Heads and postings lie on one line for each term, the head first: one exchange and one sort, and no join.
    """
    line = counted.select("term", "docid", "tf", F.lit(None).cast("bigint").alias("df"))
    if heads is not None:
        line = line.unionByName(heads.select("term", F.col("last_docid").alias("docid"), F.lit(None).cast("bigint").alias("tf"), "df"))
    own = Window.partitionBy("term").orderBy(F.col("df").desc_nulls_last(), "docid")
    before = F.coalesce(F.lag("docid").over(own), F.lit(0))
    base = F.first("df").over(own)  # of the head, if there is one
    place = F.row_number().over(own) + F.coalesce(base - 1, F.lit(0))
    line = line.select("term", "docid", "tf", before.alias("_before"), place.cast("bigint").alias("place")).where("tf IS NOT NULL")
    late = F.raise_error(F.concat(F.lit("docids must increase: "), F.col("docid").cast("string"), F.lit(" after "), F.col("_before").cast("string"))).cast("bigint")
    return line.select("term", "docid", "tf", F.when(F.col("docid") > F.col("_before"), F.col("docid") - F.col("_before")).otherwise(late).alias("dgap"), "place")


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write the gaps of a batch of (docid, text_id, tokens) and the heads after it; the same batch again changes nothing."""
    spark, before = batch.sparkSession, _heads(batch.sparkSession, path, batch_id)
    gaps(postings(batch), before).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    written = spark.read.schema(GAPS).parquet(f"{path}/batch_id={batch_id}")
    changed = written.groupBy("term").agg(F.max("place").alias("df"), F.max("docid").alias("last_docid"))
    if before is not None and batch_id % FOLD == FOLD - 1:
        changed = before.unionByName(changed).groupBy("term").agg(F.max("df").alias("df"), F.max("last_docid").alias("last_docid"))
    changed.write.mode("overwrite").parquet(f"{path}/_heads/{batch_id}")


def start_gaps(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write ``gaps`` of everything that is there, batch by batch; a replayed batch is in the files once."""
    writer = stream.writeStream.foreachBatch(lambda b, i: write_batch(b, i, path))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    """What ``start_gaps`` has written."""
    return spark.read.schema(f"{GAPS}, batch_id bigint").parquet(path).drop("batch_id")
