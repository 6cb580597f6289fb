"""Docstream and query files: one record per line, tokens between white space, the first of them an id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import body, external_id, tokenize


#: Splits of files whose counts are sent to all executors, at some hundred bytes each, and the parts of a split beyond that.
SPLITS, SALTS = 200_000, 8


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files with their dense numbers from 1, in the order of file names and of lines.

    Only ``\\n`` ends a line; blank lines count. Splits of files are numbered by a count for each split: a line's number
    is the lines of earlier splits plus its place in its own. The counts are sent to all executors, so that no text is
    shuffled or sorted, up to ``SPLITS`` of them; beyond that the lines meet them in a salted join, which moves the text.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_seq"))
    splits = raw.groupBy("_file", "_at").agg(F.count("*").alias("_lines"), F.min("_seq").alias("_first"))
    before = Window.partitionBy(F.lit(0)).orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0)))  # one row for a split
    # each split is in one partition and begins one file or ends where another begins
    if len(raw.inputFiles()) + raw.rdd.getNumPartitions() <= SPLITS:
        numbered = raw.join(F.broadcast(splits), ["_file", "_at"])
    else:
        salted = raw.withColumn("_salt", F.pmod("_seq", F.lit(SALTS)).cast("int"))
        copies = splits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        numbered = salted.join(copies, ["_file", "_at", "_salt"])
    return numbered.select((F.col("_before") + F.col("_seq") - F.col("_first") + 1).alias("line"), "value")


def spread(df: DataFrame, most: int = 8) -> DataFrame:
    """Deal a scan of very few splits over the cores; a scan of ``most`` splits or more stays as it is.

    A small file may be one row group, which one task would read and process alone. Only such a file moves.
    """
    splits = df.rdd.getNumPartitions()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if splits < min(most, cores) else df


def read_docstream(spark: SparkSession, path: str | list[str], max_token_bytes: int | None = None) -> DataFrame:
    """(docid, text_id, tokens): one document for each line, blank lines included; the id is not indexed."""
    tokens = tokenize(F.col("value"), max_token_bytes)
    d = lines(spark, path).select(F.col("line").alias("docid"), tokens.alias("_all"))
    return d.select("docid", external_id(F.col("_all")).alias("text_id"), body(F.col("_all")).alias("tokens"))


def read_queries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(query_ord, qid, terms): one query for each line, terms distinct. Equal qids stay separate queries."""
    d = lines(spark, path).select(F.col("line").alias("query_ord"), tokenize(F.col("value")).alias("_all"))
    return d.select("query_ord", external_id(F.col("_all")).alias("qid"), F.array_distinct(body(F.col("_all"))).alias("terms"))


def from_table(df: DataFrame, docid: str = "doc_id", text: str = "text", first: int = 0) -> DataFrame:
    """A table with one document per row: (docid, text_id, tokens), docid counted from 1. The text holds no id."""
    return df.select((F.col(docid) - first + 1).cast("bigint").alias("docid"), F.col(docid).cast("string").alias("text_id"), tokenize(F.col(text)).alias("tokens"))


def queries_from_table(df: DataFrame, qid: str = "item_id", text: str = "text") -> DataFrame:
    """A table with one query per row; the order of queries is that of their ids."""
    return df.select(F.col(qid).cast("bigint").alias("query_ord"), F.col(qid).cast("string").alias("qid"), F.array_distinct(tokenize(F.col(text))).alias("terms"))


def query_stats(queries: DataFrame) -> DataFrame:
    """Number of queries and mean number of distinct terms."""
    return queries.agg(F.count("*").alias("n_queries"), F.avg(F.size("terms")).alias("mean_terms"))
