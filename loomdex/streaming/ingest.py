"""Streaming ingestion: documents become searchable when their micro-batch commits.

Each batch writes its own folders of documents, postings and lexicon rows, named by the batch, and the numbers it gave
out. A batch that is replayed after a failure overwrites the same folders with the same numbers, so nothing counts
twice. Order of documents is order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import body, external_id, tokenize
from ..operators.index import Index, doc_stats, lexicon, postings
from ..operators.workload import with_totals
from ..sources.store import move

#: Documents of a file of ``arrivals``.
ARRIVING = 2048
_LEDGER = "batch_id bigint, base bigint, n bigint, postings bigint, words bigint"


def docstream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines of text files as they arrive, with where they stand."""
    reader = spark.readStream.format("text").option("lineSep", "\n")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))


def arrivals(documents: DataFrame, path: str, n: int, each: int = ARRIVING) -> Iterator[DataFrame]:
    """(docid, text_id, tokens) as a stream of which a further n-th, by docid, has come whenever the next is asked for.

    The documents are worked out once, all parts side by side, into files of at most ``each``, so that a part is work for
    every core wherever it lay; a part then arrives by the name of its folder.
    """
    spark, top = documents.sparkSession, documents.agg(F.max("docid")).first()[0] or 0
    part = F.coalesce(*[F.when(F.col("docid") <= top * (k + 1) // n, k) for k in range(n)])
    documents.withColumn("part", part).write.partitionBy("part").option("maxRecordsPerFile", each).parquet(f"{path}/coming")
    for k in range(n):
        if not move(spark, f"{path}/coming/part={k}", f"{path}/in/{k}"):
            documents.limit(0).write.parquet(f"{path}/in/{k}")  # no document in this part
        yield spark.readStream.schema(documents.schema).parquet(f"{path}/in/*")


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    """Numbers given out by each committed batch."""
    try:
        return spark.read.schema(_LEDGER).option("recursiveFileLookup", "true").parquet(f"{path}/ledger")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], _LEDGER)
        raise


def numbered_lines(batch: DataFrame, base: int) -> DataFrame:
    """(docid, text_id, tokens) of the lines of a batch, numbered on from ``base``."""
    raw = batch.withColumn("_seq", F.monotonically_increasing_id())
    splits = raw.groupBy("_file", "_at").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    before = Window.partitionBy(F.lit(0)).orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # a row for each split of the batch
    d = raw.join(splits, ["_file", "_at"]).select((F.lit(base) + F.col("_before") + F.col("_seq") - F.col("_first") + 1).alias("docid"), tokenize(F.col("value")).alias("_all"))
    return d.select("docid", external_id(F.col("_all")).alias("text_id"), body(F.col("_all")).alias("tokens"))


def write_batch(batch: DataFrame, batch_id: int, path: str, numbered: bool = False) -> None:
    """Add one micro-batch to the store; the same batch again changes nothing."""
    spark = batch.sparkSession
    batch = batch.persist()
    try:
        earlier = _ledger(spark, path).where(F.col("batch_id") < batch_id).agg(F.max(F.col("base") + F.col("n")).alias("top")).first()["top"]
        base = earlier or 0
        docs = batch if numbered else numbered_lines(batch, base)
        # documents and their totals in one pass; postings once, and the lexicon from what was written
        stats, totals = with_totals(doc_stats(docs), f"batch-{batch_id}")
        stats.write.mode("overwrite").parquet(f"{path}/documents/batch_id={batch_id}")
        postings(docs).write.mode("overwrite").parquet(f"{path}/postings/batch_id={batch_id}")
        written = spark.read.parquet(f"{path}/postings/batch_id={batch_id}")
        lexicon(written).write.mode("overwrite").parquet(f"{path}/lexicon/batch_id={batch_id}")
        seen = totals.get
        entry = (batch_id, base, seen["documents"], seen["postings"] or 0, seen["words"] or 0)
        spark.createDataFrame([entry], _LEDGER).write.mode("overwrite").parquet(f"{path}/ledger/batch_id={batch_id}")
    finally:
        batch.unpersist()


def start(stream: DataFrame, path: str, checkpoint: str, numbered: bool = False, interval: str | None = None) -> StreamingQuery:
    """Ingest a stream into the store at ``path``: everything that is there, or on from now every ``interval``.

    stream: ``docstream`` lines, or with ``numbered`` rows (docid, text_id, tokens).
    """
    writer = stream.writeStream.foreachBatch(lambda b, i: write_batch(b, i, path, numbered)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def dry_run(stream: DataFrame, checkpoint: str) -> StreamingQuery:
    """Read and tokenize a stream and keep nothing."""
    tokens = stream.select(F.size(tokenize(F.col("value"))).alias("n"))
    return tokens.writeStream.format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_index(spark: SparkSession, path: str) -> Index:
    """The index of all batches in the ledger, which is written last: of a batch that is being written or failed half-way
    nothing is seen, in no table. Lexicon rows of the batches are summed when read."""
    done = F.broadcast(_ledger(spark, path).select("batch_id").distinct())  # a row for each batch
    part = lambda name: spark.read.parquet(f"{path}/{name}").join(done, "batch_id", "left_semi").drop("batch_id")
    lexicon = part("lexicon").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("last_docid").alias("last_docid"))
    return Index(part("documents"), part("postings"), lexicon)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """One row: documents, postings, words of all committed batches, from the ledger alone."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return _ledger(spark, path).agg(total("n", "documents"), total("postings", "postings"), total("words", "words"))


def compact_lexicon(spark: SparkSession, path: str, to: str) -> None:
    """Write the summed lexicon of all batches to another folder."""
    live_index(spark, path).lexicon.repartitionByRange("term").sortWithinPartitions("term").write.parquet(to)


def running_df(stream: DataFrame) -> DataFrame:
    """(term, df) over a stream of (docid, text_id, tokens), kept in the state store, one key for a term."""
    return stream.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def start_df(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep ``running_df`` of a stream at ``path``: each batch writes the terms whose number changed, a replay the same ones."""

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = running_df(stream).writeStream.outputMode("update").foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_df(spark: SparkSession, path: str) -> DataFrame:
    """(term, df) of ``start_df``; a term's number only grows, so its largest is its last."""
    return spark.read.schema("term string, df bigint").parquet(path).groupBy("term").agg(F.max("df").alias("df"))
