"""Exports: canonical inverted-index files and the interleaved gap stream. Exported docids count from 0."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bytefiles import local_path, read_sequences, read_stretches, write_bytes
from ..sources.docstream import lines as text_lines
from ..sources.scratch import kept
from .gaps import dgaps
from .ordered import laid
from .ranges import SPAN, carried, placed, within


def _lists(postings: DataFrame, value: str, span: int = SPAN) -> DataFrame:
    """(term, k, value): the length of each list at k = 0, then its values at k = 1, 2, ... in order of docid."""
    place = F.row_number().over(within("docid")) + F.coalesce("_carry", F.lit(0))
    rows = carried(postings, F.count("*"), F.sum, span)
    items = rows.select("term", place.cast("bigint").alias("k"), F.col(value).cast("bigint").alias("value"))
    counts = rows.groupBy("term").agg(F.count("*").alias("value")).select("term", F.lit(0).cast("bigint").alias("k"), "value")
    return counts.union(items)


def docs_lists(postings: DataFrame, span: int = SPAN) -> DataFrame:
    """The body of ``.docs``."""
    return _lists(postings.withColumn("_v", F.col("docid") - 1), "_v", span)


def freqs_lists(postings: DataFrame, span: int = SPAN) -> DataFrame:
    """The body of ``.freqs``."""
    return _lists(postings, "tf", span)


def sizes(documents: DataFrame) -> DataFrame:
    """(seq, value) of ``.sizes``: the number of documents at seq 0, then their lengths in order."""
    n = documents.agg(F.lit(0).cast("bigint").alias("seq"), F.count("*").alias("value"))
    return n.union(documents.select(F.col("docid").alias("seq"), "length"))


def terms(lexicon: DataFrame) -> DataFrame:
    """Lines of ``.terms``; their order is the byte order of the terms."""
    return lexicon.select("term")


def docmap(documents: DataFrame) -> DataFrame:
    """(seq from 0, text_id) of ``.documents``."""
    return documents.select((F.col("docid") - 1).alias("seq"), "text_id")


def interleaved(postings: DataFrame) -> DataFrame:
    """(term, docid, dgap, tf) of ``.interleaved``: the first gap of a list is its first docid from 0, which may be 0."""
    return dgaps(postings).select("term", (F.col("docid") - 1).alias("docid"), F.when(F.col("dgap") == F.col("docid"), F.col("dgap") - 1).otherwise(F.col("dgap")).alias("dgap"), "tf")


def _packed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(at, data) of rows (place, ...): the columns as little-endian 32-bit integers, neighbouring rows in one piece."""
    width = 4 * len(columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.column(0).to_numpy()
            values = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], axis=1).astype(np.int64)
            if len(values) and (values.min() < 0 or values.max() >= 1 << 32):
                raise ValueError("a value does not fit in 32 bits")
            cuts = [0, *(np.flatnonzero(np.diff(place) != 1) + 1).tolist(), len(place)]
            data = [values[lo:hi].astype("<u4").tobytes() for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if hi > lo]
            yield pa.RecordBatch.from_arrays([pa.array([int(place[lo]) * width for lo in cuts[:-1] if lo < len(place)], pa.int64()), pa.array(data, pa.binary())], ["at", "data"])

    return rows.select("place", *columns).repartitionByRange("place").sortWithinPartitions("place").mapInArrow(pack, "at bigint, data binary")


def _lines(rows: DataFrame, text: str, order: list[str]) -> tuple[DataFrame, int]:
    """(at, data) of lines of text in order, and the bytes of all."""
    line = rows.select(*order, F.encode(F.concat(F.coalesce(text, F.lit("")), F.lit("\n")), "UTF-8").alias("data"))
    at = placed(line, order, at=F.octet_length("data"))
    return at.select("at", "data"), at.agg(F.max(F.col("at") + F.octet_length("data"))).first()[0] or 0


def list_starts(lexicon_: DataFrame) -> DataFrame:
    """(term, df, number from 0, before): lists in the byte order of their terms, and the postings of all lists before."""
    return placed(lexicon_.select("term", "df"), ["term"], number=F.lit(1), before=F.col("df"))


def write_canonical(documents: DataFrame, postings: DataFrame, basename: str) -> None:
    """Write ``.docs .freqs .sizes .terms .documents``, each one file that tasks fill side by side.

    documents: (docid, text_id, length). basename lies in a folder that the driver and all executors mount. Lists move
    once, packed (``ordered.laid``); of them the driver sees two terms and some counts for each range.
    """
    documents, lists = kept(documents, "sized"), laid(postings)  # read for each of the files
    n, head = documents.count(), 2
    top = postings.sparkSession.createDataFrame([(0, b"".join(x.to_bytes(4, "little") for x in (1, n)))], "at bigint, data binary")
    write_bytes(lists.words.select(((F.col("at") + head) * 4).alias("at"), F.col("docs").alias("data")).union(top), f"{basename}.docs", 4 * (lists.n_words + head))
    write_bytes(lists.words.select((F.col("at") * 4).alias("at"), F.col("freqs").alias("data")), f"{basename}.freqs", 4 * lists.n_words)
    write_bytes(_packed(sizes(documents).withColumnRenamed("seq", "place"), ["value"]), f"{basename}.sizes", 4 * (n + 1))
    write_bytes(lists.lines, f"{basename}.terms", lists.n_bytes)
    lines, size = _lines(docmap(documents), "text_id", ["seq"])
    write_bytes(lines, f"{basename}.documents", size)


def write_interleaved(postings: DataFrame, basename: str) -> None:
    """Write ``.interleaved``: pairs (gap, frequency), terms in byte order, as one file that tasks fill side by side."""
    postings = kept(postings, "postings")
    starts = list_starts(postings.groupBy("term").agg(F.count("*").alias("df")))
    at = F.row_number().over(within("docid")) + F.coalesce("_carry", F.lit(0)) - 1
    rows = carried(interleaved(postings).withColumn("docid", F.col("docid") + 1), F.count("*"), F.sum).select("term", at.alias("_k"), "dgap", "tf")
    rows = rows.join(starts, "term").select((F.col("before") + F.col("_k")).alias("place"), "dgap", "tf")
    write_bytes(_packed(rows, ["dgap", "tf"]), f"{basename}.interleaved", 8 * postings.count())


def read_canonical(spark: SparkSession, basename: str, kind: str) -> DataFrame:
    """(number, k, value): the lists of a written ``docs`` or ``freqs``, or the one list of ``sizes``; at k = 0 its length."""
    head = 1 if kind == "docs" else 0
    rows = read_sequences(spark, f"{basename}.{kind}")
    return rows.where(F.col("sequence") >= head).select((F.col("sequence") - head).alias("number"), "k", "value")


def read_named(spark: SparkSession, basename: str, kind: str) -> DataFrame:
    """(term, k, value): the lists of a written ``docs`` or ``freqs`` with their terms, by the order of ``.terms``.

    A stretch of a list is one row when it meets its term, so values do not move one by one.
    """
    head = 1 if kind == "docs" else 0
    terms = text_lines(spark, f"file://{local_path(basename)}.terms").select((F.col("line") - 1 + head).alias("sequence"), F.col("value").alias("term"))
    met = read_stretches(spark, f"{basename}.{kind}").where(F.col("sequence") >= head).join(terms, "sequence")
    rows = met.select("term", F.col("k").alias("_k"), F.posexplode("words").alias("_p", "_w"))
    return rows.select("term", (F.col("_k") + F.col("_p")).alias("k"), F.col("_w").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")).alias("value"))
