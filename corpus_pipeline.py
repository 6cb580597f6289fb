"""From raw documents to token ids: language ID, exact dedup, near dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on everything that the stage before kept; all but the last return the
columns of ``documents``. Defined results: a null text has no language and goes at the first stage; copies and near
copies keep the documents that op2 and op4 name; a document that the mix takes twice is there twice; an empty table
stays empty. Other columns of the documents, of any name that does not begin with an underscore, go along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.bpe import round_trip
from loomdex.llm.common import stored, table
from loomdex.llm.exact_dedup import drop_duplicates
from loomdex.llm.langid import keep_identified
from loomdex.llm.mixing import apply_mix
from loomdex.llm.ngram_join import keep_one


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.75 Jaccard likeness connect."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, as often as it takes them."""
    return apply_mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids (four little-endian bytes each), the number of ids and checks of both directions."""
    out = round_trip(docs)
    return out.withColumn("ids_sha256", F.sha2("ids", 256)).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_join", near_dedup),
    ("mixing", mixing),
    ("bpe", encoding),
]

#: A trained sequence model decides the first stage; SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
