"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

Each text, without white space, is cut after punctuation into chunks of 256 to 2048 code points (after 2048 where there
is none), so that equal texts have equal chunks. A chunk's identifier is a hash of 128 bits; a grouping of the
distinct chunks by identifier and content verifies that no two contents share one, and where any do, longer identifiers
take their place. Each distinct chunk moves once from each task; documents then meet as ordered lists of identifiers,
16 bytes for each chunk.

Defined results: null counts as empty, and all empty texts are equal; of equal texts the row with the most code points
stays, then the smallest doc_id; of rows that repeat a doc_id and a text one stays; a null doc_id comes after all
others; very long texts are many chunks, and whole; an empty table gives no rows. Groups of any size are pre-aggregated before the shuffle, and the join back to
the documents is salted. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, free_name, keep_by_id, needs, salted_lookup, stored, text_of

#: Cut after punctuation, 256 to 2048 code points; the last chunk may be shorter.
CHUNK = r"(?s).{255,2047}?[.,;:!?。、！？]|.{1,2048}"

#: Identifiers of a chunk, tried in this order: 128 bits, 256 bits, the content itself. A first one of 64 bits would
#: collide in any corpus of 10^10 chunks and have every text read again.
IDENTIFIERS: Sequence[Callable[[Column], Column]] = (
    lambda c: F.unhex(F.md5(c)),
    lambda c: F.sha2(c, 256),
    lambda c: c,
)


def normalised() -> Column:
    return F.regexp_replace(text_of(), SPACE + "+", "")


def chunks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def verified(texts: DataFrame, identify: Callable[[Column], Column]) -> bool:
    """Whether no two different chunks share an identifier. texts: one column ``_norm``."""
    chunk = texts.select(F.explode(chunks_of(F.col("_norm"))).alias("_chunk"))
    contents = chunk.select(identify(F.col("_chunk")).alias("_id"), "_chunk").distinct()
    return contents.groupBy("_id").count().where("count > 1").isEmpty()


def recipes(docs: DataFrame, identifiers: Sequence[Callable[[Column], Column]] = IDENTIFIERS) -> DataFrame:
    """doc_id, n_chars, text_sha256 and recipe, the ordered list of verified chunk identifiers of each text."""
    d = needs(docs, doc_id="bigint", text="string").select("doc_id", F.length(text_of()).cast("bigint").alias("n_chars"), normalised().alias("_norm"))
    for k, identify in enumerate(identifiers):
        if k == len(identifiers) - 1 and k or verified(d.select("_norm"), identify):
            break
    else:
        raise ValueError("two different chunks share an identifier")
    return d.select("doc_id", "n_chars", F.sha2("_norm", 256).alias("text_sha256"), F.transform(chunks_of(F.col("_norm")), identify).alias("recipe"))


def exact_duplicates(docs: DataFrame, identifiers: Sequence[Callable[[Column], Column]] = IDENTIFIERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = stored(recipes(docs, identifiers), "recipes")
    rank = F.struct("n_chars", F.col("doc_id").isNotNull(), -F.col("doc_id"))
    groups = rows.groupBy("recipe").agg(F.max_by("doc_id", rank).alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    out = salted_lookup(rows, groups, "recipe", "doc_id")
    same = Window.partitionBy("doc_id").orderBy(F.col("n_chars").desc(), "text_sha256")
    out = out.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    first = F.row_number().over(same.partitionBy("doc_id", "text_sha256")) == 1
    return out.select("doc_id", "keep_id", F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & first).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    Where every doc_id is there once, the id tells which rows stay. Rows that share an id are told apart by their text.
    """
    marked = stored(exact_duplicates(docs).select("doc_id", "kept", "text_sha256"), "marked")
    kept = marked.where("kept")
    if marked.groupBy("doc_id").count().where("count > 1").isEmpty():
        return keep_by_id(docs, kept)
    sha, place = free_name(docs, "_sha"), free_name(docs, "_place")
    named = docs.withColumn(sha, F.sha2(normalised(), 256))
    chosen = kept.select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    found = named.join(chosen, named["doc_id"].eqNullSafe(chosen["_kept_id"]) & (named[sha] == chosen["_kept_sha"]), "left_semi")
    longest = Window.partitionBy("doc_id", sha).orderBy(F.length(text_of()).desc())
    return found.withColumn(place, F.row_number().over(longest)).where(F.col(place) == 1).drop(sha, place)
