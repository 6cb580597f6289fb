"""Building an index: postings, lexicon and statistics of a collection of documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: Postings of a part of ``of_terms``: what a task that meets them with a workload has at most, but for one document's.
PART = 1_000_000


@dataclass(frozen=True)
class Index:
    """The tables of an index. documents: (docid, length, n_postings), a row for every document, blank ones too."""

    documents: DataFrame
    postings: DataFrame
    lexicon: DataFrame

    @property
    def n_docs(self) -> DataFrame:
        """One row: n."""
        return self.documents.agg(F.count("*").alias("n"))


def tokens(documents: DataFrame) -> DataFrame:
    """(docid, position from 1, term), a row for each token."""
    return documents.select("docid", F.posexplode("tokens").alias("_p", "term")).select("docid", (F.col("_p") + 1).alias("position"), "term")


def counted(documents: DataFrame) -> DataFrame:
    """(term, docid, tf) of each row by itself, without a shuffle: equal words lie together in the sorted tokens, and a
    word's count is the distance from its first place to the next word's."""
    s = documents.select("docid", F.sort_array("tokens").alias("_s"))
    first = lambda w, i: F.when((i == 0) | ~w.eqNullSafe(F.get("_s", i - 1)), i)
    s = s.select("docid", "_s", F.array_compact(F.transform("_s", first)).alias("_at"))
    upto = lambda k: F.coalesce(F.get("_at", k + 1), F.size("_s"))
    found = F.transform("_at", lambda i, k: F.struct(F.get("_s", i).alias("term"), (upto(k) - i).cast("bigint").alias("tf")))
    return s.select("docid", F.inline(found)).select("term", "docid", "tf")


def postings(documents: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """(term, docid, tf). Documents are counted row by row; where rows share a docid, which a look at the docids tells,
    their counts are summed. numbers: a table of the same docids, where documents are dear to read for that."""
    p = counted(documents)
    if (documents if numbers is None else numbers).groupBy("docid").agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
        return p
    return p.groupBy("term", "docid").agg(F.sum("tf").alias("tf"))


def positional_postings(documents: DataFrame) -> DataFrame:
    """(term, docid, positions): positions ascending from 1."""
    return tokens(documents).groupBy("term", "docid").agg(F.sort_array(F.collect_list("position")).alias("positions"))


def lexicon(postings_: DataFrame) -> DataFrame:
    """(term, df, cf, last_docid). Summed on the map side; a frequent term is one row for each task."""
    return postings_.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("docid").alias("last_docid"))


def doc_stats(documents: DataFrame) -> DataFrame:
    """(docid, length, n_postings) without a shuffle."""
    return documents.select("docid", F.size("tokens").cast("bigint").alias("length"), F.size(F.array_distinct("tokens")).cast("bigint").alias("n_postings"))


def collection_stats(documents: DataFrame, lexicon_: DataFrame) -> DataFrame:
    """One row: n_docs, n_words, n_postings, vocabulary, mean_postings (whole part)."""
    docs = doc_stats(documents).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_words"), F.coalesce(F.sum("n_postings"), F.lit(0)).alias("n_postings"))
    terms = lexicon_.agg(F.count("*").alias("vocabulary"))
    both = docs.crossJoin(terms)  # one row each
    return both.select("n_docs", "n_words", "n_postings", "vocabulary", F.when(F.col("n_docs") > 0, F.expr("n_postings div n_docs")).alias("mean_postings"))


def build(documents: DataFrame) -> Index:
    """The index of (docid, text_id, tokens)."""
    p = postings(documents)
    return Index(doc_stats(documents), p, lexicon(p))


def of_terms(index: Index, terms: DataFrame) -> Index:
    """The part of an index that ``terms`` have, worked out once and written: all their postings, in parts by docid of
    bounded size, and the lexicon that these give. documents stay whole."""
    p = kept(index.postings.join(terms.select("term"), "term", "left_semi"), "asked_postings")
    return Index(index.documents, p.repartition(1 + p.count() // PART, "docid"), lexicon(p))


def append(index: Index, documents: DataFrame) -> Index:
    """The index with more documents. Their docids must be above all present ones; a repeat fails the query."""
    fresh = build(documents)
    top = index.documents.agg(F.coalesce(F.max("docid"), F.lit(0)).alias("_top"))  # one row
    late = F.when(F.col("docid") <= F.col("_top"), F.raise_error(F.lit("docids must increase"))).otherwise(F.col("docid"))
    docs = fresh.documents.crossJoin(top).select(late.alias("docid"), "length", "n_postings")
    p = index.postings.unionByName(fresh.postings)
    merged = index.lexicon.unionByName(fresh.lexicon).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("last_docid").alias("last_docid"))
    return Index(index.documents.unionByName(docs), p, merged)


def term_frequency(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(docid, term, tf) for each pair of documents (docid, tokens) and terms; 0 where a document lacks the term.

    ``terms`` holds pairs (docid, term), so the size of the result is the caller's.
    """
    p = postings(documents)
    return terms.join(p, ["docid", "term"], "left").select("docid", "term", F.coalesce("tf", F.lit(0)).alias("tf"))
