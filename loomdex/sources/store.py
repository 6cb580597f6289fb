"""An index as Parquet tables in one folder: documents, postings, lexicon and what they were built with.

A packed index also has a manifest, the terms that each of its files begins and ends with, so that a lookup of a few
terms opens the files that hold them and lists no others.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import Index, doc_stats, lexicon, postings
from .scratch import kept

FORMAT = 2
#: Files of an index whose names and terms a lookup holds on the driver, some hundred bytes each; beyond, it asks the table.
MANIFEST_FILES = 200_000
#: Postings that one task intersects, by the df of the terms; beyond, Spark joins the lists.
ONE_TASK = 4_000_000
#: Postings of a list that is sent to all executors, 8 bytes each; beyond, both lists are shuffled.
SENT = 2_000_000


def save(index: Index, path: str, mode: str = "errorifexists", positions: DataFrame | None = None, whole: bool = True) -> None:
    """Write an index in whatever order its rows come. whole: the lexicon has one row for a term."""
    index.documents.write.mode(mode).parquet(f"{path}/documents")
    index.postings.write.mode(mode).parquet(f"{path}/postings")
    index.lexicon.write.mode(mode).parquet(f"{path}/lexicon")
    if positions is not None:
        positions.write.mode(mode).parquet(f"{path}/positions")
    meta = index.documents.sparkSession.range(1).select(F.lit(FORMAT).alias("format"), F.lit(positions is not None).alias("positions"), F.lit(whole).alias("whole"))
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def save_built(documents: DataFrame, path: str, mode: str = "errorifexists", whole: bool = True) -> None:
    """``save`` of the index of ``documents``: texts are counted once, and the lexicon comes from the written postings."""
    p = kept(postings(documents), "postings")
    save(Index(doc_stats(documents), p, lexicon(p)), path, mode, whole=whole)


def save_packed(index: Index, path: str, partitions: int | None = None, mode: str = "errorifexists", stored: bool = False) -> None:
    """Write an index with every list contiguous: files hold ranges of terms, sorted by term and docid.

    Lookups of a term then read the row groups whose statistics hold it. A frequent term may span several files, as
    the ranges are cut by (term, docid). The index itself is left as it is. stored: its tables are files already.
    """
    spark = index.documents.sparkSession
    cut = lambda d, *keys: (d.repartitionByRange(partitions, *keys) if partitions else d.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    # a sort by range reads its input twice: the lists are written as they come first, so that texts are read once
    if stored:
        loose, counted = index.postings, index.lexicon
    else:
        index.postings.write.mode(mode).parquet(f"{path}/_loose")
        loose = spark.read.schema(index.postings.schema).parquet(f"{path}/_loose")
        counted = lexicon(loose)
    save(Index(index.documents, cut(loose, "term", "docid"), cut(counted, "term")), path, mode)
    for name in ("postings", "lexicon"):
        files = spark.read.parquet(f"{path}/{name}").select("term", F.col("_metadata.file_path").alias("file"))
        files = files.groupBy("file").agg(F.min("term").alias("first"), F.max("term").alias("last"), F.count("*").alias("n"))
        files.coalesce(1).write.mode(mode).parquet(f"{path}/manifest/{name}")  # a row for each file
    _delete(spark, f"{path}/_loose")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Give a folder another name in the same store; False if it is not there."""
    at, name = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return False
    fs.mkdirs(name.getParent())
    if not fs.rename(at, name):
        raise OSError(f"{path} could not be named {to}")
    return True


def load(spark: SparkSession, path: str) -> Index:
    """Read an index. Lexicon rows of several appends are summed; one that is whole is read as it is."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta is None or meta["format"] != FORMAT:
        raise ValueError(f"{path} is not an index of format {FORMAT}")
    lexicon = spark.read.parquet(f"{path}/lexicon")
    if not meta["whole"]:
        lexicon = lexicon.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("last_docid").alias("last_docid"))
    return Index(spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/postings"), lexicon)


def append(spark: SparkSession, path: str, documents: DataFrame) -> None:
    """Add documents to a stored index; only they are processed. Their docids must exceed all stored ones."""
    top = spark.read.parquet(f"{path}/documents").agg(F.max("docid")).first()[0] or 0
    low = documents.agg(F.min("docid")).first()[0]
    if low is not None and low <= top:
        raise ValueError(f"docids must increase: {low} after {top}")
    _delete(spark, f"{path}/manifest")  # before the rows that it does not know
    save_built(documents, path, mode="append", whole=False)


def compact(spark: SparkSession, path: str, to: str, partitions: int | None = None) -> None:
    """Write a packed copy of a stored index to another folder."""
    save_packed(load(spark, path), to, partitions, stored=True)


class Lookup:
    """Lookups of a few terms in a packed index: the files that hold them, by the manifest, and nothing else.

    A term in no file reads nothing. Terms are compared as their UTF-8 bytes, as Parquet and Spark order them.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            raise ValueError(f"{path} is not packed; compact it first")
        self.spark, self.path = spark, path
        self._schema = {name: spark.read.parquet(f"{path}/{name}").schema for name in ("postings", "lexicon")}
        self._files = {name: self._held(name) for name in ("postings", "lexicon")}

    def _held(self, name: str) -> tuple[list[bytes], list[bytes], list[str]] | None:
        table = self.spark.read.parquet(f"{self.path}/manifest/{name}")
        if table.count() > MANIFEST_FILES:
            return None
        rows = sorted((r["first"].encode(), r["last"].encode(), r["file"]) for r in table.collect())
        return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]

    def files(self, terms: list[str], name: str = "postings") -> list[str]:
        """Files whose range of terms has one of ``terms``. Ranges meet at their ends only, as the files are cut in order."""
        held = self._files[name]
        if held is None:
            hit = [(F.col("first") <= t) & (F.col("last") >= t) for t in terms]
            table = self.spark.read.parquet(f"{self.path}/manifest/{name}")
            any_of = hit[0] if hit else F.lit(False)
            for h in hit[1:]:
                any_of |= h
            return sorted(r["file"] for r in table.where(any_of).select("file").collect())
        firsts, lasts, files = held
        found = set()
        for t in terms:
            found.update(files[bisect_left(lasts, t.encode()) : bisect_right(firsts, t.encode())])
        return sorted(found)

    def _read(self, terms: list[str], name: str) -> DataFrame:
        files = self.files(terms, name)
        if not files:
            return self.spark.createDataFrame([], self._schema[name])
        rows = self.spark.read.schema(self._schema[name]).parquet(*files)
        return rows.where(F.col("term") == terms[0] if len(terms) == 1 else F.col("term").isin(terms))

    def postings(self, terms: list[str]) -> DataFrame:
        """(term, docid, tf) of the terms. No exchange: the scan is the plan."""
        return self._read(terms, "postings")

    def lexicon(self, terms: list[str]) -> DataFrame:
        """(term, df, cf, last_docid) of the terms that the index has."""
        return self._read(terms, "lexicon")

    def and_docs(self, terms: list[str]) -> DataFrame:
        """(docid) of the documents that hold all known terms; none if no term is known.

        Lists of a bounded number of postings meet in one task without an exchange. Beyond that the rarest list is sent
        to the others while its size allows it, and lists are shuffled where even that is too long.
        """
        known = sorted((r["df"], r["term"]) for r in self.lexicon(sorted(set(terms))).select("term", "df").collect())  # the terms of one query
        if sum(df for df, _ in known) <= ONE_TASK:
            met = self.postings([t for _, t in known]).select("docid").coalesce(1) if known else self.spark.createDataFrame([], "docid bigint")
            return met.groupBy("docid").agg(F.count("*").alias("_n")).where(F.col("_n") == len(known)).select("docid")
        out = self.postings([known[0][1]]).select("docid")
        for _, term in known[1:]:
            other = self.postings([term]).select("docid")
            # the result so far is no longer than the rarest list
            out = other.join(F.broadcast(out), "docid", "left_semi") if known[0][0] <= SENT else out.join(other, "docid", "left_semi")
        return out
