"""A live store in levels: runs of batches under numbered versions, merged while it is written and read.

A batch becomes a run at level 0. When a level has ``FAN`` runs they are merged into one of the next, postings in order of
term and docid, so the runs of a store are some for each level and a batch looks at as many, however many came before. A
version is a small file that names the runs; a reader opens the runs of one version and sees the same documents until
it opens another, whatever is written or merged meanwhile. Runs that no kept version names are deleted by ``vacuum``.

A version is written aside and renamed, one number after the last. A batch that is replayed finds itself in the last
version and changes nothing; a merge that lost against a batch is entered into the version that the batch made, as its
runs are still there. Two streams must not write into one store.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.index import Index, doc_stats, lexicon, postings
from ..operators.ranked import ranked
from ..operators.workload import with_totals
from .ingest import numbered_lines

#: Runs of a level that become one of the next, and versions that stay readable.
FAN, KEPT = 4, 16
_TABLES = {"documents": "docid bigint, length bigint, n_postings bigint", "postings": "term string, docid bigint, tf bigint", "lexicon": "term string, df bigint, cf bigint, last_docid bigint"}


@dataclass(frozen=True)
class Run:
    """Documents base + 1 to base + n of the batches first to last, in the folder ``name``."""

    name: str
    level: int
    base: int
    n: int
    postings: int
    words: int
    first: int
    last: int


class Store:
    """The versions of a store. All calls are the driver's; what they read and write is a file of some runs."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the versions that are there, ascending."""
        if not self._fs.exists(self._at("versions")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("versions"))]
        return sorted(int(n) for n in names if n.isdigit())

    def runs(self, version: int | None = None) -> tuple[int, list[Run]]:
        """A version (by default the last, 0 for an empty store) and its runs in order of documents."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return 0, []
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(self._fs.open(self._at(f"versions/{version}")), "UTF-8")
        return version, [Run(**r) for r in json.loads(text)]

    def commit(self, version: int, runs: list[Run]) -> bool:
        """Enter the version after ``version``; False if it is there already."""
        draft, name = self._at(f"versions/_{uuid.uuid4().hex}"), self._at(f"versions/{version + 1}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps([asdict(r) for r in sorted(runs, key=lambda r: r.base)]).encode()))
        out.close()
        done = not self._fs.exists(name) and self._fs.rename(draft, name)
        if not done:
            self._fs.delete(draft, False)
        return done

    def replace(self, old: list[Run], new: Run) -> None:
        """Enter a version where ``new`` stands for the runs ``old``, whatever was added meanwhile."""
        while True:
            version, runs = self.runs()
            if not set(old) <= set(runs):
                raise ValueError("the merged runs are in the store no longer")
            if self.commit(version, [r for r in runs if r not in old] + [new]):
                return

    def table(self, runs: list[Run], name: str) -> DataFrame:
        folders = [f"{self.path}/runs/{r.name}/{name}" for r in runs]
        return self.spark.read.schema(_TABLES[name]).parquet(*folders) if folders else self.spark.createDataFrame([], _TABLES[name])

    def snapshot(self, version: int | None = None) -> Index:
        """The index of one version."""
        _, runs = self.runs(version)
        lex = self.table(runs, "lexicon")
        if len(runs) > 1:
            lex = lex.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("last_docid").alias("last_docid"))
        return Index(self.table(runs, "documents"), self.table(runs, "postings"), lex)

    def write_batch(self, batch: DataFrame, batch_id: int, numbered: bool = False) -> None:
        """Add a batch as a run and merge what has become too many; the same batch again changes nothing."""
        version, runs = self.runs()
        if any(r.first <= batch_id <= r.last for r in runs):
            return
        base = max((r.base + r.n for r in runs), default=0)
        if not numbered:
            batch = batch.persist()  # lines are counted and numbered by one reading
        try:
            docs = batch if numbered else numbered_lines(batch, base)
            name = f"batch-{batch_id}-{uuid.uuid4().hex}"
            at = f"{self.path}/runs/{name}"
            stats, totals = with_totals(doc_stats(docs), name)
            stats.write.parquet(f"{at}/documents")
            # a batch of a stream is read whole each time, so the docids come from what was written
            numbers = self.spark.read.schema(_TABLES["documents"]).parquet(f"{at}/documents")
            postings(docs, numbers).sortWithinPartitions("term", "docid").write.parquet(f"{at}/postings")
            lexicon(self.spark.read.schema(_TABLES["postings"]).parquet(f"{at}/postings")).write.parquet(f"{at}/lexicon")
        finally:
            if not numbered:
                batch.unpersist()
        seen = totals.get
        top = numbers.agg(F.max("docid")).first()[0] or base
        run = Run(name, 0, base, top - base, seen["postings"] or 0, seen["words"] or 0, batch_id, batch_id)
        while not self.commit(version, [*runs, run]):  # a merge came between
            version, runs = self.runs()
        self.merge()

    def merge(self, fan: int = FAN) -> int:
        """Merge the levels that have ``fan`` runs; the number of merges."""
        done = 0
        while True:
            _, runs = self.runs()
            levels: dict[int, list[Run]] = {}
            for r in runs:
                levels.setdefault(r.level, []).append(r)
            full = [own for own in levels.values() if len(own) >= fan]
            if not full:
                return done
            own = sorted(full[0], key=lambda r: r.base)
            name = f"level-{own[0].level + 1}-{uuid.uuid4().hex}"
            at = f"{self.path}/runs/{name}"
            self.table(own, "documents").write.parquet(f"{at}/documents")
            self.table(own, "postings").repartitionByRange("term", "docid").sortWithinPartitions("term", "docid").write.parquet(f"{at}/postings")
            lex = self.table(own, "lexicon").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("last_docid").alias("last_docid"))
            lex.write.parquet(f"{at}/lexicon")
            total = lambda c: sum(getattr(r, c) for r in own)
            last = max(own, key=lambda r: r.base + r.n)
            self.replace(own, Run(name, own[0].level + 1, own[0].base, last.base + last.n - own[0].base, total("postings"), total("words"), own[0].first, own[-1].last))
            done += 1

    def vacuum(self, kept: int = KEPT) -> int:
        """Forget all but the last ``kept`` versions and delete the runs that none of them names; the number of runs."""
        versions = self.versions()
        for v in versions[:-kept]:
            self._fs.delete(self._at(f"versions/{v}"), False)
        named = {r.name for v in versions[-kept:] for r in self.runs(v)[1]}
        newest = max((r.last for v in versions[-1:] for r in self.runs(v)[1]), default=-1)
        gone = 0
        for status in self._fs.listStatus(self._at("runs")) if self._fs.exists(self._at("runs")) else []:
            name = status.getPath().getName()
            # a run of a later batch may be on its way into a version
            if name not in named and not (name.startswith("batch-") and int(name.split("-")[1]) > newest):
                self._fs.delete(status.getPath(), True)
                gone += 1
        return gone


def start(stream: DataFrame, path: str, checkpoint: str, numbered: bool = False) -> StreamingQuery:
    """Ingest everything that is there into the store at ``path``: lines of ``ingest.docstream``, or with ``numbered`` rows
    (docid, text_id, tokens)."""
    store = Store(stream.sparkSession, path)
    return stream.writeStream.foreachBatch(lambda b, i: store.write_batch(b, i, numbered)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_answers(queries: DataFrame, path: str, checkpoint: str, to: str, k: int = 10) -> StreamingQuery:
    """Answer a stream of (query_ord, qid, terms) on the store at ``path``, each trigger on one version of it.

    Writes (batch_id, version, query_ord, qid, rank, docid, score); a replayed batch answers anew, on the version of then,
    and takes the place of its rows.
    """
    store = Store(queries.sparkSession, path)

    def answer(batch: DataFrame, batch_id: int) -> None:
        version, _ = store.runs()
        best = ranked(batch.persist(), store.snapshot(version), k).select(F.lit(version).cast("bigint").alias("version"), "query_ord", "qid", "rank", "docid", "score")
        best.write.mode("overwrite").parquet(f"{to}/batch_id={batch_id}")
        batch.unpersist()

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
