"""A store in levels: merges in mid-stream, replays, readers of old versions, and queries beside ingestion."""

import math
import random

from loomdex.operators import index, ranked
from loomdex.streaming import ingest, levels

DOCS = "docid bigint, text_id string, tokens array<string>"
ASKED = "query_ord bigint, qid string, terms array<string>"


def rows(df, *c):
    return sorted(map(tuple, df.select(*c).collect()), key=str)


def same(spark, at, docs):
    want = index.build(spark.createDataFrame(docs, DOCS))
    assert rows(at.postings, "term", "docid", "tf") == rows(want.postings, "term", "docid", "tf")
    assert rows(at.lexicon, "term", "df", "cf", "last_docid") == rows(want.lexicon, "term", "df", "cf", "last_docid")
    assert rows(at.documents, "docid", "length") == rows(want.documents, "docid", "length")
    return want


def test_batches_merges_and_answers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(levels.Store.merge, "__defaults__", (2,))
    rng = random.Random(5)
    docs = [(d, str(d), [f"w{min(int(rng.paretovariate(0.9)), 15)}" for _ in range(rng.randint(0, 8))]) for d in range(1, 61)]
    store = levels.Store(spark, str(tmp_path / "store"))
    asked = [(1, "a", ["w1", "w2"]), (2, "b", ["w7", "none"]), (3, "c", ["w15"])]
    spark.createDataFrame(asked, ASKED).write.parquet(str(tmp_path / "asked"))
    assert store.runs() == (0, []) and store.snapshot().postings.count() == 0
    at = []
    for k in range(5):
        store.write_batch(spark.createDataFrame(docs[12 * k : 12 * k + 12], DOCS), k, numbered=True)
        version, runs = store.runs()
        at.append(version)
        assert len(runs) <= 1 + math.log2(k + 1) and sum(r.n for r in runs) == 12 * k + 12
        if k in (1, 4):
            spark.createDataFrame([(10 * k + q, i, t) for q, i, t in asked], ASKED).write.mode("append").parquet(str(tmp_path / "asked"))
            stream = spark.readStream.schema(ASKED).parquet(str(tmp_path / "asked"))
            levels.start_answers(stream, str(tmp_path / "store"), str(tmp_path / "cp"), str(tmp_path / "answers"), 5).awaitTermination()
    store.write_batch(spark.createDataFrame(docs[:12], DOCS), 0, numbered=True)  # a replay
    assert store.runs()[0] == at[-1]
    same(spark, store.snapshot(), docs)
    old = store.snapshot(at[1])
    want = same(spark, old, docs[:24])
    answers = spark.read.parquet(str(tmp_path / "answers"))
    assert {r["version"] for r in answers.select("version").distinct().collect()} == {at[1], at[4]}
    queries = spark.createDataFrame([(q + m, i, t) for m in (0, 10) for q, i, t in asked], ASKED)
    first = answers.where(f"version = {at[1]}")
    assert rows(first, "query_ord", "rank", "docid", "score") == rows(ranked.ranked(queries, want, 5), "query_ord", "rank", "docid", "score")
    whole = index.build(spark.createDataFrame(docs, DOCS))
    later = spark.createDataFrame([(40 + q, i, t) for q, i, t in asked], ASKED)
    assert rows(answers.where(f"version = {at[4]}"), "query_ord", "rank", "docid", "score") == rows(ranked.ranked(later, whole, 5), "query_ord", "rank", "docid", "score")
    # old versions are readable until they are given up
    assert store.vacuum(100) == 0 and rows(store.snapshot(at[1]).documents, "docid") == rows(want.documents, "docid")
    assert store.vacuum(1) > 0 and store.versions() == at[-1:]
    same(spark, store.snapshot(), docs)


def test_text_lines_over_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = []
    for k in range(3):
        own = [f"d{k}-{j} a b{j % 2}" if j % 4 else "" for j in range(9)]
        text += own
        (tmp_path / "in" / f"{k}").write_text("\n".join(own) + "\n")
        levels.start(ingest.docstream(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    same(spark, levels.Store(spark, str(tmp_path / "store")).snapshot(), [(n + 1, None, x.split()[1:]) for n, x in enumerate(text)])


def test_a_merge_that_lost_against_a_batch(spark, tmp_path, monkeypatch):
    docs = [(d, str(d), ["x", f"y{d % 3}"]) for d in range(1, 13)]
    store = levels.Store(spark, str(tmp_path / "store"))
    for k in range(3):
        store.write_batch(spark.createDataFrame(docs[3 * k : 3 * k + 3], DOCS), k, numbered=True)
    enter, came = levels.Store.replace, []

    def late(self, old, new):
        if not came:
            came.append(1)
            monkeypatch.setattr(levels.Store, "merge", lambda self, fan=0: 0)
            levels.Store(spark, self.path).write_batch(spark.createDataFrame(docs[9:], DOCS), 3, numbered=True)
        enter(self, old, new)

    merge = levels.Store.merge
    monkeypatch.setattr(levels.Store, "replace", late)
    assert merge(store, 3) == 1
    assert [r.level for r in store.runs()[1]] == [1, 0]
    same(spark, store.snapshot(), docs)


def test_parts_that_arrive_are_spread_over_files(spark, tmp_path):
    docs = [(d, str(d), ["x", f"y{d % 7}"]) for d in range(1, 101) if not 41 <= d <= 60]  # the third part is empty
    one = spark.createDataFrame(docs, DOCS).coalesce(1)
    seen = []
    for k, arrived in enumerate(ingest.arrivals(one, str(tmp_path / "from"), 5, 4)):
        levels.start(arrived, str(tmp_path / "store"), str(tmp_path / "cp"), numbered=True).awaitTermination()
        come = spark.read.schema(DOCS).parquet(str(tmp_path / "from" / "in" / str(k)))
        seen.append((len(come.inputFiles()) if k != 2 else 5, sorted(r["docid"] for r in come.collect())))
    assert seen == [(5, [d for d, _, _ in docs if 20 * k < d <= 20 * k + 20]) for k in range(5)]  # one file each before
    same(spark, levels.Store(spark, str(tmp_path / "store")).snapshot(), docs)


def test_repeated_docids_of_a_batch(spark, tmp_path):
    store = levels.Store(spark, str(tmp_path / "store"))
    store.write_batch(spark.createDataFrame([(1, "1", ["a", "b"]), (1, "1", ["a"]), (2, "2", ["a"])], DOCS), 0, numbered=True)
    assert rows(store.snapshot().postings, "term", "docid", "tf") == [("a", 1, 2), ("a", 2, 1), ("b", 1, 1)]
