"""Stored indexes: lookups by the manifest, whole and summed lexicons, line numbers by either join."""

import random

import pytest
from pyspark.sql import functions as F

from loomdex.operators import index
from loomdex.sources import docstream, store


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    r = random.Random(4)
    words = [f"{c}{k}" for c in "aäzß😀 文".replace(" ", "") for k in range(40)] + ["hot"]
    docs = [(d, str(d), [r.choice(words) for _ in range(r.randint(0, 12))] + ["hot"] * (d % 3 > 0)) for d in range(1, 500)]
    built = index.build(spark.createDataFrame(docs, "docid bigint, text_id string, tokens array<string>"))
    path = str(tmp_path_factory.mktemp("store"))
    store.save_packed(built, f"{path}/packed", 8)
    return built, path


def test_lookup_opens_few_files(spark, made):
    built, path = made
    find = store.Lookup(spark, f"{path}/packed")
    every = len(spark.read.parquet(f"{path}/packed/postings").inputFiles())
    assert every == 8
    for term in ("a7", "ä0", "z39", "😀3", "文12", "ß5"):
        got = find.postings([term])
        assert 1 <= len(got.inputFiles()) <= 2
        assert rows(got) == rows(built.postings.where(F.col("term") == term)) != []
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert rows(find.lexicon([term])) == rows(built.lexicon.where(F.col("term") == term))
    assert rows(find.postings(["hot"])) == rows(built.postings.where("term = 'hot'"))
    assert rows(find.postings(["a7", "文12", "none"])) == rows(built.postings.where("term IN ('a7', '文12')"))
    for term in ("", "\U0010ffff", "zzz"):
        assert find.postings([term]).count() == 0
    assert find.postings([]).count() == 0 and find.files(["\U0010ffff"]) == []


@pytest.mark.parametrize("one_task, sent", [(store.ONE_TASK, store.SENT), (0, store.SENT), (0, 0)])
def test_conjunctions(spark, made, monkeypatch, one_task, sent):
    built, path = made
    monkeypatch.setattr(store, "ONE_TASK", one_task)
    monkeypatch.setattr(store, "SENT", sent)
    find = store.Lookup(spark, f"{path}/packed")
    lists = {}
    for p in built.postings.collect():
        lists.setdefault(p["term"], set()).add(p["docid"])
    for terms in (["hot", "a1"], ["hot", "none", "z3"], ["none"], [], ["hot", "hot"], ["a1", "ä2", "hot"]):
        known = [lists[t] for t in set(terms) if t in lists]
        got = find.and_docs(terms)
        assert [r[0] for r in rows(got)] == [x for (x,) in sorted(((d,) for d in (set.intersection(*known) if known else ())), key=str)]
    plan = find.and_docs(["hot", "a1"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(docid" not in plan or one_task == 0


def test_manifest_beyond_its_bound(spark, made, monkeypatch):
    built, path = made
    monkeypatch.setattr(store, "MANIFEST_FILES", 1)
    find = store.Lookup(spark, f"{path}/packed")
    assert rows(find.postings(["a7", "😀3"])) == rows(built.postings.where("term IN ('a7', '😀3')"))
    assert find.postings([]).count() == 0 and len(find.files(["a7"])) <= 2


def test_appends_sum_the_lexicon_and_end_the_manifest(spark, made, tmp_path):
    built, path = made
    at = str(tmp_path / "grown")
    store.save_packed(store.load(spark, f"{path}/packed"), at, 3)
    assert "Aggregate" not in store.load(spark, at).lexicon._jdf.queryExecution().optimizedPlan().toString()
    more = spark.createDataFrame([(1000, "x", ["hot", "new"])], "docid bigint, text_id string, tokens array<string>")
    store.append(spark, at, more)
    assert rows(store.load(spark, at).lexicon.where("term IN ('hot', 'new')").select("term", "df")) == [("hot", built.lexicon.where("term = 'hot'").first()["df"] + 1), ("new", 1)]
    with pytest.raises(ValueError, match="not packed"):
        store.Lookup(spark, at)
    store.compact(spark, at, f"{at}-packed")
    assert rows(store.Lookup(spark, f"{at}-packed").postings(["new"])) == [("new", 1000, 1)]


def test_line_numbers_with_few_and_many_splits(spark, tmp_path, monkeypatch):
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("".join(f"d{k}-{j} x\n" if j % 7 else "\n" for j in range(200)))
    want = rows(docstream.lines(spark, str(tmp_path)))
    assert [r[0] for r in sorted(want)] == list(range(1, 601))
    plan = docstream.lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    monkeypatch.setattr(docstream, "SPLITS", 0)
    assert rows(docstream.lines(spark, str(tmp_path))) == want
