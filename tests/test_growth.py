"""What moves: postings are counted in their rows, workloads meet the postings of their own terms, hits stay in their part."""

import random

from pyspark.sql import functions as F

from loomdex.functions.text import tokenize
from loomdex.operators import boolean, index, ranked

SCHEMA = "docid bigint, text_id string, tokens array<string>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(spark, n=120):
    r = random.Random(5)
    docs = [(d, str(d), [f"w{min(int(r.paretovariate(0.7)), 40)}" for _ in range(r.randint(0, 25))]) for d in range(1, n)]
    return spark.createDataFrame(docs, SCHEMA).repartition(3)


def test_postings_move_nothing(spark):
    d = made(spark)
    got = index.postings(d)
    assert "Exchange hash" not in plan(got)
    assert rows(got) == rows(d.select("docid", F.explode("tokens").alias("term")).groupBy("term", "docid").agg(F.count("*").alias("tf")))
    twice = d.unionByName(d.where("docid < 9")).unionByName(spark.createDataFrame([(7, "7", ["é", "e", None, "", None])], SCHEMA))
    assert rows(index.postings(twice)) == rows(twice.select("docid", F.explode("tokens").alias("term")).groupBy("term", "docid").agg(F.count("*").alias("tf")))


def test_words_of_blank_and_bordered_texts(spark):
    texts = [None, "", " ", "\t\n\x0b\f\r ", " a", "a ", "\x0ba\x0c\rb ", "\x85a b ", "a  b", "\x1ca\x1f"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(tokenize(F.col("t"))).collect()]
    assert got == [[w.decode() for w in (t or "").encode().split()] for t in texts]


def test_workload_meets_its_own_terms_without_moving_hits(spark):
    built = index.build(made(spark))
    asked = spark.createDataFrame([(1, "a", ["w1", "w2"]), (2, "b", ["w3", "none"]), (3, None, ["none"]), (4, "a", ["w40", "w1", "w5"])], "query_ord bigint, qid string, terms array<string>")
    part = index.of_terms(built, asked.select(F.explode("terms").alias("term")))
    assert rows(part.postings) == rows(built.postings.where("term in ('w1', 'w2', 'w3', 'w5', 'w40')"))
    assert rows(part.lexicon) == rows(built.lexicon.where("term in ('w1', 'w2', 'w3', 'w5', 'w40')"))
    for f in (boolean.and_docs, boolean.or_docs, boolean.and_count, boolean.or_count, lambda q, i: ranked.ranked(q, i, 3), lambda q, i: ranked.ranked(q, i, 3, n=0)):
        assert rows(f(asked, part)) == rows(f(asked, built))


def test_parts_of_a_workload_are_bounded_and_whole_by_document(spark, monkeypatch):
    monkeypatch.setattr(index, "PART", 50)
    built = index.build(made(spark))
    part = index.of_terms(built, spark.createDataFrame([("w1",), ("w2",), ("w3",)], "term string"))
    in_part = part.postings.select("docid", F.spark_partition_id().alias("p"))
    assert in_part.select("p").distinct().count() > 2
    assert in_part.groupBy("docid").agg(F.count_distinct("p").alias("n")).where("n > 1").isEmpty()


def test_segments_are_cut_and_saved_without_moving(spark, tmp_path):
    from loomdex.operators import segments

    built = index.build(made(spark))
    cut = segments.cut(built, 16)
    assert "Exchange hash" not in plan(cut.pieces) and cut.pieces.count() == built.postings.count()
    segments.save(cut, str(tmp_path / "s"))
    assert rows(segments.load(spark, str(tmp_path / "s")).lexicon) == rows(built.lexicon)
    assert rows(cut.bounds) == rows(built.postings.groupBy(F.expr("(docid - 1) div 16").alias("segment"), "term").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf")))


def test_lists_within_a_range_meet_no_carry(spark):
    from loomdex.operators import gaps

    p = index.postings(made(spark))
    assert "Join" not in plan(gaps.dgaps(p)) and "Join" in plan(gaps.dgaps(p, 16))
    assert rows(gaps.dgaps(p)) == rows(gaps.dgaps(p, 16)) and rows(gaps.from_dgaps(gaps.dgaps(p, 16), span=16)) == rows(p)


def test_gaps_of_a_stream_are_counted_without_python(spark):
    from loomdex.operators import gaps
    from loomdex.streaming import heads

    p = index.postings(made(spark))
    late = p.where("docid > 60")
    head = p.where("docid <= 60").groupBy("term").agg(F.count("*").alias("df"), F.max("docid").alias("last_docid"))
    got = heads.gaps(late, head)
    assert "Python" not in plan(got) and plan(got).count("Exchange hash") == 2  # of the line, and of the heads made here
    assert rows(got.drop("place")) == rows(gaps.dgaps(p).where("docid > 60"))
