import shutil

from loomdex.functions.text import tokenize
from loomdex.operators import index, ranked
from loomdex.sources import docstream
from loomdex.streaming import ingest


def pairs(df, *c):
    return sorted(tuple(r[k] for k in c) for r in df.collect())


def test_stream_equals_batch_and_replays(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("d1 a b c a\nd2 b b\n")
    go = lambda: ingest.start(ingest.docstream(spark, str(tmp_path / "in"), 1), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    go()
    first = ingest.live_index(spark, str(tmp_path / "store"))
    assert pairs(first.lexicon, "term", "df") == [("a", 1), ("b", 2), ("c", 1)]
    (tmp_path / "in" / "b").write_text("\nd4 c c z\n")
    go()
    live = ingest.live_index(spark, str(tmp_path / "store"))
    (tmp_path / "all").write_text("d1 a b c a\nd2 b b\n\nd4 c c z\n")
    want = index.build(docstream.read_docstream(spark, str(tmp_path / "all")))
    assert pairs(live.postings, "term", "docid", "tf") == pairs(want.postings, "term", "docid", "tf")
    assert pairs(live.lexicon, "term", "df", "cf") == pairs(want.lexicon, "term", "df", "cf")
    assert pairs(live.documents, "docid", "length") == pairs(want.documents, "docid", "length")
    (tmp_path / "q").write_text("1 c z\n")
    q = docstream.read_queries(spark, str(tmp_path / "q"))
    assert pairs(ranked.ranked(q, live, 5), "docid", "score") == pairs(ranked.ranked(q, want, 5), "docid", "score")
    # the last batch once more, as after a failure between its writes and its commit
    last = max(int(p.name) for p in (tmp_path / "cp" / "commits").iterdir() if p.name.isdigit())
    (tmp_path / "cp" / "commits" / str(last)).unlink()
    crc = tmp_path / "cp" / "commits" / f".{last}.crc"
    if crc.exists():
        crc.unlink()
    go()
    again = ingest.live_index(spark, str(tmp_path / "store"))
    assert pairs(again.postings, "term", "docid", "tf") == pairs(want.postings, "term", "docid", "tf")
    ingest.compact_lexicon(spark, str(tmp_path / "store"), str(tmp_path / "lex"))
    assert pairs(spark.read.parquet(str(tmp_path / "lex")), "term", "df") == pairs(want.lexicon, "term", "df")
    # a batch that got as far as its postings but not to the ledger is not there for readers
    half = spark.createDataFrame([(9, "d9", ["c", "new"])], "docid bigint, text_id string, tokens array<string>")
    built = index.build(half)
    for name, part in (("documents", built.documents), ("postings", built.postings), ("lexicon", built.lexicon)):
        part.write.parquet(str(tmp_path / "store" / name / "batch_id=77"))
    seen = ingest.live_index(spark, str(tmp_path / "store"))
    assert pairs(seen.postings, "term", "docid", "tf") == pairs(want.postings, "term", "docid", "tf")
    assert pairs(seen.lexicon, "term", "df", "cf") == pairs(want.lexicon, "term", "df", "cf")
    assert pairs(seen.documents, "docid", "length") == pairs(want.documents, "docid", "length")
    shutil.rmtree(tmp_path / "store")


def test_state_and_dry_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("a b a\nb c\n")
    stream = ingest.docstream(spark, str(tmp_path / "in"))
    ingest.dry_run(stream, str(tmp_path / "cp0")).awaitTermination()
    df = ingest.running_df(stream.select(tokenize(stream["value"]).alias("tokens")))
    q = df.writeStream.format("memory").queryName("df_now").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert pairs(spark.table("df_now"), "term", "df") == [("a", 1), ("b", 2), ("c", 1)]
