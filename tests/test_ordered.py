"""Lists laid out as words: borders of buffers, blocks and ranges, and what moves for them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.operators import export, index, ordered
from loomdex.sources import bytefiles

SCHEMA = "term string, docid bigint, tf bigint"


def put(rows, size, width):
    out = bytearray(b"\xff" * (size * width))
    for at, data in rows:
        out[at * width : at * width + len(data)] = data
    assert sum(len(d) for _, d in rows) == size * width
    return bytes(out)


@pytest.mark.parametrize(("buffer", "most"), [(1, 1), (7, 3), (50, 10), (1 << 21, 250_000)])
def test_lists_over_all_borders(spark, buffer, most):
    r = random.Random(most)
    lists = {w: sorted(r.sample([1, 2, 3, 32768, 32769, 65536, 65537, 98304, 98305, 1 << 32, *range(40, 80)], r.choice([1, 2, 9, 40]))) for w in ["a", "ab", "b", "ä", "文", "😀", "the", "z"]}
    rows = [(t, d, r.choice([1, 2, 255, 256, 70_000, (1 << 32) - 1])) for t, ds in lists.items() for d in ds]
    r.shuffle(rows)
    got = ordered.laid(spark.createDataFrame(rows, SCHEMA).repartition(3), buffer, most)
    words, tf = got.words.collect(), {(t, d): f for t, d, f in rows}
    terms = sorted(lists, key=str.encode)
    want = [[w for t in terms for w in (len(lists[t]), *(of(t, d) for d in lists[t]))] for of in (lambda t, d: d - 1, lambda t, d: tf[t, d])]
    assert np.frombuffer(put([(x["at"], x["docs"]) for x in words], got.n_words, 4), "<u4").tolist() == want[0]
    assert np.frombuffer(put([(x["at"], x["freqs"]) for x in words], got.n_words, 4), "<u4").tolist() == want[1]
    assert put([tuple(x) for x in got.lines.collect()], got.n_bytes, 1).decode() == "".join(f"{t}\n" for t in terms)


def test_no_postings_and_values_too_large(spark):
    got = ordered.laid(spark.createDataFrame([], SCHEMA))
    assert (got.n_words, got.n_bytes, got.words.count(), got.lines.count()) == (0, 0, 0, 0)
    for row in (("a", 1 << 33, 1), ("a", 1, 1 << 32), ("a", 0, 1)):
        with pytest.raises(Exception, match="32 bits"):
            ordered.laid(spark.createDataFrame([row], SCHEMA))


@pytest.mark.parametrize("words", [1, 5, 1 << 22])
def test_stretches_are_the_sequences(spark, tmp_path, words):
    r = random.Random(words)
    lists = [[r.randrange(1 << 32) for _ in range(r.choice([0, 1, 2, 30]))] for _ in range(20)]
    np.array([w for x in lists for w in (len(x), *x)], "<u4").tofile(tmp_path / "x")
    got = bytefiles.read_stretches(spark, str(tmp_path / "x"), words).collect()
    assert sorted((s, k + i, w & 0xFFFFFFFF) for s, k, ws in got for i, w in enumerate(ws)) == [(s, k, v) for s, x in enumerate(lists) for k, v in enumerate([len(x), *x])]


def moved(spark):
    """Rows that all stages so far wrote to shuffles."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    empty = gateway.jvm.java.util.ArrayList()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(empty, False, False, gateway.new_array(gateway.jvm.double, 0), empty)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}


def test_lists_are_written_and_read_without_moving_postings(spark, tmp_path):
    d = spark.range(1, 3001).select(F.col("id").alias("docid"), F.col("id").cast("string").alias("text_id"), F.lit(20).cast("bigint").alias("length"))
    p = d.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.concat(F.lit("w"), k.cast("string")))).alias("term"), "docid", F.lit(1).cast("bigint").alias("tf"))
    before = moved(spark)
    export.write_canonical(d, p, str(tmp_path / "ix"))
    assert export.read_named(spark, str(tmp_path / "ix"), "docs").count() == p.count() + 20
    assert sum(n for s, n in moved(spark).items() if s not in before) < p.count() / 2  # several times all postings before


def test_named_lists(spark, tmp_path):
    docs = spark.createDataFrame([(1, "1", ["b", "a", "b"]), (2, "2", []), (3, "3", ["ä", "b"])], "docid bigint, text_id string, tokens array<string>")
    export.write_canonical(docs.select("docid", "text_id", F.size("tokens").cast("bigint").alias("length")), index.postings(docs), str(tmp_path / "ix"))
    got = {kind: sorted(map(tuple, export.read_named(spark, str(tmp_path / "ix"), kind).collect())) for kind in ("docs", "freqs")}
    assert got == {"docs": [("a", 0, 1), ("a", 1, 0), ("b", 0, 2), ("b", 1, 0), ("b", 2, 2), ("ä", 0, 1), ("ä", 1, 2)], "freqs": [("a", 0, 1), ("a", 1, 1), ("b", 0, 2), ("b", 1, 2), ("b", 2, 1), ("ä", 0, 1), ("ä", 1, 1)]}
