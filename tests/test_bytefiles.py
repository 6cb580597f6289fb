"""Files that tasks fill and read side by side."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.operators import export, index
from loomdex.sources import bytefiles


def sequences(rng, n):
    return [[rng.randrange(1 << 32) for _ in range(rng.choice([0, 1, 2, 7, 40]))] for _ in range(n)]


def words_of(lists):
    return np.array([w for x in lists for w in (len(x), *x)], "<u4")


@pytest.mark.parametrize("words", [1, 3, 16, 1 << 22])
def test_every_part_size(spark, tmp_path, words):
    lists = sequences(random.Random(words), 30 if words < 16 else 200)
    path = tmp_path / "x.freqs"
    path.write_bytes(words_of(lists).tobytes())
    parts = bytefiles.parts_of(str(path), words)
    assert all(p.hi - p.lo <= words for p in parts) and [p.lo for p in parts[1:]] == [p.hi for p in parts[:-1]]
    reader = bytefiles._Reader(str(path), words)
    got = [r for p in parts for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    want = [(s, k, v) for s, x in enumerate(lists) for k, v in enumerate([len(x), *x])]
    assert got == want
    if words > 3:
        assert sorted(map(tuple, bytefiles.read_sequences(spark, f"file:{path}", words).collect())) == want


def test_empty_and_broken_files(spark, tmp_path):
    for name, data, words in (("empty", b"", None), ("half", b"\1\0\0", "whole words"), ("short", words_of([[1, 2]]).tobytes()[:-4], "within a sequence")):
        (tmp_path / name).write_bytes(data)
        if words:
            with pytest.raises(Exception, match=words):
                bytefiles.read_sequences(spark, str(tmp_path / name)).count()
        else:
            assert bytefiles.read_sequences(spark, str(tmp_path / name)).count() == 0
    with pytest.raises(Exception, match="mount"):
        bytefiles.read_sequences(spark, "hdfs://x/y").count()


def test_a_write_that_lacks_bytes_leaves_no_file(spark, tmp_path):
    rows = spark.createDataFrame([(0, b"abc"), (3, b"de")], "at bigint, data binary")
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="5 bytes were written of 6"):
        bytefiles.write_bytes(rows, path, 6)
    assert os.listdir(tmp_path) == []
    bytefiles.write_bytes(rows.repartition(2), path, 5)
    bytefiles.write_bytes(rows.orderBy(F.desc("at")), path, 5)  # takes the place of the file that is there
    assert open(path, "rb").read() == b"abcde" and os.listdir(tmp_path) == ["out"]
    bytefiles.write_bytes(rows.limit(0), path, 0)
    assert open(path, "rb").read() == b""


def test_written_index_comes_back(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)] + ["ä", "文", "😀", "B"]
    docs = spark.createDataFrame([(d, rng.choice([f"d{d}", None, f"ü{d}"]), [rng.choice(words) for _ in range(rng.randint(0, 9))]) for d in range(1, 300)], "docid bigint, text_id string, tokens array<string>").repartition(4)
    p, base = index.postings(docs), str(tmp_path / "ix")
    sized = docs.select("docid", "text_id", F.size("tokens").cast("bigint").alias("length"))
    export.write_canonical(sized, p, base)
    export.write_interleaved(p, base)
    lists = {}
    for r in p.orderBy("docid").collect():
        lists.setdefault(r["term"], []).append((r["docid"] - 1, r["tf"]))
    terms = sorted(lists, key=str.encode)
    assert open(f"{base}.terms", encoding="utf-8").read().split("\n") == [*terms, ""]
    by = {r["docid"]: r for r in sized.collect()}
    assert open(f"{base}.documents", encoding="utf-8").read() == "".join(f"{by[d]['text_id'] or ''}\n" for d in range(1, 300))
    assert np.fromfile(f"{base}.docs", "<u4").tolist() == [1, 299, *words_of([[d for d, _ in lists[t]] for t in terms]).tolist()]
    assert np.fromfile(f"{base}.freqs", "<u4").tolist() == words_of([[f for _, f in lists[t]] for t in terms]).tolist()
    assert np.fromfile(f"{base}.sizes", "<u4").tolist() == [299, *(by[d]["length"] for d in range(1, 300))]
    gaps = [(d - (lists[t][k - 1][0] if k else 0), f) for t in terms for k, (d, f) in enumerate(lists[t])]
    assert np.fromfile(f"{base}.interleaved", "<u4").reshape(-1, 2).tolist() == [list(g) for g in gaps]
    back = export.read_canonical(spark, base, "docs").where("k > 0").collect()
    assert sorted((terms[r["number"]], r["value"]) for r in back) == sorted((t, d) for t in terms for d, _ in lists[t])


def test_values_beyond_32_bits_are_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1 << 33, "x", ["a"])], "docid bigint, text_id string, tokens array<string>")
    with pytest.raises(Exception, match="32 bits"):
        export.write_interleaved(index.postings(docs), str(tmp_path / "big"))
    assert [n for n in os.listdir(tmp_path) if not n.endswith(".part")] == []
