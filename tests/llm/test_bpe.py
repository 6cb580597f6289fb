import hashlib
import random

import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from loomdex.llm import bpe, queries


def coder():
    return bpe._encoding(bpe._ranks(None), public_tokenizers.PATTERN)


def test_pieces_keep_the_ids():
    c, rng = coder(), random.Random(5)
    bits = ["word", " Word", "  ", "\n", "\n\n", "'s", "n't", "é", "😀", "1", "23 ", "...", "\t", " a", " ", "x y"]
    for _ in range(300):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 200)))
        pieces = list(bpe.safe_pieces(text, 20))
        assert "".join(pieces) == text
        assert [i for p in pieces for i in c.encode_ordinary(p)] == c.encode_ordinary(text)
        assert bpe.encode_text(c, text, 10, 2).tolist() == c.encode_ordinary(text)


BITS = ["word", " Word", "  ", "\n", "\n\n", "'s", "'ll", "''s", "'", "n't", "é", "😀", "1", "23 ", "...", "!'re", "\t", " a", " ", "中文", "，", "。的", "\u3000", "\xa0", "\x1c", "ß9", "x'd"]


@pytest.mark.parametrize("seed", range(4))
def test_every_cut_is_safe(seed):
    c, rng = coder(), random.Random(seed)
    for _ in range(400):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(1, 80)))
        for size, blank in ((1, 2), (3, 3), (17, 2)):
            assert bpe.encode_text(c, text, size, blank).tolist() == c.encode_ordinary(text), text


def by_definition(c, text):
    return [i for m in regex.finditer(public_tokenizers.PATTERN, text) for i in c._encode_single_piece(m[0])]


MILLIONS = 5_000_000


@pytest.mark.parametrize("text", [" " * MILLIONS, "a" + "\n" * MILLIONS, " \n" * (MILLIONS // 2) + "b c", "中" * MILLIONS, "z" * MILLIONS, "7" * 400_000, "." * 400_000, "中文，" * 200_000, "'" * 9 + "s" * 400_000, "e\u0301" * 200_000], ids=lambda x: ascii(x[:3]))
def test_runs_of_millions(text):
    c = coder()
    ids = bpe.encode_text(c, text)
    assert ids.tolist() == by_definition(c, text)
    assert c.decode_bytes(ids.tolist()) == text.encode()


def test_query_takes_white_space_giants(spark):
    texts = ["x" + " " * 1_200_000 + "y", "\n" * 1_200_000, None, "ok"]
    rows = bpe.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for r in rows:
        assert bytes(r["decoded"]) == (texts[r["doc_id"]] or "").encode()


def test_edges_round_trip(docs):
    rows = bpe.round_trip(docs).select("doc_id", "text", "ids", "n_tokens", "decoded", "size", bpe.ids_array().alias("list")).collect()
    assert len(rows) == docs.count()
    c = coder()
    for r in rows:
        want = c.encode_ordinary(r["text"] or "")
        assert r["list"] == want and r["n_tokens"] == len(want) and bytes(r["decoded"]) == (r["text"] or "").encode()
        assert r["size"] == "own size"


def test_special_strings_are_text(spark):
    d = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id bigint, text string")
    r = bpe.decode(bpe.encode(d)).first()
    assert bytes(r["decoded"]).decode() == r["text"] and r["n_tokens"] > 3


def test_query_against_the_library(spark, sf):
    c = coder()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op10_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = c.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_empty(no_docs):
    assert bpe.round_trip(no_docs).count() == 0


@pytest.mark.parametrize("name", ["ids", "n_tokens"])
def test_new_columns_replace_old(docs, name):
    assert bpe.encode(docs).columns.count(name) == 1
    assert bpe.encode(docs).where(F.col(name).cast("string") == f"own {name}").isEmpty()
