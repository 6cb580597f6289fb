"""Alignment of two tokenizers against the libraries and a plain Python walk over the bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomdex.llm import crosstok

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_products", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    t = Tokenizer.from_file(public_tokenizers.path(crosstok.BYTE_BPE))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(crosstok.PIECES))


def walk(text, libraries):
    """Spans (id, start, end) of both sides, none where a side does not spell space and text."""
    t, sp = libraries
    values = crosstok.byte_values()
    said = (" " + (text or "")).encode()
    a = [(i, bytes(values[c] for c in t.id_to_token(i))) for i in t.encode(" " + (text or ""), add_special_tokens=False).ids]
    b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("\u2581", " ").encode()) for i in sp.encode(text or "")]
    if not text or any(b"".join(x for _, x in side) != said for side in (a, b)):
        return [], []
    out = []
    for side in (a, b):
        at, spans = 0, []
        for i, x in side:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def plain(texts, libraries):
    """The rows by their definition."""
    walked = [walk(t, libraries) for t in texts]
    links = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] for a, b in walked]
    count = Counter(p for x in links for p in x)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    rows = []
    for (a, b), own in zip(walked, links, strict=True):
        shared = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = [([x[0] for x in a if lo < x[2] <= hi], [y[0] for y in b if lo < y[2] <= hi]) for lo, hi in zip([0, *shared], shared, strict=False)]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(a), len(b), len(groups), len(own), sum(count[p] == top[p[1]] for p in own), sum(count[p] for p in own), sum(len(x) * len(y) for x, y in groups), hashlib.sha256(shown.encode()).hexdigest() if shown else ""))
    return rows


def odd_texts(n, seed=3):
    r = random.Random(seed)
    parts = ["the ", "quick", "ünter", " ", "  ", "\n", "\t", "😀", "e\u0301", "中文字", "12345", "it's", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "\u2581", "\xa0", "\ufeff", "ﬁ", "\0", "!!", "internationalisation", "हिन्दी", "ไทย"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_definition(spark, docs, libraries):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if not r["text"] or len(r["text"]) < 1000]
    rows += [(1000 + k, t) for k, t in enumerate(odd_texts(150))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    order = [(r["doc_id"], r["text"]) for r in df.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    want = sorted([(i, *w) for (i, _), w in zip(order, plain([t for _, t in order], libraries), strict=True)], key=key)
    for chunk in (40, crosstok.CHUNK):
        got = crosstok.align(df, chunk=chunk).select("doc_id", *COLUMNS).collect()
        assert sorted(map(tuple, got), key=key) == want


def test_pair_counts(spark, libraries):
    texts = odd_texts(40, 9)
    got = crosstok.pair_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    count = Counter((x[0], y[0]) for a, b in (walk(t, libraries) for t in texts) for x in a for y in b if x[1] < y[2] and y[1] < x[2])
    assert {(r["a"], r["b"]): r["count"] for r in got} == dict(count)
    assert all(r["best"] == (r["count"] == max(n for (_, y), n in count.items() if y == r["b"])) for r in got)


def test_groups_hold_the_text(spark, docs, libraries):
    got = crosstok.tokens(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert len(got) == docs.count()
    for r in got:
        text = texts[r["doc_id"]]
        a, b = walk(text, libraries)
        assert [i for g in r["groups"] for i in g["a"]] == [x[0] for x in a]
        assert [i for g in r["groups"] for i in g["b"]] == [y[0] for y in b]
        ends = [g["end"] for g in r["groups"]]
        assert [g["start"] for g in r["groups"]] == [0, *ends][:-1][: len(ends)]
        assert ends == sorted({x[2] for x in a} & {y[2] for y in b})


def test_long_texts_are_cut_without_effect(libraries):
    t, sp = libraries
    text = " ".join(odd_texts(300, 5)).replace("\u2581", "")
    assert [i for p in crosstok.piece_cuts(text, 50) for i in sp.encode(p)] == sp.encode(text)
    assert len(crosstok.piece_cuts(text, 50)) > 20
    run = "x" * 500 + " " * 500 + "y"
    assert [i for p in crosstok.piece_cuts(run, 10) for i in sp.encode(p)] == sp.encode(run)
    with open(public_tokenizers.path(crosstok.BYTE_BPE), "rb") as f:
        coder, _ = crosstok.byte_level(f.read())
    assert crosstok.encode_text(coder, " " + text, 50).tolist() == t.encode(" " + text, add_special_tokens=False).ids


def test_one_class_of_characters_for_both_libraries(libraries):
    """The rank coder and the tokenizers file split every character alike."""
    with open(public_tokenizers.path(crosstok.BYTE_BPE), "rb") as f:
        coder, _ = crosstok.byte_level(f.read())
    said = [f" a{chr(c)}b 1{chr(c)}2 !{chr(c)} {chr(c)}" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(said), 50_000):
        assert [e.ids for e in libraries[0].encode_batch(said[lo : lo + 50_000], add_special_tokens=False)] == [coder.encode_ordinary(s) for s in said[lo : lo + 50_000]]


def test_places_come_back():
    r = np.random.default_rng(1)
    own = np.unique(r.integers(0, 200_000, 5000))
    times = r.choice([1, 2, 255, 256, 10**12], len(own))
    place, n = crosstok._placed(*crosstok._places(own, times))
    assert place.tolist() == own.tolist() and n.tolist() == times.tolist()


def test_empty_table_and_query(spark, no_docs):
    assert crosstok.align(no_docs).collect() == []
    assert crosstok.tokens(no_docs).collect() == []
    assert crosstok.pair_counts(no_docs).collect() == []


def test_query_against_the_definition(spark, sf, libraries):
    from loomdex.llm.queries import op13_crosstok

    got = {r["doc_id"]: r for r in op13_crosstok(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    short = {i: t for i, t in texts.items() if t is None or len(t) < 1500}
    assert got.keys() == texts.keys()
    for i, t in short.items():
        a, b = walk(t, libraries)
        assert (got[i]["n_a"], got[i]["n_b"]) == (len(a), len(b))
    assert sum(r["n_best"] for r in got.values()) <= sum(r["n_links"] for r in got.values())
