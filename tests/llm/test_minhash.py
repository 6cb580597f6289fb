import hashlib

import numpy as np
import pyarrow as pa
import pytest

from loomdex.llm import minhash as m

from .test_textarrays import words_of


def set_of(text):
    w = words_of(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def likeness(a, b):
    a, b = set_of(a), set_of(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(df, rows):
    """rows: (doc_id, text) in the order that the operator must follow."""
    got = {}
    for r in df.collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    errors = []
    for i, (d, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = next(x for x in got[d] if x["n_chars"] == len(text))
        assert r["edited_sha256"] in [hashlib.sha256(edited.encode()).hexdigest()] or len(got[d]) > 1
        if len(got[d]) == 1:
            errors += [r["near_edited"] - likeness(text, edited), r["near_next"] - likeness(text, after)]
    assert max(map(abs, errors)) < 0.2


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_edges(spark, docs, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
        check(m.edited_neighbours(docs.repartition(3)), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_sample(sample):
    rows = sorted(((r["doc_id"], r["text"]) for r in sample.collect()), reverse=True)
    check(m.edited_neighbours(sample), rows)


def test_fingerprints_of_equal_and_empty(docs, no_docs):
    got = {r["doc_id"]: r["fingerprint"] for r in m.fingerprints(docs).collect()}
    assert got[6] == got[7] and got[0] == got[1] == got[2] == "f" * 512 and got[4] == got[5]
    assert len({got[k] for k in (3, 4, 6, 8, 9, 10)}) == 6
    assert m.edited_neighbours(no_docs).count() == 0 and m.fingerprints(no_docs).count() == 0


def test_estimate_is_unbiased():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        base = [f"w{k}" for k in rng.integers(0, 10_000, 200)]
        cut = int(rng.integers(0, 200))
        a, b = " ".join(base), " ".join(base[:cut] + [f"x{k}" for k in range(200 - cut)])
        s = m.signatures(pa.array([a, b]))
        errors.append((s[0] == s[1]).mean() - likeness(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_near_pairs_are_verified(sample):
    texts = {r["doc_id"]: r["text"] for r in sample.collect()}
    for r in m.near_pairs(sample).collect():
        assert r["jaccard"] >= 0.75 and r["jaccard"] == pytest.approx(likeness(texts[r["a"]], texts[r["b"]]))


def test_near_pairs_against_brute_force(spark):
    rng = np.random.default_rng(12)
    template, texts = [f"t{k}" for k in range(120)], []
    for family in range(12):  # families are unlike each other and share bands by the template
        own = [*template[:60], *(f"f{family}x{k}" for k in range(60))]
        for member in range(6):
            texts.append(" ".join([*own[:-4], *(f"m{family}y{member}z{k}" for k in range(int(rng.integers(1, 5))))]))
    texts += [texts[3], texts[3].upper(), "", None, "  "]
    long = [f"w{k}" for k in range(20_000)]
    texts += [" ".join(long), " ".join([*long[:9000], "other", *long[9001:]])]
    rows = list(enumerate(texts))
    for block in (512, 3):
        got = {(r["a"], r["b"]): r["jaccard"] for r in m.near_pairs(spark.createDataFrame(rows, "doc_id bigint, text string"), block=block).collect()}
        sets, least = [set_of(t) for t in texts], {}
        for i, x in enumerate(sets):
            least.setdefault(frozenset(x), i)
        want = {}
        for i, x in enumerate(sets):
            if least[frozenset(x)] < i:
                want[least[frozenset(x)], i] = 1.0
            else:
                want |= {(j, i): v for j in range(i) if least[frozenset(sets[j])] == j and (v := len(x & sets[j]) / max(1, len(x | sets[j]))) >= 0.75}
        assert got == pytest.approx(want) and len(want) > 100
