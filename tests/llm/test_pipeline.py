import hashlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as p

from .test_bpe import coder
from .test_exact_dedup import brute as exact
from .test_ngram_join import brute as near
from .test_ordering_sharding_mixing import brute_mix


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    text = {r["doc_id"]: (r["source"], r["text"]) for r in docs.collect()}
    one = p.language_id(spark, docs, sf)
    left = sorted(r["doc_id"] for r in one.collect())
    assert one.columns == columns and len(left) > 0.95 * len(text)
    keep = sorted({k for _, k, _, _ in exact([(d, text[d][1]) for d in left])})
    two = p.exact_dedup(spark, one, sf).cache()
    assert two.columns == columns and sorted(r["doc_id"] for r in two.collect()) == keep
    keep = sorted({c for *_, c in near([(d, text[d][1]) for d in keep])})
    three = p.near_dedup(spark, two, sf).cache()
    assert three.columns == columns and sorted(r["doc_id"] for r in three.collect()) == keep
    want = Counter({d: t // n for d, n, _, _, t in brute_mix([(d, *text[d]) for d in keep]) if t})
    four = p.mixing(spark, three, sf).cache()
    assert four.columns == columns and Counter(r["doc_id"] for r in four.collect()) == want
    five = p.encoding(spark, four, sf).collect()
    for r in five:
        ids = coder().encode_ordinary(r["text"])
        assert r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    ran = Counter(r["doc_id"] for r in p.run(spark, sf).select("doc_id").collect())
    assert ran == want == Counter(r["doc_id"] for r in five)


def test_edges_pass_every_stage(spark, docs, no_docs, sf):
    for d in (docs, no_docs):
        for _, stage in p.STAGES:
            d = stage(spark, d, sf)
            d.count()
    assert d.count() == 0
    assert [n for n, _ in p.STAGES] == ["language_id", "exact_dedup", "ngram_join", "mixing", "bpe"]


def test_queries_are_registered():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 11)) and len(names) == 10
    assert "pipeline" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
