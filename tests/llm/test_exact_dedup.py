import hashlib
import re

from pyspark.sql import functions as F

from loomdex.llm import exact_dedup as e


def brute(rows):
    groups = {}
    for d, text in rows:
        groups.setdefault(re.sub(r"[ \t\n\x0b\x0c\r]", "", text or ""), []).append((d, len(text or "")))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        out += [(d, keep, len(members), hashlib.sha256(norm.encode()).hexdigest()) for d, _ in members]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in df.collect()), key=str)


def test_edges(docs):
    out = e.exact_duplicates(docs).cache()
    assert rows_of(out) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    kept = [r["doc_id"] for r in out.where("kept").collect()]
    assert len(kept) == len(set(kept)) == out.select("text_sha256").distinct().count()


def test_sample_and_colliding_identifiers(sample):
    want = brute([(r["doc_id"], r["text"]) for r in sample.collect()])
    assert rows_of(e.exact_duplicates(sample)) == want
    assert e.verified(sample.select(e.normalised().alias("_norm")), e.IDENTIFIERS[0])  # md5, once for each chunk
    few = [lambda c: F.pmod(F.xxhash64(c), F.lit(5)), lambda c: c]
    assert not e.verified(sample.select(e.normalised().alias("_norm")), few[0])
    assert rows_of(e.exact_duplicates(sample, few)) == want


def test_chunks_join_to_the_text(sample, docs):
    for d in (sample, docs):
        n = d.select(e.normalised().alias("n"), F.array_join(e.chunks_of(e.normalised()), "").alias("j"))
        assert n.where("n <> j").isEmpty()


def test_hot_group_and_empty(spark, no_docs):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text, over and over.").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    out = e.exact_duplicates(hot)
    assert out.where("group_size = 1000 and keep_id = 0").count() == 1000
    assert out.where("kept").count() == 2001
    assert e.exact_duplicates(no_docs).count() == 0


def test_drop_keeps_columns(docs):
    out = e.drop_duplicates(docs)
    assert out.columns == docs.columns
    assert out.where("doc_id in (2, 4, 5, 6, 7, 8)").count() == 6 and out.where("doc_id in (0, 1)").count() == 0
    assert out.where("doc_id = 14").count() == 1 and out.where("doc_id is null").count() == 1 and out.count() == e.exact_duplicates(docs).where("kept").count()
    unique = docs.dropDuplicates(["doc_id"])
    assert e.drop_duplicates(unique).count() == out.count()
