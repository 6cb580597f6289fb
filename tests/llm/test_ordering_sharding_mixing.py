import binascii
import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomdex.llm import mixing, ordering, queries, sharding


def seeded(seed, *values):
    return int(hashlib.md5(":".join([seed, *("" if v is None else str(v) for v in values)]).encode()).hexdigest()[:15], 16)


def test_running_is_a_prefix_sum_with_small_buckets(spark):
    d = spark.range(3000).select((F.col("id") % 3 % 2).alias("g"), F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.floor(F.col("id") / 10).alias("b"))
    rows = ordering.running(d, ["g"], "b", ["k"], "v", "before").collect()
    want = defaultdict(int)
    for r in sorted(rows, key=lambda r: r["k"]):
        assert r["before"] == want[r["g"]]
        want[r["g"]] += r["v"]


def brute_shards(rows, shards):
    """rows: (doc_id, source, text)."""
    by = defaultdict(list)
    for d, s, t in rows:
        raw = (t or "").encode()
        by[(s is not None, s or "")].append((seeded(sharding.SEED, d, len(raw) + 1, binascii.crc32(raw)), d is not None, d or 0, len(raw) + 1, binascii.crc32(raw)))
    order = []
    for s, members in by.items():
        for k, x in enumerate(sorted(members)):
            order.append(((2 * k + 1) / (2 * len(members)), not s[0], s[1], *x))
    order.sort()
    n = len(order)
    out = []
    for g, x in enumerate(order):
        shard = g * shards // n
        out.append((x[5] if x[4] else None, x[6], x[7], shard, g - -(-shard * n // shards)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_in_bucket", [3, 4000])
def test_shards(docs, sample, monkeypatch, rows_in_bucket):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", rows_in_bucket)
    for d in (docs, sample):
        got = sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard(d).collect()), key=str)
        assert got == brute_shards([(r["doc_id"], r["source"], r["text"]) for r in d.collect()], 8)


def test_shards_follow_the_mixture(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"), F.lit("x").alias("text"))
    per = Counter((r["shard"], r["source"]) for r in sharding.shard(d).collect())
    for source in {s for _, s in per}:
        counts = [per[k, source] for k in range(8)]
        assert max(counts) - min(counts) <= 2


def test_empty(no_docs):
    assert sharding.shard(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0
    assert mixing.apply_mix(no_docs).count() == 0


def brute_mix(rows):
    size = lambda t: len(re.findall(r"[^ \t\n\x0b\x0c\r]+", t or ""))
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    total, weight = Counter(), {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    for _, s, t in rows:
        total[s] += size(t)
    target, open_, left = {}, set(names), 1.5 * sum(total.values())
    while True:  # share, cap, share the excess again
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= over
        if not open_:
            break
    out = []
    for s in names:
        members = []
        for d, o, t in rows:
            if o == s:
                marks = len(re.findall(r"[!-@\[-`{-~]", t or ""))
                q = (8 - min(7, marks * 32 // max(1, len(t or "")))) / 8
                members.append((-math.log((seeded(mixing.SEED, d, hashlib.md5((t or "").encode()).hexdigest()) + 1) / 2**60) / q, d is not None, d or 0, size(t)))
        epochs = math.floor(target[s] / total[s]) if total[s] else 0
        rest, before = target[s] - epochs * total[s], 0
        for _, has, d, n in sorted(members):
            taken = (epochs + (before + n / 2 < rest)) * n
            out.append((d if has else None, n, total[s], round(target[s], 6), taken))
            before += n
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_in_bucket", [2, 4000])
def test_mix(docs, sample, monkeypatch, rows_in_bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", rows_in_bucket)
    for d in (docs, sample):
        got = sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mix(d).collect()), key=str)
        assert got == brute_mix([(r["doc_id"], r["source"], r["text"]) for r in d.collect()])


def test_taken_comes_near_the_target(sample):
    for r in mixing.mix(sample).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.max("size").alias("m")).collect():
        assert abs(r["t"] - r["target"]) <= r["m"]


def test_apply_keeps_columns_and_copies(docs, sample):
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(sample).where("copies > 0").collect()}
    assert Counter(r["doc_id"] for r in mixing.apply_mix(sample).select("doc_id").collect()) == want


def test_no_bucket_is_crowded(spark, monkeypatch):
    """Qualities of an eighth, mixed ones, and rows without an id: no bucket has three times its share."""
    met = []
    real = ordering.running

    def spy(df, group, bucket, *args):
        met.append(df.groupBy(*group, bucket).count().collect())
        return real(df, group, bucket, *args)

    for module in (mixing, sharding):
        monkeypatch.setattr(module, "running", spy)
        monkeypatch.setattr(module, "BUCKET_ROWS", 100)
    code = F.concat(F.lit("={}();"), F.col("id").cast("string"))
    plain = F.concat(F.lit("plain words of a text "), F.col("id").cast("string"))
    text = F.when(F.col("id") % 3 > 0, code).otherwise(F.when(F.col("id") % 2 == 0, plain).otherwise(F.concat(plain, code)))
    d = spark.range(6000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, "code").alias("source"), text.alias("text"))
    assert mixing.mix(d).count() == sharding.shard(d).count() == 6000
    assert len(met) == 3
    for buckets in met:
        counts = [r["count"] for r in buckets]
        assert max(counts) < 3 * 100 and len(counts) > 50


def test_apply_mix_tells_rows_of_one_id_apart(spark):
    rows = [(1, "a", "one two three"), (1, "b", "four five"), (1, "b", "six"), (None, "a", "seven eight"), (None, "b", "nine"), (2, "a", "ten"), (3, None, "eleven twelve")] + [(4, "a", "same row again")] * 5 + [(5, "a", None), (5, "b", "a b c d e f g h")]
    d = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    want = Counter()
    for r in mixing.mix(d).collect():
        want[r["doc_id"], r["source"], r["check"]] += r["copies"]
    got = Counter((r["doc_id"], r["source"], r["check"]) for r in mixing.apply_mix(d).withColumn("check", F.md5(F.coalesce("text", F.lit("")))).collect())
    assert got == +want and max(want.values()) > 2


def test_queries_have_the_contract_columns(spark, sf):
    assert queries.op6_sharding(spark, sf).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert queries.op8_mixing(spark, sf).columns == ["doc_id", "size", "source_size", "target", "taken"]
