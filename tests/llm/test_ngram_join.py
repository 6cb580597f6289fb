import random

import pytest
from pyspark.sql import functions as F

from loomdex.llm import ngram_join as j

from .test_textarrays import words_of


def brute(rows):
    sets = []
    for _, text in rows:
        w = words_of(text or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i] = root[root[i]]
        return i

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def rows_of(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def test_edges(docs):
    d = docs.where("doc_id is not null")
    assert rows_of(j.near_components(d)) == brute([(r["doc_id"], r["text"]) for r in d.collect()])


def test_sample(sample):
    assert rows_of(j.near_components(sample)) == brute([(r["doc_id"], r["text"]) for r in sample.collect()])


@pytest.mark.parametrize("seed", [1, 2])
def test_edited_families_with_small_packs(spark, seed):
    """Families around the threshold, a passage that all share, frequent-token marks and blocks of two members."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for f in range(10):
        base = [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(rng.randint(12, 60))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10_000)}"
            if rng.random() < 0.5:
                w += passage
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = j.near_components(d, flush=200, share=4, least=3, block_members=2, **({"bucket_tokens": 50} if seed == 2 else {}))
    assert rows_of(got) == brute(rows)


def test_class_ids_that_different_sets_share(sample, docs):
    """With ids of four bits nearly every class shares its id with others; the checks tell them apart."""
    d = sample.select("doc_id", "text").union(docs.where("doc_id is not null").select("doc_id", "text"))
    assert len(j._counted(d, 4)[2]) > 10
    assert rows_of(j.near_components(d, bits=4)) == brute([(r["doc_id"], r["text"]) for r in d.collect()])


def test_hot_near_copies(spark):
    base = [f"w{k}" for k in range(80)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(300) for k in [i % 80]]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(j.near_components(d)) == brute(rows)


def test_stage_and_empty(docs, no_docs):
    out = j.keep_one(docs)
    assert out.columns == docs.columns and out.where("doc_id = 7").isEmpty() and out.where("doc_id = 6").count() == 1
    assert j.near_components(no_docs).count() == 0


def test_groups_are_spread(spark):
    d = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, "a b c d e f g").otherwise(F.concat_ws(" ", *[F.concat(F.lit(f"v{k}_"), F.col("id").cast("string")) for k in range(6)])).alias("text"))
    out = j.near_components(d)
    assert out.where("component_id = 0").count() == 300 and out.where("component_id <> doc_id").count() == 299
