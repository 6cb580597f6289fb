"""Language identification and toxicity: held-out accuracy, exactness of the scans, edges."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomdex.llm import langid, queries, toxicity


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.fixture(scope="module")
def texts(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(texts):
    return langid.train(texts)


def test_language_held_out_accuracy(spark, texts):
    rows = queries.op9_langid(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in texts.collect()}
    assert len(rows) == len(lang) and all(r["held_out"] == held(r["doc_id"]) for r in rows)
    own = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(own) > 0.99 and all(0 <= r["score"] <= 1 for r in rows)


def test_forward_backward_is_exact(model):
    rng = np.random.default_rng(0)
    counts = np.array([3, 0, 64, 65, 200, 1, 129])
    scores = rng.normal(size=(counts.sum(), len(model.langs))) * 2
    got, at = langid.posteriors(model, counts, scores), 0
    for n in counts.tolist():
        if n:
            want, _ = langid._train_posteriors(model, scores[at : at + n][None])
            assert np.allclose(want[0], got[at : at + n], atol=1e-9)
        at += n


def test_small_chain_against_all_paths(model):
    from itertools import product

    k = len(model.langs)
    scores = np.random.default_rng(1).normal(size=(4, k))
    weight = np.zeros((4, k))
    for path in product(range(k), repeat=4):
        s = model.start[path[0]] + sum(scores[i, p] for i, p in enumerate(path)) + sum(model.transitions[a, b] for a, b in zip(path, path[1:]))
        for i, p in enumerate(path):
            weight[i, p] += np.exp(s)
    assert np.allclose(langid.posteriors(model, np.array([4]), scores), weight / weight.sum(axis=1, keepdims=True), atol=1e-6)


def test_code_switched_text(model, texts):
    one = {r["lang"]: r["text"][:300] for r in texts.where(F.length("text") > 600).collect()}
    runs = langid.word_runs(model, one["en"] + " " + one["de"] + " " + one["fr"])
    assert [lang for lang, n in runs if n > 5] == ["en", "de", "fr"]


def test_scripts_without_spaces_switch_inside_a_run_of_letters():
    latin, han = "the quick brown fox jumps over a lazy dog again", "人人生而自由在尊严和权利上一律平等他们赋有理性和良心"
    m = langid.fit([(latin, "en"), (han, "zh")] * 20)
    runs = langid.word_runs(m, han[3:20] + "quick" + han[5:12] + "，lazy dog again the")
    assert [lang for lang, _ in runs] == ["zh", "en", "zh", "en"] and runs[0][1] == 17


def test_long_texts_in_pieces(model, texts):
    some = [r["text"] for r in texts.where(F.length("text") > 900).orderBy("doc_id").limit(12).collect()]
    some += ["中文 and English " * 60, "x" * 4000, " " * 900, "ü" * 3000 + " das ist", "".join(some[:3])]
    whole, parts = langid.predict(model, some), langid.predict(model, some, piece=150)
    near = [k for k in range(len(some)) if "x" * 999 not in some[k] and "ü" * 999 not in some[k]]
    assert whole[0] == parts[0] and whole[2] == parts[2]
    assert np.allclose([whole[1][k] for k in near], [parts[1][k] for k in near], atol=1e-9)
    for piece in (97, 300, 1000):
        assert all("".join(langid._pieces(t, piece)) == t for t in some)


def test_very_long_texts_in_little_memory(model, texts):
    import resource

    text = texts.where("lang = 'de'").orderBy(F.length("text").desc()).first()["text"] + " "
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    giants = [text * (6_000_000 // len(text)), "中" * 1_000_000, "q" * 5_000_000]
    assert langid.predict(model, giants)[0][0] == "de"
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # kB


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(4)
    rows = []
    for lang in range(40):
        own = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)]
        rows += [(lang * 100 + i, " ".join(rng.choice(own, 5 if lang % 2 else 40)), f"l{lang:02}") for i in range(30)]
    d = spark.createDataFrame(rows + rows[:1] * 500, "doc_id bigint, text string, lang string")
    m = langid.train(d)
    assert len(m.langs) == 40
    got, *_ = langid.predict(m, [t for _, t, _ in rows])
    assert all(np.mean([g == lang for g, (_, _, lang) in zip(got, rows) if lang == own]) > 0.9 for own in m.langs)
    assert len(langid.train(d, most_rows=40).langs) == 40


def test_language_edges(docs, no_docs, model):
    out = langid.identify(docs.select("doc_id", "text"), model)
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["lang_score"] == 0 for k in (0, 1, 2, 13, 15))
    assert got[9]["lang_pred"] == "de" and out.count() == docs.count()
    assert langid.identify(docs.select("doc_id", "text"), None).where("lang_pred <> 'und'").isEmpty()
    assert langid.train(no_docs) is None and langid.train(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (0, 1, 2, 13)").isEmpty()
    assert langid.keep_identified(no_docs).count() == 0


def test_pipeline_drops_junk_and_keeps_code_switched_text(spark, texts):
    rng = np.random.default_rng(6)
    letters = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    junk = ["spam " * 300, "x", "aaaaaaaa " * 40, " ".join(letters("abcdefghijklmnopqrstuvwxyz", 7) for _ in range(100)), " ".join(letters("0123456789abcdef", 32) for _ in range(30))]
    junk += ["все люди рождаются свободными и равными в своем достоинстве и правах", "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw"]
    one = {r["lang"]: r["text"].split() for r in texts.where(F.length("text") > 1500).where(langid.held_out()).collect()}
    good = [" ".join(w[:30]) for w in one.values()] + [" ".join(" ".join(w[:30]) for w in one.values()), " ".join(" ".join(w[k : k + 6]) for k in range(0, 60, 6) for w in one.values())]
    made = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(junk + good)], "doc_id bigint, text string, lang string")
    for known in (texts, texts.where("lang in ('de', 'en')"), texts.where("lang = 'en'")):
        kept = {r["doc_id"] for r in langid.keep_identified(known.select("doc_id", "text", "lang").union(made)).where("doc_id < 0").select("doc_id").collect()}
        n = known.select("lang").distinct().count()
        assert n == 1 or not kept & {-1 - i for i in range(len(junk))}
        # hexadecimal digits are single letters, which trigrams alone do not tell from words
        assert n > 1 or kept & {-1 - i for i in range(len(junk))} <= {-5}
        assert n < 4 or {-1 - i for i in range(len(junk), len(junk + good))} <= kept
    assert langid.keep_identified(texts).count() > 0.99 * texts.count()


def brute_segments(s):
    """Ruzzo and Tompa's definition: take the best segment, then the same left and right of it; ties to the shorter."""
    best = max(((sum(s[a:b]), -(b - a), -a) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a = -best[2]
    b = a - best[1]
    return brute_segments(s[:a]) + [(a, b - 1, best[0])] + [(x + b, y + b, v) for x, y, v in brute_segments(s[b:])]


def test_all_maximal_segments():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        hit = rng.random(n) < 0.3
        score = np.where(hit, rng.integers(1, 40, n) / 8, -0.25)
        at = np.flatnonzero(hit)
        got = toxicity.segments(at, score[at], drift=0.25)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(score.tolist())]
        assert np.allclose([v for *_, v in got], [v for *_, v in brute_segments(score.tolist())])


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op7_toxicity(spark, sf).collect()
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    own = [(toxic[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    bad, good = [s for y, s, _ in own if y], [s for y, s, _ in own if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good])
    assert auc > 0.8
    assert np.mean([p for y, _, p in own if y]) >= 0.75 and np.mean([p for y, _, p in own if not y]) < 0.05


def test_toxicity_recall_of_rare_forms(spark):
    """Most toxic words of other languages than English are rare forms of a stem, in a tenth of the larger table."""
    sf = "/root/testdata/sf0.1"
    rows = queries.op7_toxicity(spark, sf).collect()
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    own = [(toxic[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert np.mean([p for y, p in own if y]) >= 0.9 and np.mean([p for y, p in own if not y]) < 0.015


def test_beginnings_of_words_in_whole_and_long_texts(monkeypatch):
    """``heads`` against plain Python, with texts that take several blocks and words that take several blocks."""
    from loomdex.llm import textarrays

    rng, letters = random.Random(6), ["a", "B", "é", "ñ", "文", "ß", " ", ".", "!", "😀", "\n", "abc", "Réeux", "字字"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["", "x" * 300 + " yy", "é" * 200, "." * 300, "😀" * 90 + "é", "ab " * 90]
    whole = {}
    for size in (1 << 20, 64):
        monkeypatch.setattr(textarrays, "BLOCK", size)
        got = [[] for _ in texts]
        for lo, hi, counts, units in textarrays.heads(pa.array(texts), (3, 5)):
            ends = np.cumsum(counts)
            for k in range(hi - lo):
                got[lo + k] += units[:, ends[k] - counts[k] : ends[k]].T.tolist()
        words = [[] for _ in texts]
        for lo, hi, counts, hashes in textarrays.words(pa.array(texts), letters=True):
            ends = np.cumsum(counts)
            for k in range(hi - lo):
                words[lo + k] += hashes[ends[k] - counts[k] : ends[k]].tolist()
        assert [[u[0] for u in g] for g in got] == words
        whole[size] = got
    assert whole[64] == whole[1 << 20]
    a, b = (next(iter(textarrays.heads(pa.array([t]), (6, 3))))[3].T.tolist() for t in ("réeux réeuxan reeux", "réeuxpa abc abcd"))
    assert a[0][1] == 0 and a[1][1] == b[0][1] != 0 and b[1][2] == 0 and b[2][2] != 0


def test_toxicity_edges(spark, docs, no_docs):
    rows = [("you stupid worthless idiot " + "plain words follow here " * (k % 5), 1) for k in range(40)] + [(f"plain words follow here and number {k} more", 0) for k in range(400)]
    assert toxicity.fit(rows[:40]) is None
    varied = [(" ".join(t.split() + [f"u{k}{j}" for j in range(40)]), y) for k, (t, y) in enumerate(rows)]
    m = toxicity.fit(varied, (1.0, 1.0))
    out = toxicity.score_documents(docs, m)
    assert out.count() == docs.count() and toxicity.score_documents(no_docs, m).count() == 0
    said = toxicity.passages(m, pa.array(["a b c you stupid worthless idiot d e f", "", "plain words"]))
    assert len(said[0]) == 1 and said[0][0][0] >= 3 and said[0][0][1] == 6 and said[1] == said[2] == []
    assert toxicity.score_documents(docs, None).where("score <> 0").isEmpty()
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.train(docs, none) is None
