"""Toxicity as maximum-scoring segments of token log-odds.

Training, on a bounded sample of labelled documents (``per_class`` of each class by a hash of the id, ``sample_chars``
code points of each; near copies count once), counts in how many toxic and clean documents each word occurs and takes
the log-odds with an informative Dirichlet prior (Monroe, Colaresi and Quinn), less 1.645 standard deviations. Words
above zero keep that score, all others have a small negative one, so the score of a passage falls with every word
that says nothing. The scan of Ruzzo and Tompa finds all maximal segments of a whole text in linear time. A segment of
score S in a text of n words has the expected number K * n * exp(-lambda * S) by chance (Karlin and Altschul); lambda
solves the equation of the clean words' scores and K is counted on clean texts. Segments expected less than once are
significant; their excess, lambda * S - ln(K * n), is summed and a logistic curve turns it into a score, which is laid so
that a text at ``PREDICT_AT`` is as likely toxic as not; the curve is fitted to documents
whose words were learned from the other parts of the sample. Beside words the beginnings of words are learned, of
``HEADS`` bytes, as rare forms of a stem are seen too seldom; a word has the largest score of its own and its beginnings'.

Words are runs of letters, and single characters in scripts without spaces (``textarrays.letter_classes``).

Defined results: a null or empty text has no segment and the score of such texts; repeated rows get equal results; very
long texts are whole, a block of bytes at a time; a document with several labels counts as toxic if any says so; of
rows that repeat an id the least text is learned from; of segments with equal sums the shorter, then the earlier;
without toxic and clean labels the score is 0 everywhere; an empty table gives no rows. Labels, language, source and id
are no inputs of a score. Only doc_id, text and toxic are used; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import held_out
from .minhash import signatures
from .textarrays import heads

PER_CLASS, SAMPLE_CHARS = 1500, 20_000
#: Score of a word that says nothing, weight of the prior in words, and words let in by chance.
DRIFT, PRIOR, BY_CHANCE = 0.15, 500.0, 0.5
#: Bytes of the beginnings of words that are learned beside words, as the forms of a stem share them.
HEADS = (3, 4, 5, 6, 7, 8, 10, 12)
PREDICT_AT = 0.7
#: Parts of the sample: the evidence of each, to which the curve is fitted, is by words of the others.
PARTS = 8


@dataclass
class Model:
    hashes: np.ndarray  # sorted
    scores: np.ndarray
    rate: float  # lambda
    k: float
    slope: float
    offset: float

    def score(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-(self.offset + self.slope * evidence))))


def segments(at: np.ndarray, scores: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text whose words at ``at`` have positive scores.

    Ruzzo and Tompa's scan; the words between lower the running sum by ``drift`` each. Each word is pushed and merged
    once.
    """
    out: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    gained = 0.0
    for i, (p, s) in enumerate(zip(at.tolist(), scores.tolist(), strict=True)):
        before = gained - drift * (p - i)
        first, low, high = p, before, before + s
        gained += s
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= low:
                j -= 1
            if j < 0 or out[j][3] >= high:
                out.append((first, p, low, high))
                break
            first, low = out[j][0], out[j][2]
            del out[j:]
    return [(a, b, high - low) for a, b, low, high in out]


def _worth(model: Model, units: np.ndarray) -> np.ndarray:
    """The score of each word: the largest of its own and of its beginnings', 0 without any."""
    best = np.zeros(units.shape[1])
    if len(model.hashes):
        for row in units:
            place = np.minimum(np.searchsorted(model.hashes, row), len(model.hashes) - 1)
            np.maximum(best, np.where(model.hashes[place] == row, model.scores[place], 0), out=best)
    return best


def _scored(model: Model, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, words, places of scoring words, their scores) for each text."""
    row, words, places, scores = -1, 0, [], []
    for lo, _, counts, units in heads(texts, HEADS):
        worth, ends = _worth(model, units), np.cumsum(counts)
        hit = np.flatnonzero(worth)
        cut = np.searchsorted(hit, ends)
        begin = 0
        for k, n in enumerate(counts.tolist()):
            if lo + k != row:  # else a long text goes on
                if row >= 0:
                    yield row, words, np.concatenate(places), np.concatenate(scores)
                row, words, places, scores = lo + k, 0, [], []
            own = hit[begin : cut[k]]
            places.append(own - (ends[k] - n) + words)
            scores.append(worth[own])
            words, begin = words + n, cut[k]
    if row >= 0:
        yield row, words, np.concatenate(places), np.concatenate(scores)


def passages(model: Model, texts: pa.Array) -> list[list[tuple[int, int, float, float]]]:
    """Significant passages of each text: (first word, last word, score, excess)."""
    out: list[list] = [[] for _ in range(len(texts))]
    for row, n, at, scores in _scored(model, texts):
        if len(at):
            chance = np.log(model.k * n)
            out[row] = [(a, b, s, e) for a, b, s in segments(at, scores) if (e := model.rate * s - chance) > 0]
    return out


def _evidence(found: list[tuple[int, int, float, float]]) -> float:
    return float(np.log1p(sum(e for *_, e in found)))


def _learn(seen: list[np.ndarray], y: np.ndarray) -> Model:
    """Words, beginnings, scores and lambda from the sets of both of labelled documents."""
    vocabulary, toxic = np.unique(np.concatenate([s for s, v in zip(seen, y, strict=True) if v]), return_counts=True)
    everything, total = np.unique(np.concatenate(seen), return_counts=True)
    in_all = total[np.searchsorted(everything, vocabulary)]
    clean = in_all - toxic
    share = y.mean()
    gain = toxic * np.log(toxic / (in_all * share)) + clean * np.log(np.maximum(clean, 1e-9) / (in_all * (1 - share)))
    sure = (2 * gain > 2 * np.log(2 * max(1, len(vocabulary)) / BY_CHANCE)) & (toxic > in_all * share)
    n_toxic, n_clean = sum(len(s) for s, v in zip(seen, y, strict=True) if v), sum(len(s) for s, v in zip(seen, y, strict=True) if not v)
    prior = PRIOR * in_all / (n_toxic + n_clean)
    odds = lambda c, n: np.log((c + prior) / (n + PRIOR - c - prior))
    score = odds(toxic, n_toxic) - odds(clean, n_clean) - 1.645 * np.sqrt(1 / (toxic + prior) + 1 / np.maximum(clean + prior, 0.5))
    keep = np.flatnonzero(sure & (score > 4 * DRIFT))
    model = Model(vocabulary[keep], score[keep], 1.0, 1.0, 1.0, 0.0)
    # lambda: mean of exp(lambda * score) over the words of clean texts is 1
    p = (clean[keep] + prior[keep]) / (n_clean + PRIOR)
    low, high = 1e-6, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (1 - p.sum()) * np.exp(-mid * DRIFT) + (p * np.exp(np.minimum(mid * score[keep], 500))).sum() < 1 else (low, mid)
    model.rate = low
    return model


def _count_chance(model: Model, texts: pa.Array, y: np.ndarray) -> None:
    """K from the segments of clean texts that reach the least score of a word."""
    base, found, n = float(model.scores.min()) if len(model.scores) else 1.0, 0, 0
    for row, words, at, s in _scored(model, texts):
        if not y[row]:
            n += words
            found += sum(v >= base for *_, v in segments(at, s))
    model.k = float(np.clip((found + 0.5) / (max(1, n) * np.exp(-model.rate * base)), 1e-3, 1.0))


def fit(rows: list[tuple[str, int]], weights: tuple[float, float] = (1.0, 1.0)) -> Model | None:
    """Train on (text, toxic) rows; weights: how many rows a clean and a toxic one stand for."""
    rows = [(t, y) for t, y in rows if t]
    if len({y for _, y in rows}) < 2:
        return None
    sig = signatures(pa.array([t for t, _ in rows], pa.large_string()))
    fresh: list[int] = []
    for i in range(len(rows)):  # near copies of an earlier row would count a text's words again
        if not fresh or (sig[fresh] == sig[i]).mean(axis=1).max() < 0.5:
            fresh.append(i)
    texts, y = pa.array([rows[i][0] for i in fresh], pa.large_string()), np.array([rows[i][1] for i in fresh])
    seen: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(fresh)
    for lo, _, counts, units in heads(texts, HEADS):
        ends = np.cumsum(counts)
        for i, (c, e) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
            own = np.unique(np.concatenate([seen[lo + i], units[:, e - c : e].ravel()]))
            seen[lo + i] = own[own > 0]
    if not all(any(len(s) for s, v in zip(seen, y, strict=True) if v == k) for k in (0, 1)):
        return None
    model = _learn(seen, y)
    _count_chance(model, texts, y)
    # evidence of each part by the words of the others
    part_of = np.zeros(len(y), int)
    for k in (0, 1):
        part_of[y == k] = np.arange((y == k).sum()) % PARTS
    x = np.zeros(len(y))
    for own in [part_of == k for k in range(PARTS) if (part_of == k).any()]:
        other = ~own if len(set(y[~own].tolist())) == 2 else own
        part = _learn([s for s, o in zip(seen, other, strict=True) if o], y[other])
        _count_chance(part, texts.filter(pa.array(other)), y[other])
        x[own] = [_evidence(f) for f in passages(part, texts.filter(pa.array(own)))]
    w = np.where(y == 1, weights[1], weights[0])
    w = w / w.sum() * len(w)
    z, beta = np.stack([np.ones(len(x)), x], axis=1), np.zeros(2)
    for _ in range(60):  # Newton's steps with a little ridge
        p = 1 / (1 + np.exp(-(z @ beta)))
        v = w * p * (1 - p) + 1e-9
        step = np.linalg.solve((z * v[:, None]).T @ z + 0.1 * np.eye(2), z.T @ (w * (y - p)) - 0.1 * beta)
        beta += np.clip(step, -2, 2)
    # at PREDICT_AT a text is as likely toxic as not
    model.offset, model.slope = float(beta[0] + np.log(PREDICT_AT / (1 - PREDICT_AT))), float(max(beta[1], 0.0))
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_chars: int = SAMPLE_CHARS) -> Model | None:
    """Fit on the bounded sample of labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int")).where(~held_out() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return None
    chosen = {y: [r["doc_id"] for r in known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").limit(per_class).collect()] for y in (0, 1)}
    texts = docs.select(F.col("doc_id").cast("bigint"), F.substring(F.col("text").cast("string"), 1, sample_chars).alias("text"))
    label = {d: y for y, ids in chosen.items() for d in ids}
    own = texts.where(F.col("doc_id").isin(list(label)) & F.col("text").isNotNull())
    rows = sorted(own.groupBy("doc_id").agg(F.min("text").alias("text")).collect())  # one row of an id, however often it is there
    return fit([(r["text"], label[r["doc_id"]]) for r in rows], (totals[0] / len(chosen[0]), totals[1] / len(chosen[1])))


SCORED = "score double, passages array<struct<first_word:bigint,last_word:bigint,points:double,excess:double>>"


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and every significant passage, by its first and last word (runs of letters, from 0)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # words and beginnings of the bounded sample, those of them that pass the test

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("points", pa.float64()), ("excess", pa.float64())]))
        m = sent.value
        for batch in batches:
            found = passages(m, batch.column(1)) if m else [[] for _ in range(batch.num_rows)]
            score = [m.score(_evidence(f)) if m else 0.0 for f in found]
            said = [[dict(zip(("first_word", "last_word", "points", "excess"), map(float, p), strict=True)) | {"first_word": int(p[0]), "last_word": int(p[1])} for p in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(said, kind)], ["doc_id", "score", "passages"])

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.mapInArrow(run, f"doc_id bigint, {SCORED}")
