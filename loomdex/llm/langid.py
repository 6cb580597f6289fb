"""Language identification by a linear-chain conditional random field over words.

The words of a text are maximal runs of letters of its lower-cased form; in scripts that are written without spaces each
character is a word, so that Chinese next to English is labelled apart (``textarrays.letter_classes``). The
score of a language for a word adds learned weights of its byte trigrams with the word's edges, its first and last four
bytes (affixes) and the whole word (lexicon), each hashed into a table; learned transitions tie neighbouring words, so
that a stretch in another language is labelled as such and a single odd word is not. Forward-backward gives the
posterior of every word of the whole text, exactly: chunks of 64 words are reduced to transfer matrices, the matrices
are chained, and the chunks are finished in parallel. A document's language is the one with the largest mean posterior.

Training takes at most ``per_lang`` documents of each language, and of all languages together about ``most_rows``, chosen
by a hash of the id; of each the first ``sample_chars`` code points (a bounded, documented sample). No language is left
out, however many there are or short its texts. Spans of ten words, a part of them joined across documents, make
code-switched sequences for the transitions.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or where no language was learned; rows
never interact, so repeated rows get equal results; ties go to the language that sorts first; an empty table gives no
rows. Very long texts are whole: they are read in pieces, once forwards and once backwards, with the messages of the
chain handed on, so that memory holds one piece and the result is that of the text in one; a run of letters longer than
a piece is read as several words. Only doc_id, text and lang are used; other columns may have any name.

Some language always has the largest posterior, so the pipeline asks two more things of a text, both a mean over its
words and both relative to the training texts of the languages it is in. The margin of a word's best language over
chance, without its neighbours and without words that touch a digit, must reach ``LEAST_MARGIN`` of the usual margin; and of
its letters, the share whose trigram the training texts hold must reach ``LEAST_KNOWN`` of what a training text has
in common with the others of its language. Code-switched text passes, as each of its words is certain; words of no
learned language do not, however often repeated. A known word repeated is in a known language and stays. With one
language the margin is 1 and the trigrams decide; where each language had a single training text, the margin does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name
from .textarrays import letter_classes

PER_LANG, MOST_ROWS, SAMPLE_CHARS = 150, 20_000, 4000
TABLE_BITS = 15
CHUNK = 64
#: Below these shares of the usual the pipeline rejects a document. Over held-out rows of four test tables and their German
#: and English parts the least were 0.48 and 0.63, 0.05% were below 0.62; of texts of random letters the most were 0.39
#: and 0.19, of Russian and Polish sentences 0.43 and 0.29.
LEAST_MARGIN, LEAST_KNOWN = 0.45, 0.6
_LETTER = regex.compile(r"\p{L}")
#: Code points read at a time, fewer where there are many languages; and where a longer text may be cut.
PIECE = 1 << 20
_CUT = regex.compile(r"[\x00-@\[-`{-\x7f]|(?=[\u3041-\u9fff])")
UND = "und"


def held_out(column: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 1 modulo 3."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(3)) == 1


@dataclass
class Model:
    langs: list[str]
    tables: np.ndarray  # (4, 2^TABLE_BITS, languages)
    bias: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    known: np.ndarray  # a bit for each trigram of bytes: whether the training texts hold it
    coverage: np.ndarray  # per language, the share of a training text's trigrams that others hold
    usual: np.ndarray  # per language, the mean margin over chance of the training texts' words


def _features(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Words of each text; hashed trigrams of all words in a row, where each word's begin; (words, 3) hashes of prefix, suffix and word; the trigrams as numbers of 24 bits; whether a word touches no digit."""
    raw = [x.lower().encode() for x in texts]
    data = np.frombuffer(b"    " + b" ".join(raw) + b"    ", np.uint8)
    sizes = np.array([len(x) for x in raw], np.int64) + 1
    word, cut = letter_classes(data)
    starts, ends = np.flatnonzero(word[1:] & (~word[:-1] | cut[1:-1])) + 1, np.flatnonzero(word[:-1] & (~word[1:] | cut[1:-1])) + 1
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], 4 + np.cumsum(sizes)])))
    clean = np.where(word, data, 32).astype(np.uint32)
    mask = np.uint32((1 << TABLE_BITS) - 1)
    with np.errstate(over="ignore"):
        at = np.flatnonzero(word)
        tri = clean[at - 1] * np.uint32(0x9E3779B1) ^ clean[at] * np.uint32(0x85EBCA6B) ^ clean[at + 1] * np.uint32(0xC2B2AE35)
        tri = (tri ^ (tri >> np.uint32(15))) & mask
        grams = clean[at - 1] << np.uint32(16) | clean[at] << np.uint32(8) | clean[at + 1]
        length = ends - starts
        first = np.cumsum(length) - length
        affix = np.zeros((len(starts), 3), np.uint32)
        for k in range(4):
            inside = length > k
            affix[:, 0] = (affix[:, 0] + np.where(inside, clean[np.minimum(starts + k, len(clean) - 1)], 31)) * np.uint32(0x01000193)
            affix[:, 1] = (affix[:, 1] + np.where(inside, clean[ends - 1 - np.minimum(k, length - 1)], 31)) * np.uint32(0x01000193)
        if len(starts):
            place = np.arange(len(at)) - np.repeat(first, length)
            mixed = (clean[at] + np.uint32(1)) * (np.uint32(0x9E3779B1) * (place.astype(np.uint32) * np.uint32(2) + np.uint32(1)) | np.uint32(1))
            affix[:, 2] = np.add.reduceat(mixed, first)
        affix ^= affix >> np.uint32(13)
        affix *= np.uint32(0x5BD1E995)
        affix = (affix ^ (affix >> np.uint32(15))) & mask
    digit = (data >= 48) & (data <= 57)
    return counts, tri, first, affix, grams, ~(digit[starts - 1] | digit[ends])


def _emissions(model: Model, tri: np.ndarray, first: np.ndarray, affix: np.ndarray) -> np.ndarray:
    out = np.add.reduceat(model.tables[0][tri], first, axis=0) if len(first) else np.zeros((0, len(model.langs)), np.float32)
    for k in range(3):
        out = out + model.tables[k + 1][affix[:, k]]
    return out + model.bias


def _familiar(texts: np.ndarray, label: np.ndarray, grams: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``known`` and ``coverage`` of a model. texts, label: the text and the language of each trigram."""
    known = np.zeros(1 << 24, bool)
    known[grams] = True
    coverage = np.zeros(k)
    for lang in range(k):
        own = label == lang
        met, times = np.unique(grams[own].astype(np.int64) << 32 | texts[own], return_counts=True)  # by text
        _, which, held = np.unique(met >> 32, return_inverse=True, return_counts=True)
        coverage[lang] = times[held[which] > 1].sum() / max(1, times.sum())
    return np.packbits(known, bitorder="little"), coverage


def certainty(model: Model, scores: np.ndarray, first: np.ndarray, grams: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word: how far its best language is above chance, 0 to 1 (0 where it touches a digit), and the share of its trigrams that are known."""
    k = len(model.langs)
    if not len(scores):
        return np.zeros(0), np.zeros(0)
    scores = scores.astype(np.float64)
    top = 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
    seen = model.known[grams >> np.uint32(3)] >> (grams & np.uint32(7)).astype(np.uint8) & 1
    return apart * ((k * top - 1) / (k - 1) if k > 1 else top), np.add.reduceat(seen, first, dtype=np.int64) / np.diff(np.append(first, len(grams)))


def posteriors(model: Model, counts: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Forward-backward over the words of many texts: (words, languages)."""
    return _chained(model, counts, scores)[0]


def _chained(model: Model, counts: np.ndarray, scores: np.ndarray, left: np.ndarray | None = None, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Posteriors, and the messages that the last word sends on and the first word sends back.

    left, right: such messages from the pieces before and after, for a piece of one text.
    """
    n, k = scores.shape
    if not n:
        return np.zeros((0, k)), left, right
    scores = scores.astype(np.float64)
    e = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
    move = np.exp(model.transitions - model.transitions.max()).astype(np.float64)
    begin = np.exp(model.start - model.start.max()).astype(np.float64)
    parts = -(-counts // CHUNK)
    total = int(parts.sum())
    owner = np.repeat(np.arange(len(counts)), parts)
    order = np.arange(total) - np.repeat(np.cumsum(parts) - parts, parts)
    begins = np.repeat(np.cumsum(counts) - counts, parts) + order * CHUNK
    sizes = np.minimum(CHUNK, np.repeat(np.cumsum(counts), parts) - begins)
    by = np.argsort(-sizes, kind="stable")  # chunks that are still going come first
    at, size = begins[by], sizes[by]
    open_at = [int(np.searchsorted(-size, -t, "left")) for t in range(CHUNK)]  # chunks with more than t words
    # transfer matrix of each chunk; its first word takes a transition from the chunk before
    prod = np.tile(np.eye(k), (total, 1, 1))
    for t in range(CHUNK):
        m = open_at[t]
        if not m:
            break
        x = (prod[:m] @ move) * e[at[:m] + t][:, None, :]
        prod[:m] = x / x.sum(axis=(1, 2), keepdims=True)
    back = np.empty(total, np.int64)
    back[by] = np.arange(total)
    prod = prod[back]
    # messages into each chunk from the left (before its first transition) and from the right
    into, outof = np.empty((total, k)), np.ones((total, k))
    base = np.cumsum(parts) - parts
    long = np.argsort(-parts, kind="stable")
    deep = int(parts.max())
    into[base[parts > 0]] = begin if left is None else left
    if right is not None:
        outof[-1] = right
    for c in range(1, deep):
        rows = base[long[: int(np.searchsorted(-parts[long], -c, "left"))]] + c
        prior = rows - 1
        if c == 1 and left is None:
            a = _first_product(prod, prior, begin, move, e, begins, sizes)
        else:
            a = np.einsum("nk,nkj->nj", into[prior], prod[prior])
        into[rows] = a / a.sum(axis=1, keepdims=True)
    for c in range(deep - 2, -1, -1):
        rows = base[long[: int(np.searchsorted(-parts[long], -(c + 1), "left"))]] + c
        b = np.einsum("nkj,nj->nk", prod[rows + 1], outof[rows + 1])
        outof[rows] = b / b.sum(axis=1, keepdims=True)
    # inside the chunks
    alpha, out = np.empty((n, k)), np.empty((n, k))
    a = into[by]
    starts = (order[by] == 0) & (left is None)
    for t in range(CHUNK):
        m = open_at[t]
        if not m:
            break
        x = a[:m] @ move
        if t == 0:
            x[starts[:m]] = begin
        x *= e[at[:m] + t]
        a[:m] = x / x.sum(axis=1, keepdims=True)
        alpha[at[:m] + t] = a[:m]
    b = outof[by]
    for t in range(CHUNK - 1, -1, -1):
        m = open_at[t]
        if not m:
            continue
        g = alpha[at[:m] + t] * b[:m]
        out[at[:m] + t] = g / g.sum(axis=1, keepdims=True)
        y = (b[:m] * e[at[:m] + t]) @ move.T
        b[:m] = y / y.sum(axis=1, keepdims=True)
    return out, alpha[-1], b[back[0]]


def _first_product(prod, rows, begin, move, e, begins, sizes) -> np.ndarray:
    """Message out of first chunks, which begin with the start weights and not with a transition."""
    a = begin * e[begins[rows]]
    a = a / a.sum(axis=1, keepdims=True)
    for t in range(1, CHUNK):  # first chunks that are followed by another are full
        a = (a @ move) * e[begins[rows] + t]
        a = a / a.sum(axis=1, keepdims=True)
    return a


def fit(rows: list[tuple[str, str]], epochs: int = 8, seed: int = 1, span: int = 10, spans: int = 4, rate: float = 0.2, decay: float = 1e-3) -> Model | None:
    """Train on (text, lang) rows by stochastic gradient ascent of the conditional likelihood.

    Every weight has its own falling rate (Adagrad), and the model is the mean over the steps after the first epoch, so
    that no single batch decides it.
    """
    rows = [(t, lang) for t, lang in rows if t and lang is not None and _LETTER.search(t)]
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    k, rng = len(langs), np.random.default_rng(seed)
    counts, tri, first, affix, grams, apart = _features([t for t, _ in rows])
    label = np.repeat([langs.index(lang) for _, lang in rows], counts)
    if len(label) == 0:
        return None
    length = np.diff(np.append(first, len(tri)))
    familiar = _familiar(np.repeat(np.repeat(np.arange(len(rows)), counts), length), np.repeat(label, length), grams, k)
    model = Model(langs, np.zeros((4, 1 << TABLE_BITS, k), np.float32), np.zeros(k, np.float32), np.zeros((k, k)), np.zeros(k), *familiar, np.ones(k))
    # spans of words; a sequence goes on in the same text or, one time in six, elsewhere
    base = np.cumsum(counts) - counts
    begin = np.concatenate([b + np.arange(0, c - c % span, span) for b, c in zip(base, counts, strict=True) if c >= span] + [base[(counts > 0) & (counts < span)]]).astype(np.int64)  # a short text goes on in the next one
    if len(begin) < spans:
        begin = np.resize(np.arange(0, max(1, len(label) - span), max(1, span // 2)), spans)
    squares = np.full_like(model.tables, 1e-2)
    small = [model.bias, model.transitions, model.start]
    small_squares = [np.full_like(w, 1e-2, dtype=np.float64) for w in small]
    mean, steps, late = [np.zeros_like(w, dtype=np.float64) for w in small], 0, np.zeros_like(model.tables, dtype=np.float64)
    for epoch in range(epochs):
        at = np.arange(len(begin) - len(begin) % spans)
        other = rng.random(len(at)) < 1 / 6
        at[other] = rng.integers(0, len(begin), int(other.sum()))
        seqs = begin[at].reshape(-1, spans)
        rng.shuffle(seqs)
        for lo in range(0, len(seqs), 128):
            idx = np.minimum((seqs[lo : lo + 128, :, None] + np.arange(span)).reshape(-1, span * spans), len(label) - 1)
            flat = idx.ravel()
            size = length[flat]
            where = np.repeat(first[flat] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            t3, starts, aff = tri[where], np.cumsum(size) - size, affix[flat]
            post, pairs = _train_posteriors(model, _emissions(model, t3, starts, aff).reshape(*idx.shape, k))
            gold = np.zeros((len(flat), k), np.float32)
            gold[np.arange(len(flat)), label[flat]] = 1
            g = gold - post.reshape(-1, k).astype(np.float32)
            averaged = epoch > 0 or epochs == 1
            for table, index, grad in ((0, t3, np.repeat(g, size, axis=0)), (1, aff[:, 0], g), (2, aff[:, 1], g), (3, aff[:, 2], g)):
                rows_, place = np.unique(index, return_inverse=True)
                step = np.zeros((len(rows_), k), np.float32)
                np.add.at(step, place, grad)
                step -= decay * model.tables[table, rows_] * (step != 0)
                squares[table, rows_] += step * step
                step *= rate / np.sqrt(squares[table, rows_])
                model.tables[table, rows_] += step
                if averaged:
                    late[table, rows_] += steps * step  # a change counts in the mean from its own step on
            n = len(flat)
            y = label[idx]
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            began = np.bincount(y[:, 0], minlength=k) - post[:, 0].sum(axis=0)
            for w, grad, square in zip(small, (g.sum(axis=0) / n, (seen - pairs) / n, began / len(y)), small_squares, strict=True):
                grad = grad - decay * w
                square += grad * grad
                w += 0.1 * grad / np.sqrt(square)
            if averaged:
                steps += 1
                for total, w in zip(mean, small, strict=True):
                    total += w
    if steps:
        model.tables = (model.tables - late / steps).astype(np.float32)
        model.bias, model.transitions, model.start = (m / steps for m in mean)
        model.bias = model.bias.astype(np.float32)
    margin = np.zeros(len(label))
    for lo in range(0, len(label), 1 << 15):
        hi = min(lo + (1 << 15), len(label))
        inside = slice(int(first[lo]), int(first[hi]) if hi < len(first) else len(tri))
        begins = first[lo:hi] - first[lo]
        margin[lo:hi] = certainty(model, _emissions(model, tri[inside], begins, affix[lo:hi]), begins, grams[inside], apart[lo:hi])[0]
    model.usual = np.bincount(label, margin, k) / np.maximum(1, np.bincount(label, minlength=k))
    return model


def _train_posteriors(model: Model, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of equally long sequences, and expected transitions."""
    scores = scores.astype(np.float64)
    e = np.exp(scores - scores.max(axis=2, keepdims=True)) + 1e-30
    move, n = np.exp(model.transitions - model.transitions.max()), scores.shape[1]
    a, b = np.empty_like(e), np.ones_like(e)
    a[:, 0] = np.exp(model.start - model.start.max()) * e[:, 0]
    a[:, 0] /= a[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, n):
        x = (a[:, t - 1] @ move) * e[:, t]
        a[:, t] = x / x.sum(axis=1, keepdims=True)
    for t in range(n - 2, -1, -1):
        x = (b[:, t + 1] * e[:, t + 1]) @ move.T
        b[:, t] = x / x.sum(axis=1, keepdims=True)
    post = a * b
    post /= post.sum(axis=2, keepdims=True)
    joint = a[:, :-1, :, None] * move * (b[:, 1:] * e[:, 1:])[:, :, None, :]
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    return post, joint.sum(axis=(0, 1))


def train(docs: DataFrame, per_lang: int = PER_LANG, most_rows: int = MOST_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model | None:
    """Fit on the bounded sample of the rows that are not held out and have a language.

    Documents of a language in the order of a hash of their ids: the first ``per_lang``, or fewer where so many of each
    language would be more than ``most_rows``, one at least. Rows that repeat an id and a language count as one.
    """
    d = docs.select(F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), F.col("text").cast("string"))
    fit_rows = d.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = fit_rows.select("lang").distinct().count()
    each = max(1, min(per_lang, most_rows // max(1, langs)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = fit_rows.select("doc_id", "lang").withColumn("_n", F.dense_rank().over(order)).where(F.col("_n") <= each).select("doc_id", "lang").distinct()
    chosen = fit_rows.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")  # at most ``each`` ids of a language
    rows = chosen.groupBy("doc_id", "lang").agg(F.min(F.substring("text", 1, sample_chars)).alias("text")).collect()
    return fit([(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["lang"]))])


def _grouped(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` code points together."""
    lo = total = 0
    for hi, t in enumerate(texts):
        if total and total + len(t) > most:
            yield lo, hi
            lo, total = hi, 0
        total += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _pieces(text: str, most: int) -> list[str]:
    """A long text cut where a word ends; a run of letters without an end is cut after another ``most``."""
    out, at = [], 0
    while len(text) - at > most:
        found = _CUT.search(text, at + most, at + 2 * most)
        end = found.start() if found else at + 2 * most
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def _long_means(model: Model, text: str, most: int) -> tuple[np.ndarray, int]:
    """Mean posteriors, certainty and share apart from digits of the words of a long text, a piece at a time, and the number of words."""
    pieces, into, message = _pieces(text, most), [], None
    for piece in pieces:
        into.append(message)
        counts, *parts, _, _ = _features([piece])
        message = _chained(model, counts, _emissions(model, *parts), left=message)[1]
    total, n, message = np.zeros(len(model.langs) + 3), 0, None
    for piece, left in zip(reversed(pieces), reversed(into), strict=True):
        counts, *parts, grams, apart = _features([piece])
        scores = _emissions(model, *parts)
        post, _, message = _chained(model, counts, scores, left, message)
        total += np.column_stack([post, *certainty(model, scores, parts[1], grams, apart), apart]).sum(axis=0)
        n += len(scores)
    return total / max(1, n), n


def predict(model: Model | None, texts: list[str | None], piece: int = PIECE) -> tuple[list[str], list[float], list[bool]]:
    """The language of each text, its mean posterior, and whether the text is in a learned language at all."""
    langs, scores, sure = [UND] * len(texts), [0.0] * len(texts), [False] * len(texts)
    if model is None:
        return langs, scores, sure
    most = max(64, min(piece, piece * 8 // len(model.langs)))

    def decide(i: int, mean: np.ndarray) -> None:
        if _LETTER.search(texts[i]):
            posterior, margin, known = mean[:-3], mean[-3] / max(mean[-1], 1e-9), mean[-2]
            best = int(posterior.argmax())
            langs[i], scores[i] = model.langs[best], float(min(1.0, max(0.0, posterior[best])))
            sure[i] = bool(margin >= LEAST_MARGIN * (posterior @ model.usual) and known >= LEAST_KNOWN * (posterior @ model.coverage))

    for lo, hi in _grouped([t or "" for t in texts], most):
        if hi - lo == 1 and len(texts[lo] or "") > most:
            mean, n = _long_means(model, texts[lo], most)
            if n:
                decide(lo, mean)
            continue
        counts, *parts, grams, apart = _features([t or "" for t in texts[lo:hi]])
        each = _emissions(model, *parts)
        seen = np.column_stack([posteriors(model, counts, each), *certainty(model, each, parts[1], grams, apart), apart])
        sums = np.concatenate([np.zeros((1, seen.shape[1])), np.cumsum(seen, axis=0)])
        ends = np.cumsum(counts)
        means = (sums[ends] - sums[ends - counts]) / np.maximum(counts, 1)[:, None]
        for i in np.flatnonzero(counts).tolist():
            decide(lo + i, means[i])
    return langs, scores, sure


def identify(docs: DataFrame, model: Model | None, lang: str = "lang_pred", score: str = "lang_score", sure: str | None = None) -> DataFrame:
    """Add the predicted language and its mean posterior, and under the name ``sure`` whether it is one of the learned languages; every column stays, nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size for each learned language
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                langs, scores, passed = predict(sent.value, part.column(at).to_pylist())
                new = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *[pa.array(passed, pa.bool_())] * bool(sure)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, lang, score, *[sure] * bool(sure)])

    new = [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType()), *([T.StructField(sure, T.BooleanType())] if sure else [])]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *new]))


def word_runs(model: Model, text: str) -> list[tuple[str, int]]:
    """Languages of a code-switched text as runs: (language, number of words)."""
    counts, *parts, _, _ = _features([text])
    best = posteriors(model, counts, _emissions(model, *parts)).argmax(axis=1)
    out: list[tuple[str, int]] = []
    for i in best.tolist():
        if out and out[-1][0] == model.langs[i]:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((model.langs[i], 1))
    return out


def keep_identified(docs: DataFrame, **sample) -> DataFrame:
    """Documents in learned languages, one or several, with all their columns."""
    lang, score, sure = free_name(docs, "_lang_pred"), free_name(docs, "_lang_score"), free_name(docs, "_lang_sure")
    return identify(docs, train(docs, **sample), lang, score, sure).where(sure).select(*[F.col(f"`{c}`") for c in docs.columns])
