"""Cross-tokenizer alignment: which tokens of a byte-level BPE and of a sentencepiece model cover the same bytes.

Both tokenizers spell the text with a space before it. The ends of their tokens, as byte offsets, are merged; the bytes
between two neighbouring ends are an elementary interval, which lies in one token of either side, so each interval is
one overlap and the owners come from a binary search. An end that both sides share closes a group. ``tokens`` gives the
groups of every text with their tokens and bytes, ``pair_counts`` how often two ids overlap in the whole corpus, and
``align`` one row for each document, with its links weighed by those counts.

Texts are read in chunks of some millions of characters. A chunk's links become one list of distinct id pairs and, for
each document, places in it; only the lists take part in the count, one row for a pair of a chunk, so that what is
shuffled grows with the chunks and their vocabulary and a pair that every document has is one row of each chunk. The
counts come back to the chunk's list and the documents of the chunk are finished by it.

Defined results: a text that is null or empty, or that a tokenizer does not spell byte by byte (U+2581 stands for a
space), has no tokens and zeros; strings of special tokens are ordinary text; a text of any length is whole, a long one
is cut for the tokenizers where neither can join what is on both sides. Repeated rows give equal rows and their links
count each; ids may be null; of the input only the id and the text are read, so other columns may have any name; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encode_text
from .common import stored

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
#: Code points that are worked on together; a longer text is a chunk of its own.
CHUNK = 1 << 21
#: Texts that the piece model takes at a time.
AT_ONCE = 64
#: Code points from which a text is cut for the piece model.
LONG = 1 << 16
_SPACE = "▁"
#: Separators after a token: next of its side, other side, next group, nothing.
_AFTER = (",", "|", ";", "")


class Side(NamedTuple):
    """A vocabulary: bytes of each id, their lengths, and the decimal id with each separator."""

    spelt: pa.Array
    length: np.ndarray
    shown: pa.Array


def _side(spelt: list[bytes]) -> Side:
    shown = [f"{i}{after}" for i in range(len(spelt)) for after in _AFTER]
    return Side(pa.array(spelt, pa.large_binary()), np.array([len(x) for x in spelt], np.int64), pa.array(shown, pa.large_string()))


def byte_values() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: visible Latin-1 as it is, the other bytes from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(moved)}


@lru_cache(maxsize=2)
def byte_level(data: bytes) -> tuple[tiktoken.Encoding, Side]:
    """The coder of a tokenizers file with a plain byte-level BPE, and its vocabulary.

    Its merges are in the order of their ids, so ranks say the same; anything else is refused.
    """
    file = json.loads(data)
    model, before = file["model"], file["pre_tokenizer"]
    values = byte_values()
    spell = lambda token: bytes(values[c] for c in token)
    vocab = {spell(t): i for t, i in model["vocab"].items()}
    merged = [vocab[spell("".join(m.split(" ") if isinstance(m, str) else m))] for m in model["merges"]]
    plain = before["type"] == "ByteLevel" and not before["add_prefix_space"] and before["use_regex"] and not file["normalizer"]
    if not plain or merged != sorted(merged) or model.get("ignore_merges") or model["type"] != "BPE":
        raise ValueError("not a byte-level BPE whose merges are in the order of their ids")
    spelt = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        spelt[i] = token
    return tiktoken.Encoding("byte level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens={}), _side(spelt)


@lru_cache(maxsize=2)
def pieces(data: bytes) -> tuple[sentencepiece.SentencePieceProcessor, Side, bool]:
    """A piece model, its vocabulary, and whether texts may be cut before spaces: no piece has a space after a letter."""
    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    spelt = [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace(_SPACE, " ").encode() for i, x in enumerate(names)]
    return model, _side(spelt), not any(_SPACE in x.lstrip(_SPACE) for x in names)


def piece_cuts(text: str, size: int = LONG) -> list[str]:
    """Parts of a text between which a space was, each to be encoded with the space that the model adds."""
    parts, at = [], 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while 0 <= cut and text[cut - 1] in " " + _SPACE:
            cut = text.find(" ", cut + 1)
        if cut < 0 or cut + 1 == len(text):
            break
        parts.append(text[at:cut])
        at = cut + 1
    return [*parts, text[at:]]


def encoded(texts: list[str], a: bytes, b: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids of each text on either side; none where a side does not spell space and text."""
    coder, left, (model, right, safe) = *byte_level(a), pieces(b)

    def pieced() -> Iterator[np.ndarray]:
        for lo in range(0, len(texts), AT_ONCE):
            parts = [piece_cuts(t) if safe else [t] for t in texts[lo : lo + AT_ONCE]]
            found = iter(model.encode([p for x in parts for p in x], num_threads=1))
            for part in parts:
                yield np.concatenate([np.array(next(found), np.int64) for _ in part])

    ids_a, ids_b, none = [], [], np.zeros(0, np.int64)
    for text, y in zip(texts, pieced(), strict=True):
        said = f" {text}".encode("utf-8", "replace")
        spells = lambda side, ids: side.spelt.take(pa.array(ids)).buffers()[2].to_pybytes() == said
        if not text or left.length.size == 0 or right.length[y].sum() != len(said) or not spells(right, y):
            ids_a.append(none), ids_b.append(none)
            continue
        x = encode_text(coder, f" {text}").astype(np.int64)
        whole = spells(left, x)
        ids_a.append(x if whole else none), ids_b.append(y if whole else none)
    return ids_a, ids_b


class Aligned(NamedTuple):
    """Texts of a chunk laid end to end. ends_*: byte offsets where tokens end; owner_*: the token of each elementary
    interval; shared: where groups end; group_*: the group of each token; first_*: the first token of each text, and
    the number of tokens at last; likewise first_link and first_group."""

    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    owner_a: np.ndarray
    owner_b: np.ndarray
    shared: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    first_link: np.ndarray
    first_group: np.ndarray


def overlaps(ids_a: list[np.ndarray], ids_b: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> Aligned:
    """Elementary intervals of many texts at once: all of them end in a shared end, so none reaches into the next."""
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (ids_a, ids_b))
    ends_a, ends_b = np.cumsum(left[a]), np.cumsum(right[b])
    ends = np.union1d(ends_a, ends_b)
    owner_a, owner_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    shared = ends[(ends_a[owner_a] == ends) & (ends_b[owner_b] == ends)] if len(ends) else ends
    first = lambda ids: np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    first_a, first_b = first(ids_a), first(ids_b)
    text_ends = np.concatenate([[0], ends_a])[first_a]
    below = lambda x: np.searchsorted(x, text_ends, "right")
    return Aligned(a, b, ends_a, ends_b, owner_a, owner_b, shared, np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b), first_a, first_b, below(ends), below(shared))


def group_strings(x: Aligned, left: Side, right: Side) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text: decimal ids, groups in order."""
    n = len(x.shared)
    # tokens in the order in which they are shown: the A side of a group, then its B side
    at_a = np.arange(len(x.a)) + np.searchsorted(x.group_b, x.group_a)
    at_b = np.arange(len(x.b)) + np.searchsorted(x.group_a, x.group_b, "right")
    last = lambda group: np.append(group[1:] != group[:-1], [True] * (len(group) > 0))
    closes = np.zeros(n, bool)
    closes[x.first_group[1:][x.first_group[1:] > x.first_group[:-1]] - 1] = True  # last groups of texts
    code = np.empty(len(x.a) + len(x.b), np.int64)
    code[at_a] = x.a * 4 + last(x.group_a)
    code[at_b] = x.b * 4 + np.where(last(x.group_b), np.where(closes[x.group_b], 3, 2), 0) if n else 0
    from_b = np.zeros(len(code), bool)
    from_b[at_b] = True
    shown = pa.chunked_array([left.shown, right.shown]).combine_chunks()
    taken = shown.take(pa.array(code + np.where(from_b, len(left.shown), 0)))
    offsets, data = np.frombuffer(taken.buffers()[1], np.int64), taken.buffers()[2] or pa.py_buffer(b"")
    bounds = offsets[x.first_a + x.first_b] if len(code) else np.zeros(len(x.first_a), np.int64)
    whole = memoryview(data)
    return [bytes(whole[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]


def _chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of rows (id, text), some millions of code points at a time."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids.append(i), texts.append(t or "")
                held += len(texts[-1])
                if held >= size:
                    yield ids, texts
                    ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _files(df: DataFrame, a: str | None, b: str | None):
    """The two files as broadcasts: one vocabulary each, a megabyte or two."""
    read = lambda path: open(path, "rb").read()  # noqa: E731, SIM115
    context = df.sparkSession.sparkContext
    return context.broadcast(read(a or public_tokenizers.path(BYTE_BPE))), context.broadcast(read(b or public_tokenizers.path(PIECES)))


def tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """(doc_id, groups): groups in order, each (start, end, a, b): byte offsets in space and text, and the ids of both sides."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    file_a, file_b = _files(docs, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = byte_level(file_a.value)[1], pieces(file_b.value)[1]
        for ids, texts in _chunks(batches):
            x = overlaps(*encoded(texts, file_a.value, file_b.value), left.length, right.length)
            base = np.repeat(np.concatenate([[0], x.ends_a])[x.first_a[:-1]], np.diff(x.first_group))
            starts = np.concatenate([[0], x.shared])[:-1]
            listed = lambda group, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(group, np.arange(len(x.shared) + 1)), pa.int32()), pa.array(values, pa.int32()))
            spans = [pa.array(starts - base, pa.int64()), pa.array(x.shared - base, pa.int64())]
            groups = pa.StructArray.from_arrays([*spans, listed(x.group_a, x.a), listed(x.group_b, x.b)], ["start", "end", "a", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(x.first_group, pa.int32()), groups)], ["doc_id", "groups"])

    return rows.mapInArrow(run, "doc_id bigint, groups array<struct<start:bigint,end:bigint,a:array<int>,b:array<int>>>")


_SEEN = "chunk string, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_products bigint, groups_sha256 string, near binary, far binary, times binary, often binary, pairs binary, links binary"
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _places(own: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """A document's ascending places and how often it has each: places in two bytes, then those above in four; numbers in
    one byte, where 0 sends to the next of the eight-byte ones."""
    mid, large = np.searchsorted(own, 1 << 16), times > 255
    return own[:mid].astype("<u2").tobytes(), own[mid:].astype("<u4").tobytes(), np.where(large, 0, times).astype("u1").tobytes(), times[large].astype("<i8").tobytes()


def _placed(near: bytes, far: bytes, times: bytes, often: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Back from ``_places``."""
    n = np.frombuffer(times, "u1").astype(np.int64)
    n[n == 0] = np.frombuffer(often, "<i8")
    return np.concatenate([np.frombuffer(near, "<u2"), np.frombuffer(far, "<u4")]).astype(np.int64), n


def seen(docs: DataFrame, a: str | None = None, b: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """A row for each document, its links as places in the list of its chunk, and one for each chunk with that list."""
    file_a, file_b = _files(docs, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = byte_level(file_a.value)[1], pieces(file_b.value)[1]
        schema = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in _SEEN.split(", ")])
        batch = lambda columns: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        for ids, texts in _chunks(batches, chunk):
            x = overlaps(*encoded(texts, file_a.value, file_b.value), left.length, right.length)
            count, links = len(ids), np.diff(x.first_link)
            pairs, place, n = np.unique(x.a[x.owner_a] << 32 | x.b[x.owner_b], return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")  # frequent pairs first, so that places are small numbers
            pairs, n, place = pairs[order], n[order], np.argsort(order)[place]
            width = max(1, len(pairs))
            own, times = np.unique(np.repeat(np.arange(count), links) * width + place, return_counts=True)
            cut = np.searchsorted(own, np.arange(count + 1) * width)
            packed = [_places(own[lo:hi] % width, times[lo:hi]) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
            products = np.bincount(x.group_a, minlength=len(x.shared)) * np.bincount(x.group_b, minlength=len(x.shared))
            products = np.diff(np.concatenate([[0], np.cumsum(products)])[x.first_group])
            digest = [hashlib.sha256(s).hexdigest() if s else "" for s in group_strings(x, left, right)]
            name, null = uuid.uuid4().hex, [None]
            yield batch([[name] * count, ids, np.diff(x.first_a), np.diff(x.first_b), np.diff(x.first_group), links, products, digest, *map(list, zip(*packed, strict=True)), null * count, null * count])
            yield batch([[name], *[null] * 11, [pairs.astype("<i8").tobytes()], [n.astype("<i8").tobytes()]])

    return docs.mapInArrow(run, _SEEN)


def _pairs(rows: DataFrame) -> DataFrame:
    """(chunk, place, a, b, n): the pairs of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pairs, links in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, n = np.frombuffer(pairs, "<i8"), np.frombuffer(links, "<i8")
                for lo in range(0, len(p), 1 << 16):
                    q = p[lo : lo + (1 << 16)]
                    columns = [pa.array([chunk] * len(q)), *(pa.array(c.astype(np.int32)) for c in (np.arange(lo, lo + len(q)), q >> 32, q & 0xFFFFFFFF)), pa.array(n[lo : lo + (1 << 16)])]
                    yield pa.RecordBatch.from_arrays(columns, ["chunk", "place", "a", "b", "n"])

    return rows.where("pairs is not null").select("chunk", "pairs", "links").mapInArrow(run, "chunk string, place int, a int, b int, n bigint")


def _scored(pairs: DataFrame) -> DataFrame:
    """(a, b, count, best): links of each id pair in the corpus, and whether its b id has no more with any other.

    The rows are those of the two vocabularies' pairs at most, however many the documents.
    """
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    top = counts.groupBy("b").agg(F.max("count").alias("_top"))
    return counts.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("_top")).alias("best"))


def pair_counts(docs: DataFrame, text: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """(a, b, count, best): how many links of the corpus hold the id pair."""
    rows = docs.select(F.lit(None).cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return _scored(_pairs(stored(seen(rows, a, b), "pairs_seen")))


_RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, n_products bigint, groups_sha256 string"
_WEIGHED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_products", "groups_sha256", "near", "far", "times", "often"]


def _weigh(documents: pa.Table, weights: pa.Table) -> pa.Table:
    """Documents of a chunk with the sums of their links' counts."""
    size = documents.num_rows
    at = weights.column("place").to_numpy()
    count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    count[at], best[at] = weights.column("count").to_numpy(), weights.column("best").to_numpy()
    n_best, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
    packed = zip(*(documents.column(c).to_pylist() for c in _WEIGHED[-4:]), strict=True)
    for k, links in enumerate(packed):
        place, times = _placed(*links)
        n_best[k], total[k] = times @ best[place], times @ count[place]
    added = {"n_best": pa.array(n_best), "count_sum": pa.array(total)}
    names = [c.split()[0] for c in _RESULT.split(", ")]
    return pa.table([added[c] if c in added else documents.column(c) for c in names], names)


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a: str | None = None, b: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair is the most
    frequent of its b id, ties included), count_sum (over its links, how many links of the corpus hold the pair),
    n_products (pairs of tokens of a group, overlapping or not), groups_sha256 (of the groups' ids, '' without tokens)."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    held = stored(seen(rows, a, b, chunk), "links_seen")
    pairs = _pairs(held)
    weights = pairs.select("chunk", "place", "a", "b").join(_scored(pairs), ["a", "b"]).select("chunk", "place", "count", F.col("best").cast("bigint").alias("best"))
    documents = held.where("pairs is null").select("chunk", *_WEIGHED)
    return documents.groupBy("chunk").cogroup(weights.groupBy("chunk")).applyInArrow(_weigh, _RESULT)
