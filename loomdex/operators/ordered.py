"""Postings in the byte order of their terms and of docids, laid out as the words of inverted-index files.

Each task groups its own postings by term and ``BLOCK`` docids first, so what moves is a row for each list of a buffer and
not for each posting: two bytes of docid and as a rule one of frequency. One exchange by ranges of (term, block) follows.
A task then writes the words of its range in order, counted from its own beginning; where a range begins, and the lengths
of lists that reach over a border, follow from a row for each range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: Binary digits of a place within a block of docids; postings that a task groups at a time; grouped rows of a range.
BITS, BUFFER, PIECES = 15, 1 << 21, 250_000

_PIECES = "term string, block bigint, docs binary, tfs binary"
_EDGE = {"first": pa.string(), "first_n": pa.int64(), "last": pa.string(), "last_at": pa.int64(), "last_n": pa.int64(), "n_lists": pa.int64(), "n_words": pa.int64(), "n_bytes": pa.int64()}
_LAID = {"part": pa.int64(), "at": pa.int64(), "docs": pa.binary(), "freqs": pa.binary(), "line_at": pa.int64(), "lines": pa.binary()} | _EDGE
_SQL = {pa.int64(): "bigint", pa.binary(): "binary", pa.string(): "string"}


def _pieces(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Postings (term, docid, tf) by term and block: places within the block in two bytes, frequencies in 1, 2 or 4."""
    t = pa.Table.from_batches(batches)
    terms = t.column(0).combine_chunks().dictionary_encode()
    place, tf = t.column(1).to_numpy() - 1, t.column(2).to_numpy()
    if place.min() < 0 or tf.min() < 0 or max(place.max(), tf.max()) >= 1 << 32:
        raise ValueError("a value does not fit in 32 bits")
    key = (terms.indices.to_numpy().astype(np.int64) << 32) | place
    order = np.argsort(key, kind="stable")
    key, tf = key[order], tf[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(key >> BITS)) + 1])
    width = 1 if tf.max() < 1 << 8 else 2 if tf.max() < 1 << 16 else 4
    bounds = np.append(starts, len(key))
    cut = lambda size, values: pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((bounds * size).astype("<i4")), pa.py_buffer(values.astype(f"<u{size}"))])
    first = key[starts]
    return pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(first >> 32)), pa.array((first & 0xFFFFFFFF) >> BITS), cut(2, key & ((1 << BITS) - 1)), cut(width, tf)], ["term", "block", "docs", "tfs"])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each value begins, and the bytes of all."""
    at = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at - at[0], np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]


def _postings(rows: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Terms of sorted pieces, and list (from 0), place (docid - 1) and frequency of their postings in order."""
    names, block = rows.column("term").dictionary_encode(), rows.column("block").to_numpy()
    number = np.concatenate([[0], np.cumsum(np.diff(names.indices.to_numpy()) != 0)])
    group = np.concatenate([[0], np.cumsum((np.diff(number) != 0) | (np.diff(block) != 0))])
    docs_at, docs = _bytes(rows.column("docs"))
    tfs_at, tfs = _bytes(rows.column("tfs"))
    counts = np.diff(docs_at) // 2
    row = np.repeat(np.arange(len(counts)), counts)
    width = (np.diff(tfs_at) // counts)[row]
    at = tfs_at[row] + (np.arange(len(row)) - docs_at[row] // 2) * width
    tf = tfs[at].astype(np.int64)
    for b in (1, 2, 3):
        wide = np.flatnonzero(width > b)
        tf[wide] |= tfs[at[wide] + b].astype(np.int64) << (8 * b)
    key = (group[row] << BITS) | docs.view("<u2")
    order = np.argsort(key, kind="stable")  # pieces of a block come from several buffers
    row = row[order]
    return names.dictionary.to_pylist(), number[row], (block[row] << BITS) + (key[order] & ((1 << BITS) - 1)), tf[order]


class _Range:
    """The words of one range as its postings come by. The list that is open gets its length when it ends."""

    def __init__(self, part: int) -> None:
        self.part, self.words, self.lists, self.bytes = part, 0, 0, 0
        self.first = self.last = None
        self.first_n = self.last_at = self.last_n = 0

    def add(self, rows: pa.RecordBatch) -> list[dict]:
        names, number, place, tf = _postings(rows)
        counts, on, out = np.bincount(number), names[0] == self.last, []
        heads = np.ones(len(names), np.int64)
        heads[0] = 0 if on else 1
        values = np.arange(len(number)) + np.cumsum(heads)[number]
        begins = np.cumsum(heads + counts) - heads - counts
        docs, freqs = (np.zeros(int(begins[-1] + heads[-1] + counts[-1]), "<u4") for _ in range(2))
        docs[values], freqs[values] = place, tf
        docs[begins[heads == 1]] = freqs[begins[heads == 1]] = counts[heads == 1]
        fresh, ends = not self.lists, not on or len(names) > 1
        if on:
            self.last_n += int(counts[0])
        if ends and not fresh:
            if self.lists == 1:
                self.first_n = self.last_n
            else:
                out.append(self._words(self.last_at, *[np.array([self.last_n], "<u4")] * 2))
        # lengths that are not known yet: of the list that stays open, and of the first, which may have begun before
        unknown = sorted(({0} if fresh else set()) | ({int(begins[-1])} if ends else set()))
        for lo, hi in zip([0, *[u + 1 for u in unknown]], [*unknown, len(docs)], strict=True):
            if hi > lo:
                out.append(self._words(self.words + lo, docs[lo:hi], freqs[lo:hi]))
        if fresh:
            self.first, self.first_n, self.bytes = names[0], int(counts[0]), len(names[0].encode()) + 1
        lines = "".join(f"{n}\n" for n in names[1 if on or fresh else 0 :]).encode()
        if lines:
            out.append({"part": self.part, "line_at": self.bytes, "lines": lines})
        if ends:
            self.last, self.last_at, self.last_n = names[-1], self.words + int(begins[-1]), int(counts[-1])
        self.words, self.lists, self.bytes = self.words + len(docs), self.lists + len(names) - on, self.bytes + len(lines)
        return out

    def _words(self, at: int, docs: np.ndarray, freqs: np.ndarray) -> dict:
        return {"part": self.part, "at": at, "docs": docs.tobytes(), "freqs": freqs.tobytes()}

    def edge(self) -> dict:
        return {"part": self.part, "first": self.first, "first_n": self.last_n if self.lists == 1 else self.first_n, "last": self.last, "last_at": self.last_at, "last_n": self.last_n, "n_lists": self.lists, "n_words": self.words, "n_bytes": self.bytes}


def _lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces (part, term, block, docs, tfs) of a range to its words. The last block waits for pieces of its own."""
    own, held, schema = None, None, pa.schema(list(_LAID.items()))
    for b in chain(batches, [None]):
        if b is not None and not b.num_rows:
            continue
        rows = held if b is None else b if held is None else pa.concat_batches([held, b])
        if rows is None:
            return
        own = own or _Range(rows.column("part")[0].as_py())
        names, block = rows.column("term").dictionary_encode().indices.to_numpy(), rows.column("block").to_numpy()
        last = 0 if b is not None else rows.num_rows
        if b is not None and (cuts := np.flatnonzero((np.diff(names) != 0) | (np.diff(block) != 0))).size:
            last = int(cuts[-1]) + 1
        held = rows.slice(last)
        if last:
            yield pa.RecordBatch.from_pylist(own.add(rows.slice(0, last)), schema=schema)
    yield pa.RecordBatch.from_pylist([own.edge()], schema=schema)


@dataclass(frozen=True)
class Laid:
    """Words of lists (at, docs, freqs) and lines of terms (at, data), at their places; how many there are of all."""

    words: DataFrame
    lines: DataFrame
    n_words: int
    n_bytes: int


def laid(postings: DataFrame, buffer: int = BUFFER, most: int = PIECES) -> Laid:
    """Lists (length, values...) of docids from 0 and of frequencies one behind the other, and their terms in lines.

    (term, docid) must not repeat. buffer: postings grouped at a time; most: rows of a range, on the average.
    """
    spark = postings.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had, n = [], 0
        for b in batches:
            had, n = [*had, b] if b.num_rows else had, n + b.num_rows
            if n >= buffer:
                yield _pieces(had)
                had, n = [], 0
        if n:
            yield _pieces(had)

    p = kept(postings.select("term", F.col("docid").cast("bigint"), F.col("tf").cast("bigint")).mapInArrow(pack, _PIECES), "pieces")
    p = p.repartitionByRange(1 + p.count() // most, "term", "block").sortWithinPartitions("term", "block")
    p = p.select(F.spark_partition_id().cast("bigint").alias("part"), "term", "block", "docs", "tfs")
    rows = kept(p.mapInArrow(_lay, ", ".join(f"{c} {_SQL[t]}" for c, t in _LAID.items())), "laid")
    words = lines = 0
    bases, heads, firsts, opened = [], [], [], None  # opened: term, place and length of the list that may go on
    for e in rows.where("n_words IS NOT NULL").select("part", *_EDGE).orderBy("part").collect():  # a row for each range
        on = opened is not None and opened[0] == e["first"]
        word_base, byte_base = words - on, lines - (len(e["first"].encode()) + 1 if on else 0)
        bases.append((e["part"], word_base, byte_base))
        if on:
            opened = (opened[0], opened[1], opened[2] + e["first_n"])
        else:
            heads += [opened[1:]] if opened else []
            opened = (e["first"], words, e["first_n"])
            firsts.append((lines, f"{e['first']}\n".encode()))
        if e["n_lists"] > 1:
            heads.append(opened[1:])
            opened = (e["last"], word_base + e["last_at"], e["last_n"])
        words, lines = word_base + e["n_words"], byte_base + e["n_bytes"]
    heads += [opened[1:]] if opened else []
    base = F.broadcast(spark.createDataFrame(bases, "part bigint, word_base bigint, byte_base bigint"))
    head = spark.createDataFrame([(at, n.to_bytes(4, "little")) for at, n in heads], "at bigint, data binary").select("at", F.col("data").alias("docs"), F.col("data").alias("freqs"))
    first = spark.createDataFrame(firsts, "at bigint, data binary")
    own = rows.where("docs IS NOT NULL").select("part", "at", "docs", "freqs").join(base, "part").select((F.col("word_base") + F.col("at")).alias("at"), "docs", "freqs")
    named = rows.where("lines IS NOT NULL").select("part", "line_at", "lines").join(base, "part").select((F.col("byte_base") + F.col("line_at")).alias("at"), F.col("lines").alias("data"))
    return Laid(own.union(head), named.union(first), words, lines)
