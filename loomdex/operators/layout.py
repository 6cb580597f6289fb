"""How many blocks an index of 64-byte blocks would take, with fixed or growing slabs.

A list's layout depends on every posting before, so it is a fold over the list. Lists are clustered by term and sorted,
and each task folds them as they stream by with a few numbers of state; no list is gathered. The fold steps from slab to
slab over running sums of code sizes, not from posting to posting; lists of one slab are done for a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import FOLD
from ..functions.slabs import BLOCK, LAST_GROWTH, LINK, head_bytes, slab_sizes

_CHAIN = "term string, slab bigint, blocks bigint, first_docid bigint, bgap bigint, postings bigint, payload bigint"


def _size(x):
    return 1 + (x >= 1 << 7) + (x >= 1 << 14) + (x >= 1 << 21) + (x >= 1 << 28)


def posting_bytes(gap, tf, fold: int = FOLD):
    """Bytes of a posting's code, for numbers or arrays of them."""
    return np.where(tf < fold, _size((gap - 1) * fold + tf), _size(gap * fold) + _size(tf - fold + 1))


def slab_chain(postings: DataFrame, growth: str = "triangle") -> DataFrame:
    """(term, slab from 1, blocks, first_docid, bgap, postings, payload), a row for each slab of each list.

    bgap is what the first posting of a later slab stores: the distance to the first document of the slab before, or
    the document itself in the second slab. A head slab that its term fills has no postings and a null first_docid.
    """
    sizes, head = slab_sizes(growth), head_bytes(growth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the list in work: its slab, bytes left in it, the document before, first document of a continued slab
        term, slab, room, last, link = None, None, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            terms = batch.column(0)
            size, doc, tf = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:])
            new = np.concatenate([[terms[0].as_py() != term], pc.not_equal(terms[1:], terms[:-1]).to_numpy(zero_copy_only=False)]).astype(bool)
            before = np.concatenate([[last], doc[:-1]])
            before[new] = 0
            upto = np.concatenate([[0], np.cumsum(posting_bytes(doc - before, tf))])
            lo = np.flatnonzero(new | (np.arange(len(new)) == 0))
            hi = np.append(lo[1:], len(doc))
            # lists that are whole in this batch and fill no more than their first slab
            short = new[lo] & (hi < len(doc)) & (upto[hi] - upto[lo] <= BLOCK * sizes[0] - head - size[lo])
            a, b = lo[short], hi[short]
            if len(a):
                n = len(a)
                numbers = [pa.array(np.full(n, 1)), pa.array(np.full(n, sizes[0])), pa.array(doc[a]), pa.nulls(n, pa.int64()), pa.array(b - a), pa.array(upto[b] - upto[a])]
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(a)), *numbers], names)
            done: list[list] = []
            for at, end in zip(lo[~short].tolist(), hi[~short].tolist(), strict=True):
                if new[at]:
                    if slab:
                        done.append(slab)
                    term, room, link = terms[at].as_py(), BLOCK * sizes[0] - head - int(size[at]), 0
                    slab = [term, 1, sizes[0], None, None, 0, 0]
                while at < end:
                    fits = min(end, max(at, int(np.searchsorted(upto, upto[at] + room, "right")) - 1))
                    if fits > at:
                        used = int(upto[fits] - upto[at])
                        slab[3] = int(doc[at]) if slab[3] is None else slab[3]
                        slab[5], slab[6], room, at = slab[5] + fits - at, slab[6] + used, room - used, fits
                    if at < end:
                        done.append(slab)
                        blocks, d = sizes[min(slab[1], LAST_GROWTH)], int(doc[at])
                        need = int(posting_bytes(d - link, int(tf[at])))
                        slab, room, link, at = [term, slab[1] + 1, blocks, d, d - link, 1, need], BLOCK * blocks - LINK - need, d, at + 1
            last = int(doc[-1])
            if done:
                yield _batch(done)
        if slab:
            yield _batch([slab])

    names = [f.split()[0] for f in _CHAIN.split(", ")]

    def _batch(rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.string(), *[pa.int64()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = postings.select("term", F.octet_length("term").alias("size"), "docid", "tf")
    return rows.repartition("term").sortWithinPartitions("term", "docid").mapInArrow(run, _CHAIN)


def block_layout(postings: DataFrame, growth: str = "triangle") -> DataFrame:
    """(term, df, slabs, blocks, payload): slabs in the chain, blocks they take, bytes of codes in them."""
    chain = slab_chain(postings, growth).groupBy("term")
    return chain.agg(F.sum("postings").alias("df"), F.count("*").alias("slabs"), F.sum("blocks").alias("blocks"), F.sum("payload").alias("payload"))


def size_report(layout: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: n_docs, n_words, n_postings, vocabulary, blocks, total_bytes, bytes_per_word, bytes_per_posting.

    Eight bytes for a term's entry and 64 for a block. stats: the row of ``collection_stats``.
    """
    blocks = layout.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"))
    r = stats.crossJoin(blocks)  # one row each
    r = r.withColumn("total_bytes", F.col("vocabulary") * 8 + F.col("blocks") * BLOCK)
    return r.select("n_docs", "n_words", "n_postings", "vocabulary", "blocks", "total_bytes", (F.col("total_bytes") / F.col("n_words")).alias("bytes_per_word"), (F.col("total_bytes") / F.col("n_postings")).alias("bytes_per_posting"))
