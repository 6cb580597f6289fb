"""Single binary files written and read by many tasks: Python data sources ``loomdex_bytes``,
``loomdex_sequences`` and ``loomdex_stretches``.

The sink takes rows (at, data) and puts the bytes at their place in one file, so tasks write in any order and a task that
runs twice writes the same bytes again; the file gets its name when all have ended and every byte is there. No byte of
data passes through the driver. The source reads files of sequences, each a length and so many values, all unsigned
little-endian 32-bit integers; the driver hops from length to length and cuts the file into parts of bounded size, also
inside a sequence.

Both work on a folder that the driver and all executors mount; paths of other stores are refused.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Words of a part that one task reads, and words that it holds at a time.
PART, CHUNK = 1 << 22, 1 << 18


def local_path(path: str) -> str:
    """The path of a mounted folder, with or without ``file:``."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{path}: not a folder that driver and executors mount")
    return url.path if url.scheme else path


@dataclass
class Wrote(WriterCommitMessage):
    size: int
    end: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size
        self.draft = f"{path}.{uuid.uuid4().hex}.part"  # one name for all tasks of this write

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        size = end = 0
        file = os.open(self.draft, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            for batch in iterator:
                for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    view, done = memoryview(data.as_buffer()), 0
                    while done < len(view):
                        done += os.pwrite(file, view[done:], at + done)
                    size, end = size + len(view), max(end, at + len(view))
            os.fsync(file)
        finally:
            os.close(file)
        return Wrote(size, end)

    def commit(self, messages: list[Wrote | None]) -> None:
        told = [m for m in messages if m]
        if sum(m.size for m in told) != self.size or max((m.end for m in told), default=0) != self.size:
            self.abort(messages)
            raise ValueError(f"{self.path}: {sum(m.size for m in told)} bytes were written of {self.size}")
        with open(self.draft, "ab"):  # an empty file has no task that makes it
            pass
        os.replace(self.draft, self.path)

    def abort(self, messages: list[Wrote | None]) -> None:
        if os.path.exists(self.draft):
            os.remove(self.draft)


class BytesSink(DataSource):
    """Options: path, size (bytes of the whole file). Rows: at bigint, data binary."""

    @classmethod
    def name(cls) -> str:
        return "loomdex_bytes"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(local_path(self.options["path"]), int(self.options["size"]))


@dataclass
class Part(InputPartition):
    """Words lo to hi - 1 of a file; sequence and place (0: its length) of the first of them, and values left in it."""

    lo: int
    hi: int
    sequence: int
    k: int
    left: int


def parts_of(path: str, most: int = PART) -> list[Part]:
    """Parts of at most ``most`` words. Of the file only the lengths are read."""
    if os.path.getsize(path) % 4:
        raise ValueError(f"{path} does not hold whole words")
    if not os.path.getsize(path):
        return []
    words = np.memmap(path, "<u4", "r")
    out, open_at, state, at, sequence = [], 0, (0, 0, 0), 0, 0
    while at < len(words):
        n = int(words[at])
        end = at + 1 + n
        if end > len(words):
            raise ValueError(f"{path} ends within a sequence")
        while end - open_at >= most:
            cut = open_at + most
            out.append(Part(open_at, cut, *state))
            open_at, state = cut, (sequence + 1, 0, 0) if cut == end else (sequence, cut - at, end - cut)
        at, sequence = end, sequence + 1
    if open_at < len(words):
        out.append(Part(open_at, len(words), *state))
    return out


class _Reader(DataSourceReader):
    def __init__(self, path: str, most: int) -> None:
        self.path, self.most = path, most

    def partitions(self) -> list[Part]:
        return parts_of(self.path, self.most) or [Part(0, 0, 0, 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        sequence, k, left = partition.sequence, partition.k, partition.left
        with open(self.path, "rb") as file:
            file.seek(partition.lo * 4)
            for lo in range(partition.lo, partition.hi, CHUNK):
                words = np.frombuffer(file.read(min(CHUNK, partition.hi - lo) * 4), "<u4").astype(np.int64)
                numbers, places, at = np.empty(len(words), np.int64), np.empty(len(words), np.int64), 0
                while at < len(words):
                    n = min(left, len(words) - at) if k else 1
                    numbers[at : at + n], places[at : at + n] = sequence, np.arange(k, k + n)
                    left = left - n if k else int(words[at])
                    at, k = at + n, k + n
                    if not left:
                        sequence, k = sequence + 1, 0
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(places), pa.array(words)], ["sequence", "k", "value"])


class _StretchReader(_Reader):
    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        sequence, k, left = partition.sequence, partition.k, partition.left
        with open(self.path, "rb") as file:
            file.seek(partition.lo * 4)
            for lo in range(partition.lo, partition.hi, CHUNK):
                words, at, rows = np.frombuffer(file.read(min(CHUNK, partition.hi - lo) * 4), "<u4"), 0, []
                while at < len(words):
                    n = min(left, len(words) - at) if k else min(1 + int(words[at]), len(words) - at)
                    left = left - n if k else 1 + int(words[at]) - n
                    rows.append((sequence, k, at))
                    at, k = at + n, k + n
                    if not left:
                        sequence, k = sequence + 1, 0
                columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)]
                stretches = pa.ListArray.from_arrays(pa.array(np.append(columns[2], len(words)).astype(np.int32)), pa.array(words.view("<i4")))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), stretches], ["sequence", "k", "words"])


class StretchesSource(DataSource):
    """Options as of SequencesSource. Rows: sequence from 0, k of the first word (0: the length), words with their sign."""

    @classmethod
    def name(cls) -> str:
        return "loomdex_stretches"

    def schema(self) -> str:
        return "sequence bigint, k bigint, words array<int>"

    def reader(self, schema: StructType) -> _StretchReader:
        return _StretchReader(local_path(self.options["path"]), int(self.options.get("words", PART)))


class SequencesSource(DataSource):
    """Options: path, words (of a part at most). Rows: sequence from 0, k (0: the length), value."""

    @classmethod
    def name(cls) -> str:
        return "loomdex_sequences"

    def schema(self) -> str:
        return "sequence bigint, k bigint, value bigint"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(local_path(self.options["path"]), int(self.options.get("words", PART)))


def write_bytes(rows: DataFrame, path: str, size: int) -> None:
    """Write rows (at, data) as one file of ``size`` bytes. Every byte must be in one row."""
    rows.sparkSession.dataSource.register(BytesSink)
    rows.select("at", "data").write.format("loomdex_bytes").option("path", path).option("size", size).mode("append").save()


def read_sequences(spark: SparkSession, path: str, words: int = PART) -> DataFrame:
    """(sequence, k, value) of a file of sequences: the lists of ``.docs`` after its header, of ``.freqs`` or ``.sizes``."""
    spark.dataSource.register(SequencesSource)
    return spark.read.format("loomdex_sequences").option("path", path).option("words", words).load()


def read_stretches(spark: SparkSession, path: str, words: int = PART) -> DataFrame:
    """(sequence, k, words) of a file of sequences: a row for each sequence, or for each of the parts that a long one is
    read in. words are the file's 32 bits; one of 2^31 and more is negative."""
    spark.dataSource.register(StretchesSource)
    return spark.read.format("loomdex_stretches").option("path", path).option("words", words).load()
