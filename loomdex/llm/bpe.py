"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

``encode`` adds the token ids of every whole text, ``decode`` turns ids back into the exact bytes, ``round_trip`` does
both in one pass over the data. Ids travel as BINARY, four little-endian bytes each; ``ids_array`` unpacks them.

Defined results: a null or empty text has no ids and decodes to no bytes; special-token strings are ordinary text;
texts of any length are whole: a long one is cut where no match of the pattern can span, so that its ids are those of
the text in one piece, and memory holds one piece beside the ids. A run of one kind (letters without a space, digits,
white space) is one match and hence one piece, however long; long white space goes to the merges without the library's
regular expression, which gives up on runs of about a million. Rows are never grouped or moved: no shuffle. Repeated
rows and ties play no part. All columns of the input are kept, but for those that have the name of a new one, which
takes their place; the names of the new ones are parameters.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Code points encoded at a time.
PIECE = 1 << 15
#: White space of the pattern's \s, and the length from which a run of it is found here and not by the library.
_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_BLANK = 1 << 12
#: Characters whose class is beyond doubt in any version of Unicode: letters, digits and marks (the apostrophe apart).
_L, _N, _S = r"A-Za-zÀ-ÖØ-öø-ÿА-яЁё\u4e00-\u9fa5\u3041-\u3096\u30a1-\u30fa\uac00-\ud7a3", "0-9", r" \t\n\r"
_O = r'!"#$%&()*+,./:;<=>?@\[\\\]^_`{|}~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f\-'
_CUT = re.compile(f"(?<=[{_L}])(?=[{_N}{_S}{_O}'])|(?<=[{_N}])(?=[{_L}{_S}{_O}'])|(?<=[{_O}])(?=[{_L}{_N}{_S}])")


@lru_cache(maxsize=4)
def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def safe_pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cuts between two characters of different classes of which the first is no white space.

    No alternative of the pattern spans such a place, but for a contraction, whose apostrophe is left out here; none
    looks behind, and the only one that looks ahead ends in white space. So the matches on either side are those of the
    whole text.
    """
    at = 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(maxsize=8)
def _blank_run(least: int) -> re.Pattern:
    return re.compile(f"{_BLANK}{{{least},}}")


def matches(text: str, size: int = PIECE, blank: int = LONG_BLANK) -> Iterator[tuple[str, bool]]:
    """(part, whether it is one match): parts of a text that can be encoded one by one.

    A long run of white space is one match up to its last character, which goes with what follows; at the end of the
    text it is one match to its end.
    """
    at = 0
    for run in _blank_run(blank).finditer(text):
        if run.start() > at:
            yield from ((p, False) for p in safe_pieces(text[at : run.start()], size))
        at = run.end() - (run.end() < len(text))
        yield text[run.start() : at], True
    if at < len(text):
        yield from ((p, False) for p in safe_pieces(text[at:], size))


def encode_text(coder: tiktoken.Encoding, text: str, size: int = PIECE, blank: int = LONG_BLANK) -> np.ndarray:
    """Ids of one text as little-endian unsigned 32-bit integers."""
    if len(text) <= size:
        return np.asarray(coder.encode_to_numpy(text, disallowed_special=()), "<u4")
    one = lambda p, single: coder._encode_single_piece(p) if single else coder.encode_to_numpy(p, disallowed_special=())
    return np.concatenate([np.asarray(one(p, single), "<u4") for p, single in matches(text, size, blank)])


def _with(df: DataFrame, added: list[tuple[str, T.DataType]], source: str, make) -> DataFrame:
    """mapInArrow that keeps every column and adds those of ``make(column) -> arrays``."""
    df = df.drop(*[n for n, _ in added if n != source])
    schema = T.StructType(list(df.schema.fields) + [T.StructField(n, t) for n, t in added])
    at = df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few rows at a time, so that memory does not follow the batch
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                new = make(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *(n for n, _ in added)])

    return df.mapInArrow(run, schema)


def _ranks(path: str | None) -> bytes:
    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        return f.read()


def encode(df: DataFrame, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, decoded: str | None = None) -> DataFrame:
    """Add the ids of each text and their number; with ``decoded`` also the bytes that the ids stand for."""
    sent = df.sparkSession.sparkContext.broadcast(_ranks(ranks_path))  # one rank file, under a megabyte

    def make(column: pa.Array) -> list[pa.Array]:
        coder = _encoding(sent.value, pattern)
        found = [encode_text(coder, x or "") for x in column.to_pylist()]
        out = [pa.array([x.tobytes() for x in found], pa.binary()), pa.array([len(x) for x in found], pa.int64())]
        if decoded:
            out.append(pa.array([coder.decode_bytes(x.tolist()) for x in found], pa.binary()))
        return out

    added = [(ids, T.BinaryType()), (n_tokens, T.LongType())] + [(decoded, T.BinaryType())] * bool(decoded)
    return _with(df, added, text, make)


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", ranks_path: str | None = None) -> DataFrame:
    """Add the exact bytes of packed ids; null ids give no bytes. The bytes need not be valid UTF-8."""
    sent = df.sparkSession.sparkContext.broadcast(_ranks(ranks_path))

    def make(column: pa.Array) -> list[pa.Array]:
        coder = _encoding(sent.value, public_tokenizers.PATTERN)
        return [pa.array([coder.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in column.to_pylist()], pa.binary())]

    return _with(df, [(decoded, T.BinaryType())], ids, make)


def ids_array(ids: str = "ids") -> Column:
    """Packed ids as ARRAY<BIGINT>."""
    words = F.regexp_extract_all(F.hex(F.col(ids)), F.lit("[0-9A-F]{8}"), F.lit(0))  # cut once, so that time is linear
    return F.transform(words, lambda w: F.conv(F.concat(*[F.substring(w, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("bigint"))


def round_trip(df: DataFrame, **options) -> DataFrame:
    """``encode`` and the decoded bytes in the column ``decoded``, in one pass."""
    return encode(df, decoded="decoded", **options)
