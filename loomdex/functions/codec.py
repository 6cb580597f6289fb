"""Byte codecs as column expressions: VByte, Double-VByte and raw 32-bit integers.

Encoders build BINARY values without leaving the JVM. Decoders of whole lists are Arrow functions over numpy.
All arithmetic is in BIGINT; a gap so large that its code would not fit 32 bits is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: frequencies below it share the gap's code.
FOLD = 4


def vbyte_size(x: Column) -> Column:
    """Bytes of the VByte code of x: 1 to 5, seven bits each."""
    return F.when(x < 1 << 7, 1).when(x < 1 << 14, 2).when(x < 1 << 21, 3).when(x < 1 << 28, 4).otherwise(5)


def vbyte(x: Column) -> Column:
    """VByte code: seven bits a byte, low ones first, the high bit set on all but the last."""
    x = x.cast("bigint")
    n = vbyte_size(x)
    byte = lambda k: F.lpad(F.hex(F.shiftright(x, 7 * k).bitwiseAND(F.lit(127)) + F.when(n > k + 1, 128).otherwise(0)), 2, "0")
    return F.unhex(F.concat(*[F.when(n > k, byte(k)).otherwise("") for k in range(5)]))


def double_vbyte_size(gap: Column, tf: Column, fold: int = FOLD) -> Column:
    """Bytes of the Double-VByte code of a posting."""
    return F.when(tf < fold, vbyte_size((gap - 1) * fold + tf)).otherwise(vbyte_size(gap * fold) + vbyte_size(tf - fold + 1))


def double_vbyte(gap: Column, tf: Column, fold: int = FOLD) -> Column:
    """Double-VByte: one code of gap and frequency when the frequency is below ``fold``, else one each."""
    gap, tf = gap.cast("bigint"), tf.cast("bigint")
    code = F.when(tf < fold, vbyte((gap - 1) * fold + tf)).otherwise(F.concat(vbyte(gap * fold), vbyte(tf - fold + 1)))
    return F.when((gap < 1) | (gap > (1 << 32) // fold - 1) | (tf < 1), F.raise_error(F.lit("gap or frequency out of range"))).otherwise(code)


def u32(x: Column) -> Column:
    """Four bytes, little-endian."""
    digits = F.lpad(F.hex(x.cast("bigint")), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)]))


def u32_at(data: Column, offset: Column | int = 0) -> Column:
    """The little-endian 32-bit integer at any byte offset."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    digits = F.hex(F.substring(data, offset + 1, F.lit(4)))
    return F.conv(F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("bigint")


def values_of(data: bytes) -> np.ndarray:
    """All VByte values of a byte string."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(last[-1] + 1) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b[: last[-1] + 1] & 127).astype(np.int64) << (7 * place), first)


def postings_of(data: bytes, fold: int = FOLD) -> tuple[np.ndarray, np.ndarray]:
    """Gaps and frequencies of a Double-VByte byte string."""
    return _postings(data, fold, np.zeros(0, np.int64))[:2]


def _postings(data: bytes, fold: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gaps and frequencies, and the places of their first values among all values; ``starts``: where lists begin."""
    v = values_of(data)
    place = np.arange(len(v))
    begins = np.zeros(len(v), bool)
    begins[:1] = True
    begins[starts] = True
    split = v % fold == 0  # the frequency has a value of its own, if this one is not itself such a value
    after = np.concatenate([[False], split[:-1]])[: len(v)]
    run = np.maximum.accumulate(np.where(split & (begins | ~after), place, 0))
    wide = split & ((place - run) % 2 == 0)
    head = np.flatnonzero(begins | ~np.concatenate([[False], wide[:-1]])[: len(v)])
    follow = v[np.minimum(head + 1, len(v) - 1)] if len(v) else v
    return np.where(wide[head], v[head] // fold, 1 + v[head] // fold), np.where(wide[head], fold - 1 + follow, v[head] % fold), head


def _joined(part: pa.Array) -> tuple[bytes, np.ndarray, pa.Array]:
    """All byte strings of a batch as one, where each ends among the values, and which are null."""
    data = b"".join(part.drop_null().to_pylist())
    ends = np.cumsum(pc.fill_null(pc.binary_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    values = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint8) < 128)])
    return data, values[ends], pc.is_null(part)


def _lists(ends: np.ndarray, items: pa.Array, absent: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), items, mask=absent)


def decode_vbyte(data: Column) -> Column:
    """VByte byte string to its values, by an Arrow function over flat arrays."""

    def run(part: pa.Array) -> pa.Array:
        joined, ends, absent = _joined(part)
        return _lists(ends, pa.array(values_of(joined), pa.int64()), absent)

    return F.arrow_udf(run, T.ArrayType(T.LongType()))(data)


def decode_double_vbyte(data: Column) -> Column:
    """Double-VByte byte string to its postings (gap, tf), by an Arrow function over flat arrays."""

    def run(part: pa.Array) -> pa.Array:
        joined, ends, absent = _joined(part)
        first = np.concatenate([[0], ends[:-1]])[: len(ends)]
        gaps, tfs, head = _postings(joined, FOLD, first[first < ends])
        items = pa.StructArray.from_arrays([pa.array(gaps, pa.int64()), pa.array(tfs, pa.int64())], ["gap", "tf"])
        return _lists(np.searchsorted(head, ends), items, absent)

    kind = T.StructType([T.StructField("gap", T.LongType()), T.StructField("tf", T.LongType())])
    return F.arrow_udf(run, T.ArrayType(kind))(data)
