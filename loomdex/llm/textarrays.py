"""Whole batches of texts as numpy arrays: words, shingles and their hashes without a Python loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes hashed at a time; the words of a longer text are joined again.
BLOCK = 1 << 20
SHINGLE = 5


def release() -> None:
    """Give freed memory back, so that a reused Python worker does not keep the peak of each of its tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library of Linux has it
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (Steele, Lea and Flood's SplitMix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit numbers that look random."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[65:91] = _NOT_LETTER[97:123] = _NOT_LETTER[128:] = False
_BYTE = stream(11, 256)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_STEP = int(stream(5, 1)[0]) | 1
_WEIGHTS = stream(77, SHINGLE)
_SHORT = stream(99, SHINGLE)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd step and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [_power(_STEP, n), _power(pow(_STEP, -1, 1 << 64), n)]
    return _powers[0], _powers[1]


def _power(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, U64)
        out[0] = 1
        return np.multiply.accumulate(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column without nulls, not copied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if at else np.zeros(len(column) + 1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def _script_table() -> np.ndarray:
    """For the first two bytes of a character in UTF-8: 0 a letter, 1 no letter, 2 a script that is written without spaces."""
    kind = np.zeros(1 << 16, np.uint8)
    spans = (
        # fixed values: two leading bytes, first and last, and what their characters are
        (0xC280, 0xC2BF, 1), (0xC2AA, 0xC2AA, 0), (0xC2B5, 0xC2B5, 0), (0xC2BA, 0xC2BA, 0), (0xC397, 0xC397, 1), (0xC3B7, 0xC3B7, 1),
        (0xE280, 0xE2AF, 1), (0xE2B8, 0xE2B9, 1), (0xE380, 0xE380, 1), (0xEFB8, 0xEFB8, 1), (0xF09F, 0xF09F, 1),
        (0xE0B8, 0xE0BB, 2), (0xE180, 0xE182, 2), (0xE19E, 0xE19F, 2), (0xE2BA, 0xE2BF, 2), (0xE381, 0xE3BF, 2), (0xE480, 0xE9BF, 2), (0xF0A0, 0xF0BF, 2),
    )
    for first, last, k in spans:
        kind[first : last + 1] = k
    return kind


_SCRIPT = _script_table()
#: Third bytes of U+FF00 to U+FF3F and of U+FF40 to U+FF7F that are no letters.
_WIDE = {0xBC: np.isin(np.arange(256), [*range(0x80, 0xA1), *range(0xBB, 0xC0)]), 0xBD: np.isin(np.arange(256), [0x80, *range(0x9B, 0xA6)])}


def letter_classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of UTF-8 bytes: whether each is part of a word, and (one place more) whether a word begins there whatever comes before.

    Letters are ASCII letters and all other characters but punctuation, symbols and emoji. A character of a script that is
    written without spaces (Chinese, Japanese, Thai, Lao, Khmer, Burmese) is a word of its own.
    """
    word, begins = ~_NOT_LETTER[data], np.zeros(len(data) + 1, bool)
    lead = np.flatnonzero(data[:-1] >= 0xC2)
    if len(lead):
        first, second = data[lead].astype(np.int64), data[lead + 1].astype(np.int64)
        kind = _SCRIPT[first << 8 | second]
        kind[(first == 0xEF) & (second == 0xBF)] = 1
        for k, none in _WIDE.items():
            at = np.flatnonzero((first == 0xEF) & (second == k))
            kind[at[none[data[lead[at] + 2]]]] = 1
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        for k in range(4):
            word[lead[(kind == 1) & (size > k)] + k] = False
        alone = kind == 2
        begins[lead[alone]] = begins[lead[alone] + size[alone]] = True
    return word, begins


def _word_sums(data: np.ndarray, first: np.ndarray, letters: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[bool, bool]]:
    """Words of a block: their sums of bytes by powers, where they start and end, and whether its first and its last byte
    are cut off from any before and after. first: where texts begin, so that no word spans two."""
    n = len(data)
    power, inverse = _power_tables(max(n + 1, BLOCK))
    word, cut = letter_classes(data) if letters else (~_IS_SPACE[data], np.zeros(n + 1, bool))
    edges = bool(cut[0]), bool(cut[n])
    cut[:n] |= ~word
    cut[1:] |= ~word
    cut[first] = cut[0] = cut[n] = True
    starts, ends = np.flatnonzero(word & cut[:n]), np.flatnonzero(word & cut[1:])
    sums = _BYTE[data]
    sums *= power[:n]
    np.cumsum(sums, out=sums)
    h = sums[ends]
    h[1:] -= sums[starts[1:] - 1]
    if len(h) and starts[0]:
        h[0] -= sums[starts[0] - 1]
    h *= inverse[starts]
    return h, starts, ends, edges


def _hash_block(data: np.ndarray, first: np.ndarray, letters: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block, and where each word starts."""
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h, starts, _, _ = _word_sums(data, first, letters)
    return mix(h), starts


def _hash_long(data: np.ndarray, letters: bool) -> np.ndarray:
    """Word hashes of one long text, BLOCK bytes at a time; a word that goes on in the next block is joined with its rest."""
    out, at, held = [], 0, None  # held: sum and length of a word that may go on
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:  # characters stay whole
            end -= 1
        h, starts, ends, (cut_off, closed) = _word_sums(data[at:end], np.zeros(0, np.int64), letters)
        before = 0
        if held:
            if len(h) and starts[0] == 0 and not cut_off:
                before = held[1]
                h[0] = U64((held[0] + pow(_STEP, before, 1 << 64) * int(h[0])) % (1 << 64))
            else:
                out.append(mix(np.array([held[0]], U64)))
        held = None
        if len(h) and ends[-1] == end - at - 1 and not closed and end < len(data):
            held = int(h[-1]), int(ends[-1] - starts[-1]) + 1 + (before if len(h) == 1 else 0)
            h = h[:-1]
        out.append(mix(h))
        at = end
    return np.concatenate(out) if out else np.zeros(0, U64)


def words(column: pa.Array, letters: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Word hashes of a column of texts, block by block.

    Yields (lo, hi, counts, hashes): rows lo to hi - 1, words of each, and the hashes of all of them in order. A word
    is a maximal run without ASCII white space or, with ``letters``, of letters (see ``letter_classes``); A-Z are
    lower-cased. Memory is bounded by BLOCK for short texts and by eight bytes a word for a longer one, whatever the
    length of its words.
    """
    offsets, data = buffers(column)
    lo, rows = 0, len(offsets) - 1
    with np.errstate(over="ignore"):
        while lo < rows:
            hi = int(np.searchsorted(offsets, offsets[lo] + BLOCK, "right")) - 1
            hi = min(max(hi, lo + 1), rows)
            if offsets[hi] - offsets[lo] > BLOCK:
                h = _hash_long(data[offsets[lo] : offsets[hi]], letters)
                yield lo, hi, np.array([len(h)]), h
            else:
                base = offsets[lo]
                at = offsets[lo : hi + 1] - base
                first = at[:-1][at[:-1] < at[1:]]
                h, starts = _hash_block(data[base : offsets[hi]], first, letters)
                yield lo, hi, np.diff(np.searchsorted(starts, at)), h
            lo = hi


def heads(column: pa.Array, sizes: tuple[int, ...]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Hashes of words of letters and of their first bytes, block by block: (lo, hi, counts, units).

    Like ``words`` with ``letters``, but for a row of ``units`` for each of ``sizes``, after that of the words: the hash
    of so many first bytes, 0 for words of no more. A longer text comes in several blocks, each with its row alone and
    ending with a word, so that memory is bounded by BLOCK or by the longest word.
    """
    offsets, data = buffers(column)
    lo, rows = 0, len(offsets) - 1
    seeds = stream(123, max(sizes, default=0) + 1)

    def block(part: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        power, inverse = _power_tables(max(len(part) + 1, BLOCK))
        h, starts, ends, _ = _word_sums(part, first, True)
        units = np.zeros((1 + len(sizes), len(h)), U64)
        units[0] = mix(h)
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(_BYTE[part] * power[: len(part)])])
        for k, size in enumerate(sizes):
            at = np.flatnonzero(ends - starts >= size)
            units[1 + k, at] = mix((sums[starts[at] + size] - sums[starts[at]]) * inverse[starts[at]] + seeds[size])
        return units, starts

    with np.errstate(over="ignore"):
        while lo < rows:
            hi = min(max(int(np.searchsorted(offsets, offsets[lo] + BLOCK, "right")) - 1, lo + 1), rows)
            base, at = offsets[lo], offsets[lo : hi + 1] - offsets[lo]
            if at[-1] <= BLOCK:
                part = data[base : offsets[hi]]
                units, starts = block(part, at[:-1][at[:-1] < at[1:]]) if len(part) else (np.zeros((1 + len(sizes), 0), U64), np.zeros(0, np.int64))
                yield lo, hi, np.diff(np.searchsorted(starts, at)), units
            else:
                begin, end, most = int(base), int(offsets[hi]), BLOCK
                while begin < end:
                    upto = min(begin + most, end)
                    while upto < end and data[upto] & 0xC0 == 0x80:  # characters stay whole
                        upto -= 1
                    part = data[begin:upto]
                    if upto < end:
                        word, _ = letter_classes(part)
                        outside = np.flatnonzero(~word & (np.append(part[1:], 0) & 0xC0 != 0x80))
                        if not len(outside):
                            most *= 2
                            continue
                        part = part[: int(outside[-1]) + 1]
                    units, _ = block(part, np.zeros(0, np.int64))
                    yield lo, hi, np.array([units.shape[1]]), units
                    begin, most = begin + len(part), BLOCK
            lo = hi


def shingles(counts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of five words of each row, repeats kept, and how many each row has.

    A row with fewer words has the whole sequence as one shingle; a row without words has none.
    """
    with np.errstate(over="ignore"):
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        many = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(counts.dtype))
        if total < SHINGLE:
            rolled = np.zeros(total, U64)
        else:
            n = total - SHINGLE + 1
            rolled = np.zeros(total, U64)
            for k in range(SHINGLE):
                rolled[:n] += hashes[k : k + n] * _WEIGHTS[k]
            rolled = mix(rolled)
        for row in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
            c, s = int(counts[row]), int(ends[row] - counts[row])
            rolled[s] = mix(np.array([np.sum(hashes[s : s + c] * _WEIGHTS[:c]) + _SHORT[c - 1]], U64))[0]
        starts = ends - counts
        keep = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return many, rolled[keep]
