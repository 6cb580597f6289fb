import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loomdex.llm import textarrays as t

alphabet = st.text(st.sampled_from("abAB é \t\n\x0b\x0c\r😀.x"), max_size=40)


def words_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^ \t\n\x0b\x0c\r]+", text)]


@settings(max_examples=60, deadline=None)
@given(st.lists(alphabet, max_size=12))
def test_words_and_shingles_match_plain_python(texts):
    names, counts, shingle_names = {}, [], {}
    for lo, hi, c, h in t.words(pa.array(texts, pa.string())):
        counts += c.tolist()
        many, every = t.shingles(c, h)
        at = to = 0
        for row, k, m in zip(range(lo, hi), c.tolist(), many.tolist()):
            w = words_of(texts[row])
            assert len(w) == k
            for word, value in zip(w, h[at : at + k].tolist()):
                assert names.setdefault(word, value) == value
            want = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * bool(w)
            assert m == len(want)
            for s, value in zip(want, every[to : to + m].tolist()):
                assert shingle_names.setdefault(s, value) == value
            at, to = at + k, to + m
    assert len(counts) == len(texts)
    assert len(set(names.values())) == len(names)
    assert len(set(shingle_names.values())) == len(shingle_names)


def test_long_text_is_whole():
    text = "lorem ipsum dolor " * 200_000 + "x" * 3_000_000 + " end"
    (_, _, counts, hashes), = t.words(pa.array([text]))
    assert counts.tolist() == [600_002]
    assert len(np.unique(hashes)) == 5


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abAé \n😀.x中，。ไ々—" + "ü" * 3), min_size=1, max_size=60), st.booleans(), st.integers(4, 9))
def test_blocks_do_not_matter(text, letters, block):
    data = np.frombuffer(text.encode(), np.uint8)
    with np.errstate(over="ignore"):
        whole, _ = t._hash_block(data, np.zeros(1, np.int64), letters)
        old = t.BLOCK
        t.BLOCK = block
        try:
            assert t._hash_long(data, letters).tolist() == whole.tolist()
        finally:
            t.BLOCK = old


def letter_words(text):
    kind = lambda c: 2 if "\u3041" <= c <= "\u9fff" or "\u0e00" <= c <= "\u0eff" else int(c.isalpha() or "\u0300" <= c <= "\u036f")
    out = []
    for before, c in zip(" " + text, text):
        if kind(c):
            if out and kind(before) == 1 == kind(c):
                out[-1] += c
            else:
                out.append(c)
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abé—’ \n😀.x中文，。ไทยüだ！ａ×ß«»\xa0漢éq한국"), max_size=40))
def test_letters_by_unicode_class(text):
    (_, _, counts, hashes), *_ = t.words(pa.array([text]), letters=True)
    want = letter_words(text)
    assert counts.tolist() == [len(want)]
    names = {}
    for w, h in zip(want, hashes.tolist()):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_giant_words_take_little_memory():
    for text in ("x" * 30_000_000, "中" * 5_000_000, "é" * 12_000_000):
        for letters in (False, True):
            (_, _, counts, _), = t.words(pa.array([text]), letters)
            assert counts.tolist() == [5_000_000 if letters and text[0] == "中" else 1]
    assert len(t._powers[0]) <= t.BLOCK + 1


def test_sliced_column_and_letters():
    col = pa.array(["skip", "a-b 1c", "", "Ü!"])[1:]
    (_, _, counts, _), = t.words(col, letters=True)
    assert counts.tolist() == [3, 0, 1]
