"""Scalar functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: C-locale white space, spelled out: engines disagree on what their own class for it holds.
SPACE = r"[ \t\n\x0B\f\r]+"
BLANKS = " \t\n\x0b\f\r"


def tokenize(text: Column, max_token_bytes: int | None = None, split_long: bool = False) -> Column:
    """Tokens of a text in order, empty ones dropped; null gives none. No folding, stemming or stopping.

    With ``max_token_bytes`` longer tokens are cut to their longest prefix of so many bytes that ends at a character,
    or, with ``split_long``, broken into consecutive pieces of at most so many characters.
    """
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))  # so that empty words can be at no end
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))
    if max_token_bytes is None:
        return words
    if split_long:
        return F.flatten(F.transform(words, lambda w: F.regexp_extract_all(w, F.lit(f"(?s).{{1,{max_token_bytes}}}"), F.lit(0))))
    # the longest prefix of n bytes: the count of characters is found on the prefix of n characters
    sizes = F.sequence(F.lit(1), F.lit(max_token_bytes))
    fits = lambda w: F.array_max(F.filter(F.transform(sizes, lambda k: F.when(F.octet_length(F.substring(w, 1, k)) <= max_token_bytes, k)), lambda k: k.isNotNull()))
    return F.transform(words, lambda w: F.when(F.octet_length(w) <= max_token_bytes, w).otherwise(F.substring(w, F.lit(1), F.coalesce(fits(w), F.lit(1)))))


def external_id(tokens: Column) -> Column:
    """First token of a docstream line, null for a blank one."""
    return F.get(tokens, F.lit(0))


def body(tokens: Column) -> Column:
    """Tokens after the external id."""
    return F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1)))


def bucket(term: Column, n: int) -> Column:
    """Bucket of a term among n."""
    return F.pmod(F.xxhash64(term), F.lit(n)).cast("bigint")


def termid_bucket(termid: Column, n: int) -> Column:
    """Bucket of a numeric term id among n."""
    return F.pmod(termid, F.lit(n)).cast("bigint")
