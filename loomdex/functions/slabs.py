"""Sizes of the slabs that a growing postings list asks for, in blocks."""

from __future__ import annotations

from math import sqrt

#: Fixed values of the layouts: bytes of a block, of the link in front of a continued slab, of the head of the fixed and
#: of the growing layout, largest growth index, first slab size in bytes that is refused, base of exponential growth.
BLOCK, LINK, HEAD_FIXED, HEAD_GROWING, LAST_GROWTH, REFUSED, BASE = 64, 4, 18, 20, 255, 65_535, 1.1


def slab_sizes(growth: str) -> list[int]:
    """Blocks of the slabs with growth index 0 to 255: ``fixed``, ``triangle`` or ``expon``.

    A slab should waste about what its link costs (triangle), or a tenth of what is stored so far (expon).
    """
    if growth == "fixed":
        return [1] * (LAST_GROWTH + 1)
    wish = {"triangle": lambda stored: sqrt(2.0 * LINK * stored), "expon": lambda stored: (BASE - 1) * stored}[growth]
    sizes, stored = [1], BLOCK - LINK
    while len(sizes) <= LAST_GROWTH:
        blocks = int((LINK + wish(stored)) / BLOCK + 0.9999)
        stored += blocks * BLOCK - LINK
        sizes.append(blocks if blocks * BLOCK < REFUSED else sizes[-1])
    return sizes


def head_bytes(growth: str) -> int:
    """Bytes in a head block before the term."""
    return HEAD_FIXED if growth == "fixed" else HEAD_GROWING
