"""Edit distance of two sequences, bit-parallel: one column of the table is two integers of a bit a row."""

from __future__ import annotations

from collections.abc import Sequence

#: Width of the first band. Sequences up to this length are compared whole.
BAND = 512


def common(a: Sequence, b: Sequence) -> int:
    """Length of the longest common prefix, by halves: slices are compared, not items."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def banded(a: Sequence, b: Sequence, k: int) -> int:
    """The distance of a and b (len(b) <= len(a) <= len(b) + k) where it is at most k, else a number above k.

    Myers' recurrence in Hyyrö's form, over stretches of 2k items of b against the rows of a that lie within k of them. Rows
    above a window grow by one a step and rows below it by one a row: both are edits, so that no cell is below its true value."""
    up, down, low, high, top = 0, 0, 0, 0, 0
    for start in range(0, len(b), 2 * k):
        stop = min(len(b), start + 2 * k)
        first, last = max(0, start - k), min(len(a), stop + k)
        gone = (1 << (first - low)) - 1
        top += (up & gone).bit_count() - (down & gone).bit_count()
        up, down = up >> (first - low) | ((1 << (last - high)) - 1) << (high - first), down >> (first - low)
        low, high = first, last
        full, at, bit = (1 << (high - low)) - 1, {}, 1
        for item in a[low:high]:
            at[item] = at.get(item, 0) | bit
            bit <<= 1
        for item in b[start:stop]:
            same = at.get(item, 0)
            diagonal = (((same & up) + up) ^ up) | same
            right = ((down | (full ^ (diagonal | up))) << 1 | 1) & full
            left = (up & diagonal) << 1 & full
            same |= down
            up, down = left | (full ^ (same | right)), right & same
        top += stop - start
    return top + up.bit_count() - down.bit_count()


def levenshtein(a: Sequence, b: Sequence) -> int:
    """What both begin and end with is cut off; the rest is compared in a band that widens until it holds the distance: the
    work is the length times the distance, some thirty cells a machine word."""
    n = common(a, b)
    a, b = a[n:][::-1], b[n:][::-1]
    n = common(a, b)
    a, b = a[n:], b[n:]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    k = BAND
    while k < len(a) - len(b):
        k *= 4
    while (found := banded(a, b, k)) > k and k < len(a):
        k *= 4
    return found
