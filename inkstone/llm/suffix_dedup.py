"""Operator 2: substring dedup over bytes with a hash-compared suffix sort.

Stretches of windows that may recur meet in shards (`windows`). There they are suffixes of one buffer: prefix polynomial
hashes and a binary search give the common extension of two suffixes in a logarithmic number of steps, and a mergesort
orders the suffixes of an anchor by it. The order brings equal strings together: suffixes whose common extension reaches
the whole width are compared on their bytes, so a collision of hashes cannot join different texts. A byte goes if a 50-byte string that covers it also starts in a document with a
smaller id; strings are judged on the input, overlaps count and matches never cross documents.

Defined cases: null and empty texts and texts shorter than the width keep every byte. Repeated rows of one id do not count
as another document. Documents without an id come last and are nobody's source. Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import covered, runs, text_buffer
from .windows import Shard, byte_tokens, hits_of, prefix_hash, repeated_windows, smaller_owners, span_hash, with_hits, with_keys

WIDTH, ANCHOR = 50, 20
#: Windows that are sorted at a time.
BLOCK = 1 << 17
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
_VALUES = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _bodies(data: np.ndarray, offsets: np.ndarray, bounds: np.ndarray, docs: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[bytes]:
    at = offsets[docs]
    view = memoryview(data)
    return [bytes(view[a:b]) for a, b in zip((at + start).tolist(), (at + stop).tolist(), strict=True)]


class Suffixes:
    """Suffixes of a buffer, each limited to a length, compared through prefix hashes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.prefix = prefix_hash(_VALUES[data])
        padded = np.r_[data, np.zeros(8, np.uint8)]
        #: The eight bytes that start at each place, the first one in the highest bits.
        self.eight = np.ndarray(len(data) + 1, ">u8", padded, 0, (1,)).astype(np.uint64)

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at a and b, up to `most`: binary search over hash equality. The
        whole length is tried first."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        whole = span_hash(self.prefix, a, a + high) == span_hash(self.prefix, b, b + high)
        low[whole] = high[whole]
        high[~whole] -= 1
        while len(live := np.flatnonzero(low < high)):
            middle = (low[live] + high[live] + 1) >> 1
            x, y = a[live], b[live]
            same = span_hash(self.prefix, x, x + middle) == span_hash(self.prefix, y, y + middle)
            low[live[same]] = middle[same]
            high[live[~same]] = middle[~same] - 1
        return low

    def order(self, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the suffix at a (of length la) comes before, equals or follows the one at b. Suffixes that agree on
        their whole length by hash are compared on their bytes; should these differ, they decide."""
        most = np.minimum(la, lb)
        same = self.extension(a, b, most)
        full = np.flatnonzero(same == most)
        same[full] = self.verified(a[full], b[full], most[full])
        last = len(self.data) - 1
        x, y = self.data[np.minimum(a + same, last)].astype(np.int64), self.data[np.minimum(b + same, last)].astype(np.int64)
        return np.sign(np.where(same < most, x - y, la - lb))

    def verified(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """How far the bytes agree, up to `length`: eight at a time, the last eight again where they don't come out even."""
        out, live = length.copy(), np.arange(len(a))
        step = 0
        while len(live := live[step < length[live]]):
            size = np.minimum(length[live], 8)
            from_ = np.minimum(step, length[live] - size)
            differ = (self.eight[a[live] + from_] ^ self.eight[b[live] + from_]) >> (8 * (8 - size)).astype(np.uint64)
            wrong = np.flatnonzero(differ)
            if len(wrong):
                bits = np.array([x.bit_length() for x in differ[wrong].tolist()])
                out[live[wrong]] = from_[wrong] + size[wrong] - (bits + 7) // 8
                live = np.delete(live, wrong)
            step += 8
        return out

    def classes(self, group: np.ndarray, at: np.ndarray, length: np.ndarray, most: int = 1 << 19) -> np.ndarray:
        """For each item an item of its group with the same suffix, one and the same for all equal ones.

        Suffixes are dealt by group and first eight bytes; a mergesort orders each deal by extension. Suffixes that prove
        equal in a merge become one, so runs hold different suffixes only. Large inputs are merged a piece at a time."""
        lead = np.where(length >= 8, self.eight[at], self.eight[at] & ~(~np.uint64(0) >> np.minimum(8 * length, 63).astype(np.uint64)))
        parent = np.arange(len(at))
        order = np.lexsort((lead, group))
        same = (group[order][1:] == group[order][:-1]) & (lead[order][1:] == lead[order][:-1])
        deal = np.cumsum(np.r_[True, ~same]) - 1 if len(order) else order
        twice = np.r_[False, same] | np.r_[same, False] if len(order) else np.zeros(0, bool)
        order, deal = order[twice], deal[twice]
        pieces = range(0, len(order), most)
        if len(pieces) > 1:
            left = [self.merge(order[low : low + most], deal[low : low + most], at, length, parent) for low in pieces]
            order = np.concatenate([x for x, _ in left])
            deal = np.concatenate([x for _, x in left])
        self.merge(order, deal, at, length, parent)
        while True:  # an item's parent may have got one later
            up = parent[parent]
            if np.array_equal(up, parent):
                return parent
            parent = up

    def merge(self, order: np.ndarray, deal: np.ndarray, at: np.ndarray, length: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bottom-up mergesort within deals (ascending), all runs of a level at once. Returns the different items that are
        left, in order, with their deals; the others have got an equal one as parent."""
        n = len(order)
        first = np.r_[True, deal[1:] != deal[:-1]] if n else np.zeros(0, bool)
        begins = np.flatnonzero(first)
        run = np.arange(n) - np.repeat(begins, np.diff(np.r_[begins, n]))  # number of an item's run within its deal
        while len(order) and run.max(initial=0) > 0:
            new = np.r_[True, (deal[1:] != deal[:-1]) | (run[1:] != run[:-1])]
            begin = np.flatnonzero(new)
            size = np.diff(np.r_[begin, len(order)])
            number = np.cumsum(new) - 1
            right = run % 2 == 1
            pair = number + np.where(right, -1, 1)
            inside = (pair >= 0) & (pair < len(begin))
            pair = np.where(inside, pair, 0)
            inside &= (deal[begin[pair]] == deal) & (run[begin[pair]] // 2 == run // 2)
            own = np.arange(len(order)) - begin[number]
            low, high, shift = np.zeros(len(order), np.int64), np.where(inside, size[pair], 0), begin[pair]
            twin = np.full(len(order), -1)  # the equal item of the sibling run
            while len(live := np.flatnonzero(low < high)):
                middle = (low[live] + high[live]) >> 1
                probe, mine = order[shift[live] + middle], order[live]
                sign = self.order(at[probe], length[probe], at[mine], length[mine])
                low[live[sign < 0]] = middle[sign < 0] + 1
                high[live[sign > 0]] = middle[sign > 0]
                equal = live[sign == 0]
                low[equal] = high[equal] = middle[sign == 0]
                twin[equal] = probe[sign == 0]
            gone = right & (twin >= 0)
            parent[order[gone]] = twin[gone]
            place = np.where(right & inside, shift, begin[number]) + own + low + gone
            merged, kept = np.empty_like(order), np.empty(len(order), bool)
            merged[place], kept[place] = order, ~gone
            deals, runs_ = np.empty_like(deal), np.empty_like(run)
            deals[place], runs_[place] = deal, run // 2
            order, deal, run = merged[kept], deals[kept], runs_[kept]
        return order, deal


def _lowest(parent: np.ndarray, did: np.ndarray) -> np.ndarray:
    """The smallest document of each item's class."""
    low = np.full(len(parent), np.iinfo(np.int64).max)
    np.minimum.at(low, parent, did)
    return low[parent]


def compare(shard: Shard, top: int, width: int = WIDTH) -> list[np.ndarray]:
    """Of a shard's stretches, the windows that a smaller document (with an id, so `top` at most) holds too, as runs.

    Whole stretches are sorted first, so that equal ones become one; then the suffixes at all windows of the different ones.
    Neighbours in that order whose common extension has the whole width are equal windows."""
    length = np.fromiter(map(len, shard.texts), np.int64, len(shard.texts))
    at = np.cumsum(length) - length
    suffixes = Suffixes(np.frombuffer(b"".join(shard.texts), np.uint8))
    owner = np.full(len(at), np.iinfo(np.int64).max)
    real = shard.did <= top
    np.minimum.at(owner, shard.body[real], shard.did[real])
    same = suffixes.classes(shard.anchor, at, length)
    whole = _lowest(same, owner)
    own = np.flatnonzero(same == np.arange(len(same)))  # one stretch for each class
    own = own[np.argsort(shard.anchor[own], kind="stable")]
    n = shard.n[own]
    held, before = np.zeros(len(at), np.int64), np.r_[0, np.cumsum(n)]
    held[own] = before[:-1]
    lowest = np.empty(before[-1], np.int64)
    for low, high in _blocks(shard.anchor[own], before, BLOCK):
        which = np.repeat(own[low:high], n[low:high])
        place = at[which] + np.arange(len(which)) - np.repeat(before[low:high] - before[low], n[low:high])
        parent = suffixes.classes(shard.anchor[which], place, np.full(len(place), width, np.int64))
        lowest[before[low] : before[high]] = _lowest(parent, whole[which])
    return smaller_owners(held[same], shard, lowest)


def _blocks(anchor: np.ndarray, before: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut stretches, ascending by anchor, into blocks of some `most` windows that leave anchors whole."""
    low = 0
    while low < len(anchor):
        high = int(np.searchsorted(before, before[low] + most, side="left"))
        high = len(anchor) if high >= len(anchor) else int(np.searchsorted(anchor, anchor[high - 1], side="right"))
        yield low, high
        low = high


def _remove(batches: Iterator[pa.RecordBatch], width: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {name: [] for name in _OUT.names}
        data, offsets = text_buffer(batch.column("text"))
        at = offsets.tolist()
        for i, (doc_id, (starts, counts)) in enumerate(zip(batch.column("doc_id").to_pylist(), hits_of(batch), strict=True)):
            body = data[at[i] : at[i + 1]]
            size, spans = len(body), 0
            if len(starts):
                gone = covered(starts, counts, width, size)
                spans = len(runs(np.flatnonzero(gone))[0])
                body = body[~gone]
            for name, value in zip(out, (doc_id, size, size - len(body), spans, hashlib.sha256(body).hexdigest(), body.tobytes() if keep_text else None), strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=_OUT)


def dedup_bytes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, anchor: int = ANCHOR, keep_text: bool = True) -> DataFrame:
    """Documents without the bytes of repeated strings: doc_id, n_bytes, n_removed, n_spans, kept_sha256, (if asked) kept."""
    keyed = with_keys(documents, id_col, text_col)
    hits = repeated_windows(keyed, byte_tokens, _bodies, lambda shard, top: compare(shard, top, width), width, anchor)
    return with_hits(keyed, hits).mapInArrow(lambda b: _remove(b, width, keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
