"""Candidate search shared by the two substring operators.

A window is W consecutive tokens (words or bytes) of a document. Two equal windows hold equal k-grams, so they have the
same smallest k-gram hash, the window's *anchor*. Only anchors travel: some 2 / (W - k + 2) of all positions. A window can
recur only if its anchor occurs in at least two documents; every other window is settled without being compared.

Windows with one anchor that follow one another are a *stretch*, of at most W - k + 1 windows, so texts that repeat a few
tokens for ever fall into equal stretches.

Skew: within an Arrow batch an anchor is sent once, for its smallest document; its other documents are known to share it
and only pass through. A group holds at most one entry of each batch, however common the anchor is. A stretch is sent with
its text once for a batch; further documents with it have a smaller document beside them and are settled there. Rows
without an id have keys of their own behind all ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, cut, shards_for, text_buffer

U = np.uint64
_BASE, _MULT = 0x9E3779B97F4A7C15, U(0xD6E8FEB86659FD93)
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(20240917)).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
#: Tokens handled at a time, which bounds the memory whatever the length of a text.
PIECE = 1 << 17
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * _MULT
    return h ^ (h >> U(29))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 4096), base, np.uint64)
        steps[0] = 1
        _powers[base] = have = np.cumprod(steps)
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value * base**position, modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:stop], independent of the place."""
    inverse = _power(_INVERSE, len(prefix))
    return (prefix[stop] - prefix[start]) * inverse[start]


def byte_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[Callable[[int, int], np.ndarray], np.ndarray]:
    return lambda a, b: _BYTES[data[a:b]], offsets


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, words before each document) of the words in a buffer of documents."""
    low, high = int(offsets[0]), int(offsets[-1])
    part = data[low:high]
    ink = ~((part == 32) | ((part >= 9) & (part <= 13)))
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    inner = offsets[1:-1] - low
    inner = inner[(inner > 0) & (inner < len(part))]
    first[inner] = ink[inner]
    last[inner - 1] = ink[inner - 1]
    starts, stops = np.flatnonzero(first) + low, np.flatnonzero(last) + low + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[Callable[[int, int], np.ndarray], np.ndarray]:
    starts, stops, before = word_bounds(data, offsets)

    def values(a: int, b: int) -> np.ndarray:
        if a == b:
            return np.zeros(0, np.uint64)
        low = int(starts[a])
        prefix = prefix_hash(_BYTES[data[low : int(stops[b - 1])]])
        return mix(span_hash(prefix, starts[a:b] - low, stops[a:b] - low)) | U(1)

    return values, before


def anchors(values: np.ndarray, width: int, k: int) -> np.ndarray:
    """The anchor of each window that starts in an array of token values."""
    n = len(values) - k + 1
    if n <= width - k:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    low = mix(span_hash(prefix_hash(values), at, at + k))
    span, want = 1, width - k + 1
    while span < want:
        step = min(span, want - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    return low


def batch_anchors(tokens: Callable, bounds: np.ndarray, width: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document of the batch, window's start in it, anchor) of all windows, some PIECE windows at a time."""
    last = int(bounds[-1])
    at = int(bounds[0])
    while at < last:
        stop = min(at + PIECE, last)
        end = min(stop + width - 1, last)
        low = anchors(tokens(at, end), width, k)
        if len(low):
            place = np.arange(at, at + len(low))
            docs = np.searchsorted(bounds, place, side="right") - 1
            inside = place + width <= bounds[docs + 1]
            yield docs[inside], (place - bounds[docs])[inside], low[inside]
        at = stop


def key48(low: np.ndarray) -> np.ndarray:
    """48 bits of an anchor. Anchors that share them are candidates of each other, no more: texts decide later."""
    return mix(low) >> U(16)


def pack(values: np.ndarray) -> bytes:
    """Byte planes without those that are all zero, which the shuffle's compression can shrink."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : blob[0]] = planes.T
    return out.reshape(-1).view(np.uint64)


def _shift(ids: np.ndarray) -> np.ndarray:
    """Signed ids as unsigned numbers of the same order, small for small ids."""
    return (ids.astype(np.int64).view(np.uint64) << U(1)) ^ np.where(ids < 0, ~U(0), U(0))


def _unshift(values: np.ndarray) -> np.ndarray:
    return ((values >> U(1)) ^ (~(values & U(1)) + U(1))).view(np.int64)


_SENT = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("anchors", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary())])


def _send(batches: Iterator[pa.RecordBatch], tokenise: Callable, width: int, k: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """For each batch and bucket of anchors: each anchor once, with its smallest document and how many have it. Further
    documents with an anchor are known to share it; they pass through the bucket of their id."""
    for batch in batches:
        ids = batch.column("did").to_numpy(zero_copy_only=False).astype(np.int64)
        found, owner = [], []
        for docs, _, low in batch_anchors(*tokenise(*text_buffer(batch.column("text"))), width, k):
            if len(low):
                change = np.r_[True, (low[1:] != low[:-1]) | (docs[1:] != docs[:-1])]
                found.append(key48(low[change]))
                owner.append(ids[docs[change]])
        if not found:
            continue
        low, doc = np.concatenate(found), np.concatenate(owner)
        order = np.lexsort((doc, low))
        low, doc = low[order], doc[order]
        fresh = np.r_[True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])]
        low, doc = low[fresh], doc[fresh]
        first = np.r_[True, low[1:] != low[:-1]]
        counts = np.diff(np.r_[np.flatnonzero(first), len(low)]).astype(np.uint64)
        rows = {name: [] for name in _SENT.names}

        def add(known: bool, a: np.ndarray, d: np.ndarray, c: np.ndarray, bucket: np.ndarray, rows: dict = rows) -> None:
            for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(bucket)) + 1):
                if len(part):
                    for name, value in zip(_SENT.names, (int(bucket[part[0]]), known, pack(np.diff(a[part], prepend=U(0))), pack(_shift(d[part])), pack(c[part])), strict=True):
                        rows[name].append(value)

        scaled = (low[first] >> U(16)) * U(n_buckets) >> U(32)
        add(False, low[first], doc[first], counts, scaled.astype(np.int32))
        a, d = low[~first], doc[~first]
        by = (mix(d.view(np.uint64)) % U(n_buckets)).astype(np.int32)
        order = np.lexsort((a, by))
        add(True, a[order], d[order], np.zeros(len(a), np.uint64), by[order])
        yield pa.RecordBatch.from_pydict(rows, schema=_SENT)


def _meet(group: pd.DataFrame, hot_from: int) -> pd.DataFrame:
    """Anchors of a bucket that at least two documents have, with these documents; those of very many also without one."""
    low = [np.cumsum(unpack(x)) for x in group["anchors"]]
    doc = [_unshift(unpack(x)) for x in group["docs"]]
    counts = [unpack(x) for x in group["counts"]]
    known = group["known"].to_numpy(bool)
    pick = lambda parts, flag, kind: np.concatenate([np.zeros(0, kind), *[x for x, f in zip(parts, known, strict=True) if f == flag]])
    a, d, c = pick(low, False, np.uint64), pick(doc, False, np.int64), pick(counts, False, np.uint64)
    order = np.argsort(a, kind="stable")
    a, d, c = a[order], d[order], c[order]
    hot = a[:0]
    if len(a):
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        sizes = np.diff(np.r_[starts, len(a)])
        total = np.add.reduceat(c, starts)
        many = np.repeat((np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)) | (np.maximum.reduceat(c, starts) > 1), sizes)
        hot = a[starts[total >= hot_from]]
        a, d = a[many], d[many]
    anchors = np.r_[a, pick(low, True, np.uint64), hot]
    none = np.arange(len(anchors)) >= len(anchors) - len(hot)
    docs = np.r_[d, pick(doc, True, np.int64), np.zeros(len(hot), np.int64)]
    return pd.DataFrame({"did": pd.arrays.IntegerArray(docs, none), "anchor": (anchors & U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)})


@dataclass(frozen=True)
class Keyed:
    """Documents with the columns that the search needs: doc_id, did (the key of comparisons), row (32 bits that tell rows
    of one id apart) and text; the bytes of all texts; and the largest id. Keys above it belong to rows without an id."""

    docs: DataFrame
    size: int
    top: int


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> Keyed:
    """A row without an id gets a key above all ids, from the hash of its text. One pass finds the largest id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = rows.agg(F.sum(F.octet_length("text")).alias("n"), F.max("doc_id").alias("top")).first()
    top = min(NO_ID - 1, max(0, known["top"] or 0))
    hashed = F.xxhash64("text")
    own = F.lit(top + 1) + F.pmod(hashed, F.lit(NO_ID - top))
    # The last value never counts; it says that keys aren't null, so that no filter sets the two uses of the rows apart.
    return Keyed(rows.select("doc_id", F.coalesce("doc_id", own, F.lit(NO_ID)).alias("did"), hashed.bitwiseAND(F.lit(0xFFFFFFFF)).alias("row"), "text"), int(known["n"] or 0), top)


#: Anchors that may be hot at once, which bounds what is sent to every task (4 MB), and from how many documents at least.
MOST_HOT, LEAST_HOT = 1_000_000, 2000


def shared_anchors(docs: DataFrame, tokenise: Callable, width: int, k: int, size: int) -> DataFrame:
    """(did, anchors): of each document 32 bits of the anchors that another document has too. The row without an id has
    the hot ones. An anchor is hot from size / MOST_HOT documents on; texts of `size` bytes have no more anchors than
    bytes, so at most MOST_HOT can be. Checkpointed: two readers follow."""
    n_buckets = max(shards_for(size, 8 << 20), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot_from = max(LEAST_HOT, -(-size // MOST_HOT))
    sent = docs.select("did", "text").mapInArrow(lambda batches: _send(batches, tokenise, width, k, n_buckets), "bucket int, known boolean, anchors binary, docs binary, counts binary")
    met = sent.groupBy("bucket").applyInPandas(lambda g: _meet(g, hot_from), "did long, anchor int")
    # A set: repeated rows of one id say the same in every batch.
    return cut(met.groupBy("did").agg(F.collect_set("anchor").alias("anchors")))


def _short(low: np.ndarray) -> np.ndarray:
    return (key48(low) & U(0xFFFFFFFF)).astype(np.uint32)


#: A run of windows travels as one number: its start and, in the low bits, its length. Longer runs are cut.
RUN_BITS, LONGEST = 22, 1 << 20
_SHIPPED = pa.schema([("shard", pa.int32()), ("meta", pa.list_(pa.binary())), ("body", pa.binary())])


def _ship(shard: np.ndarray, columns: list[np.ndarray], bodies: list[bytes] | None) -> Iterator[pa.RecordBatch]:
    """A row for each shard: the columns packed, the bodies joined and compressed."""
    order = np.argsort(shard, kind="stable")
    shard, columns = shard[order], [c[order] for c in columns]
    ends = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(shard)]
    press = zstandard.ZstdCompressor(level=3)
    for low in range(0, len(ends) - 1, 256):
        rows: dict[str, list] = {name: [] for name in _SHIPPED.names}
        for a, b in zip(ends[low : low + 256].tolist(), ends[low + 1 : low + 257].tolist(), strict=False):
            rows["shard"].append(int(shard[a]))
            rows["meta"].append([pack(c[a:b]) for c in columns])
            rows["body"].append(None if bodies is None else press.compress(b"".join([bodies[i] for i in order[a:b].tolist()])))
        yield pa.RecordBatch.from_pydict(rows, schema=_SHIPPED)


def _segments(batches: Iterator[pa.RecordBatch], tokenise: Callable, body_of: Callable, width: int, k: int, hot: np.ndarray, top: int, n_shards: int) -> Iterator[pa.RecordBatch]:
    """The stretches with shared anchors. The text of a stretch is sent once for a batch, with all places of the smallest
    document that holds it (of all documents, where none has an id); other documents' windows are settled at once."""
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        ids = batch.column("did").to_numpy(zero_copy_only=False).astype(np.int64)
        rows = batch.column("row").to_numpy(zero_copy_only=False).astype(np.int64)
        wanted = batch.column("anchors")
        wanted = wanted.combine_chunks() if isinstance(wanted, pa.ChunkedArray) else wanted
        wanted = np.unique(wanted.flatten().to_numpy(zero_copy_only=False).astype(np.int32).view(np.uint32))
        if not len(wanted):
            continue
        tokens, bounds = tokenise(data, offsets)
        parts = []
        for docs, place, low in batch_anchors(tokens, bounds, width, k):
            short = _short(low)
            keep = wanted[np.minimum(np.searchsorted(wanted, short), len(wanted) - 1)] == short
            docs, place, low, short = docs[keep], place[keep], low[keep], short[keep]
            if not len(low):
                continue
            single = hot[np.minimum(np.searchsorted(hot, short), len(hot) - 1)] == short if len(hot) else np.zeros(len(low), bool)
            new = np.r_[True, (low[1:] != low[:-1]) | (docs[1:] != docs[:-1]) | (np.diff(place) != 1)] | single
            since = np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            new |= since % (width - k + 1) == 0
            at = np.flatnonzero(new)
            parts.append((docs[at], place[at], np.diff(np.r_[at, len(low)]), low[at], single[at]))
        if not parts:
            continue
        docs, place, count, low, single = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(ids[docs], kind="stable")
        docs, place, count, low, single = docs[order], place[order], count[order], low[order], single[order]
        bodies = body_of(data, offsets, bounds, docs, place, place + count + width - 1)
        seen: dict[bytes, int] = {}
        first = np.fromiter((seen.setdefault(b, i) for i, b in enumerate(bodies)), np.int64, len(bodies))
        del seen
        did = ids[docs]
        settled = (did[first] <= top) & (did[first] < did)
        known = np.flatnonzero(settled)
        if len(known):
            yield from _ship(*_joined(docs[known], place[known], count[known], ids, rows, n_shards), None)
        sent = np.flatnonzero(~settled)
        sent = sent[np.argsort(first[sent], kind="stable")]  # the places of one text follow one another
        docs, place, count, key, did, first, single = (x[sent] for x in (docs, place, count, low, did, first, single))
        lead = first == sent
        bodies = [bodies[i] if own else b"" for i, own in zip(sent.tolist(), lead.tolist(), strict=True)]
        lone = np.flatnonzero(single & lead)
        key[lone] = np.fromiter((hash_bytes(bodies[i]) for i in lone.tolist()), np.uint64, len(lone))
        key = mix(key[np.maximum.accumulate(np.where(lead, np.arange(len(lead)), 0))])
        columns = [_shift(did), rows[docs].view(np.uint64), place.astype(np.uint64), count.astype(np.uint64), key & U(0xFFFFFFFF), np.fromiter(map(len, bodies), np.uint64, len(bodies))]
        yield from _ship(((key >> U(32)) % U(n_shards)).astype(np.int32), columns, bodies)


def _joined(docs: np.ndarray, place: np.ndarray, count: np.ndarray, ids: np.ndarray, rows: np.ndarray, n_shards: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(shard, columns) of stretches that need no comparison, adjoining ones as one. They pass through the shards."""
    order = np.lexsort((place, docs))
    docs, place, count = docs[order], place[order], count[order]
    new = np.r_[True, (docs[1:] != docs[:-1]) | (place[1:] != place[:-1] + count[:-1])]
    before = np.cumsum(count) - count
    length = (before - np.maximum.accumulate(np.where(new, before, 0))) // LONGEST
    at = np.flatnonzero(new | np.r_[False, length[1:] != length[:-1]])
    docs, place, count = docs[at], place[at], np.add.reduceat(count, at)
    shard = (mix(ids[docs].view(np.uint64)) % U(n_shards)).astype(np.int32)
    return shard, [_shift(ids[docs]), rows[docs].view(np.uint64), place.astype(np.uint64), count.astype(np.uint64)]


@dataclass
class Shard:
    """The stretches of a shard that are to be compared: text number `body[i]` of `texts` starts with window `start[i]` of
    document `did[i]`, row `row[i]`, and has `n` windows; texts with one anchor may be equal."""

    did: np.ndarray
    row: np.ndarray
    start: np.ndarray
    body: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    texts: list[bytes]


def _opened(group: pd.DataFrame) -> tuple[list[np.ndarray], Shard]:
    """(did, row, start, n of settled stretches; stretches to compare) of a shard's rows."""
    settled: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 4]
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 6]
    texts: list[bytes] = []
    for meta, body in zip(group["meta"], group["body"], strict=True):
        columns = [unpack(x) for x in meta]
        columns = [_unshift(columns[0]), *[x.astype(np.int64) for x in columns[1:]]]
        if body is None:
            settled.append(columns)
            continue
        lead = columns[5] > 0
        parts.append([*columns[:5], np.cumsum(lead) - 1 + len(texts)])
        text, ends = zstandard.ZstdDecompressor().decompress(body), np.cumsum(columns[5][lead]).tolist()
        texts += [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    did, row, start, n, anchor, which = (np.concatenate(x) for x in zip(*parts, strict=True))
    head = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else which
    return [np.concatenate(x) for x in zip(*settled, strict=True)], Shard(did, row, start, which, n[head], anchor[head], texts)


def hash_bytes(body: bytes) -> int:
    values = _BYTES[np.frombuffer(body, np.uint8)]
    return int(mix(prefix_hash(values)[-1:])[0])


def repeated_windows(keyed: Keyed, tokenise: Callable, body_of: Callable, confirm: Callable[[Shard, int], list[np.ndarray]], width: int, k: int) -> DataFrame:
    """(did, row, hits): of each document the runs of windows that also start in a document with a smaller id.

    `confirm` gets a shard's stretches with their whole text and the largest id, decides on the text itself and returns
    (did, row, start, n) of runs of windows."""
    docs, top = keyed.docs, keyed.top
    shared = shared_anchors(docs, tokenise, width, k, keyed.size)
    hot = [a for r in shared.where("did is null").toLocalIterator() for a in r["anchors"]]
    hot = docs.sparkSession.sparkContext.broadcast(np.unique(np.array(hot, np.int32).view(np.uint32)))
    n_shards = max(shards_for(keyed.size, 2 << 20), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # All columns of docs, though doc_id isn't needed: the exchange is the one that with_hits reads.
    stretches = docs.join(shared, "did").select("doc_id", "did", "row", "text", "anchors").mapInArrow(lambda b: _segments(b, tokenise, body_of, width, k, hot.value, top, n_shards), "shard int, meta array<binary>, body binary")

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        settled, open_ = _opened(group)
        did, row, start, n = (np.concatenate(x) for x in zip(settled, confirm(open_, top), strict=True))
        order = np.argsort(did, kind="stable")  # neighbours that share bytes compress
        return pd.DataFrame({"did": did[order], "row": row[order], "run": (start << RUN_BITS | n)[order]})

    found = stretches.groupBy("shard").applyInPandas(settle, "did long, row long, run long")
    return found.repartition("did").groupBy("did", "row").agg(F.collect_set("run").alias("hits"))


def with_hits(keyed: Keyed, hits: DataFrame) -> DataFrame:
    """(doc_id, text, hits) of all documents. Both sides are dealt by did alone, as they are already; the few rows of one id
    are told apart behind the join."""
    told = hits.select(F.col("did").alias("of"), F.col("row").alias("of_row"), "hits")
    return keyed.docs.join(told, (F.col("did") == F.col("of")) & (F.col("row").bitwiseXOR(F.col("of_row")) == 0), "left").select("doc_id", "did", "row", "text", "hits")


def hits_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first window, number of windows) of each document's runs."""
    column = batch.column("hits")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, flat, valid = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)
    for a, b, own in zip(offsets[:-1].tolist(), offsets[1:].tolist(), valid.tolist(), strict=True):
        values = flat[a:b] if own else flat[:0]
        yield values >> RUN_BITS, values & ((1 << RUN_BITS) - 1)


def smaller_owners(held: np.ndarray, shard: Shard, lowest: np.ndarray) -> list[np.ndarray]:
    """(did, row, start, n) of the runs of windows whose smallest document (`lowest`, for each window of each text, the texts'
    windows one after the other; `held`: the first of each text) is smaller than the document that holds them."""
    n = shard.n[shard.body]
    which = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    found = lowest[held[shard.body][which] + step] < shard.did[which]
    which, step = which[found], step[found]
    first = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (np.diff(step) != 1)]) if len(which) else which
    own = which[first]
    return [shard.did[own], shard.row[own], shard.start[own] + step[first], np.diff(np.r_[first, len(which)])]
