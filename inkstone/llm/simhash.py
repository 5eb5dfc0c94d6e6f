"""Operator 7: SimHash near-dedup with covering locality-sensitive hashing.

Each of the 64 bits gets a non-zero vector of r + 1 bits; table v (one for each of the 2**(r+1) - 1 non-zero vectors)
keeps the bits whose vector has an odd product with v. The r vectors of any r differing bits leave some v that is
orthogonal to all of them, and table v then keeps none of these bits: every pair within the radius collides somewhere.

Only distinct fingerprints enter the tables, so groups of exact copies weigh nothing. Buckets stream through their task.
Fingerprints of a bucket agree on about half their bits; a bucket too large to be compared at once is dealt again by masks
of the same kind over the other bits, after which at most 2**16 fingerprints can still share a key. Buckets yield a
spanning set of links, not all pairs; components come from a star contraction over these links.

Defined cases: null, empty and blank texts have fingerprint zero, which is linked like any other. Texts with fewer words
than a shingle are one shingle. A bit set in exactly half the shingles is 0. Repeated rows are exact copies. Rows without
an id get a null component of their own unless their text's fingerprint links them to rows with one. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import cut, free_name, row_key, text_buffer

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Members of a bucket that are compared at once; larger ones are dealt again.
LIMIT = 8192
#: Tasks over which the members of one component are dealt when they get its label.
PARTS = 16


def masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """The covering masks over some bits: one for each non-zero vector v of radius + 1 bits."""
    n = (1 << (radius + 1)) - 1
    vector = {bit: i % n + 1 for i, bit in enumerate(bits)}
    return [sum(1 << bit for bit in bits if (vector[bit] & v).bit_count() % 2) for v in range(1, n + 1)]


MASKS = masks(list(range(BITS)))
#: The masks of each table's second deal, over the bits that the table leaves out.
INNER = [masks([b for b in range(BITS) if not m >> b & 1]) for m in MASKS]


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        view, out = memoryview(data), np.zeros(batch.num_rows, np.uint64)
        for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            tokens = bytes(view[a:b]).lower().split()
            if not tokens:
                continue
            body = b" ".join(tokens)
            length = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
            stop = np.cumsum(length) - 1
            start = stop - length + 1
            n = max(1, len(tokens) - shingle + 1)
            start, stop = start[:n], stop[min(shingle, len(tokens)) - 1 :]
            counts, low = np.zeros(BITS, np.int64), 0
            while low < n:  # a piece at a time, whatever the length of the text
                part = slice(low, low + 65536)
                h = np.array([digest(body[x:y], SEED) for x, y in zip(start[part].tolist(), stop[part].tolist(), strict=True)], np.uint64)
                counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                low += 65536
            out[row] = np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0]
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out.view(np.int64))], names=[*kept, "fp"])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, **longs: Column) -> DataFrame:
    """(doc_id, fp): the SimHash of each document as a signed long; `longs` are columns between them."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), *[c.alias(k) for k, c in longs.items()], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return docs.mapInArrow(lambda b: _fingerprints(b, shingle), ", ".join(f"{c} long" for c in ("doc_id", *longs, "fp")))


def _near(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the radius graph of some distinct fingerprints: each against all later ones, and of its links to
    one component only the first."""
    n, label = len(fps), np.arange(len(fps))
    left, right = [], []
    if n <= 16:
        values, label = fps.tolist(), label.tolist()
        for i in range(n - 1):
            for j in range(i + 1, n):
                if label[i] != label[j] and (values[i] ^ values[j]).bit_count() <= radius:
                    old, new = label[j], label[i]
                    label = [new if x == old else x for x in label]
                    left.append(i)
                    right.append(j)
    else:
        for i in range(n - 1):
            later = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1
            later = later[label[later] != label[i]]
            if len(later):
                for other, first in zip(*np.unique(label[later], return_index=True), strict=True):
                    label[label == other] = label[i]
                    left.append(i)
                    right.append(int(later[first]))
    if left:
        yield fps[left], fps[right]


_LINKS = pa.schema([("table", pa.int32()), ("key", pa.int64()), ("src", pa.int64()), ("dst", pa.int64())])


def _rows(table: np.ndarray | None, key: np.ndarray | None, src: np.ndarray, dst: np.ndarray | None) -> pa.RecordBatch:
    n = len(src)
    column = lambda x, kind: pa.nulls(n, kind) if x is None else pa.array(x)
    return pa.RecordBatch.from_arrays([column(table, pa.int32()), column(key, pa.int64()), pa.array(src), column(dst, pa.int64())], schema=_LINKS)


def _compare(batches: Iterator[pa.RecordBatch], radius: int, limit: int, deal: bool) -> Iterator[pa.RecordBatch]:
    """Links within the buckets of a partition sorted by bucket; members of larger buckets, dealt again, if `deal`."""
    table, key, fps = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    big: tuple[int, int] | None = None  # the bucket that is being dealt again

    def again(t: int, part: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i, mask in enumerate(INNER[t]):
            yield _rows(np.full(len(part), (t + 1) * 64 + i, np.int32), (part & np.uint64(mask | MASKS[t])).view(np.int64), part.view(np.int64), None)

    def settle(end: bool) -> Iterator[pa.RecordBatch]:
        nonlocal table, key, fps, big
        cuts = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
        bounds = np.r_[0, cuts, len(fps)] if len(fps) else np.zeros(1, np.int64)
        sizes = np.diff(bounds)
        last = len(sizes) - 1
        for i in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == last)).tolist():
            a, b = int(bounds[i]), int(bounds[i + 1])
            here = (int(table[a]), int(key[a]))
            if here == big or (deal and b - a > limit):
                big = here
                yield from again(here[0], fps[a:b])
                if i == last:
                    a = b
            elif i == last and not end:
                pass  # it may go on in the next batch
            elif b - a > 1:
                for x, y in _near(fps[a:b], radius):
                    yield _rows(None, None, x.view(np.int64), y.view(np.int64))
            if i == last:
                table, key, fps = (table[a:], key[a:], fps[a:]) if not end else (table[:0], key[:0], fps[:0])

    for batch in batches:
        table = np.r_[table, batch.column("table").to_numpy(zero_copy_only=False).astype(np.int32)]
        key = np.r_[key, batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)]
        fps = np.r_[fps, batch.column("src").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)]
        yield from settle(False)
    if len(fps):
        yield from settle(True)


def links(distinct: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """(src, dst): links that span the graph of the distinct fingerprints (column fp) within the radius."""
    assert radius <= RADIUS, "the masks cover a radius of 4"
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in MASKS])
    dealt = distinct.select(F.col("fp").alias("src"), F.posexplode(keys).alias("table", "key"))
    step = lambda df, deal: df.repartition("table", "key").sortWithinPartitions("table", "key").mapInArrow(lambda b: _compare(b, radius, limit, deal), "table int, key long, src long, dst long")
    first = cut(step(dealt.select("table", "key", "src"), True))
    found = first.where("dst is not null").select("src", "dst")
    second = step(first.where("table is not null").select("table", "key", "src"), False).select("src", "dst")
    return found.unionByName(second).distinct()


def _components(owners: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, owner, component, linked) of the distinct fingerprints with their owners; `linked` to another one or not."""
    parts = connected_components(links(owners.select("fp"), radius))
    joined = owners.join(parts, owners["fp"] == parts["node"], "left")
    return joined.select("fp", "owner", F.coalesce("component", "fp").alias("component"), F.col("node").isNotNull().alias("linked"))


def near_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, fp, component_id (the smallest id it reaches through links of at most `radius` bits)."""
    prints = cut(fingerprints(documents, id_col, text_col, shingle))
    joined = _components(cut(prints.groupBy("fp").agg(F.min("doc_id").alias("owner"))), radius)
    linked = joined.where("linked")
    # A large component may hold many fingerprints: its members are dealt over several tasks, each with a copy of its label.
    # The copies grow with the input, so they are shuffled, never broadcast.
    lowest = linked.groupBy("component").agg(F.min("owner").alias("component_id")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).hint("merge")
    members = linked.withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(PARTS)).cast("int")).join(lowest, ["component", "part"])
    labels = members.select("fp", "component_id").unionByName(joined.where("not linked").select("fp", F.col("owner").alias("component_id")))
    # Copies of one text share a fingerprint: they are dealt over several tasks too.
    copies = labels.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).hint("merge")
    return prints.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")).join(copies, ["fp", "part"], "left").select("doc_id", "fp", "component_id")


def simhash_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """near_groups with the fingerprint as 16 lower-case hex digits."""
    df = near_groups(documents, id_col, text_col)
    return df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with its own columns: the one with the smallest id (none sorts last), then the smallest key of
    id and text; of rows equal in both, any one. Keys are two hashes, so that rows of different texts are never one."""
    key, name = row_key(id_col, text_col), free_name(documents, "key")
    prints = fingerprints(documents, id_col, text_col, key_a=key["a"], key_b=key["b"])
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    owners = cut(prints.groupBy("fp").agg(F.min(own).alias("owner")))
    winners = _components(owners).groupBy("component").agg(F.min("owner").alias("owner")).select(F.struct("owner.a", "owner.b").alias(name))
    # Equal rows are reduced before they are shuffled.
    rows = documents.withColumn(name, key).dropDuplicates([name])
    return rows.join(winners, name, "left_semi").drop(name)
