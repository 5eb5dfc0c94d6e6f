"""Operator 3: sharding by extendible hashing.

A directory is indexed by the leading bits of a hash of the id. All documents start in one bucket; a bucket above the
byte limit splits on its next bit, the others keep their depth. A document's shard is the shortest prefix whose bucket
fits. Sums are taken once for cells of a few more bits than needed and rolled up to every shorter prefix, so the work is
one aggregation over ids and sizes; only cells that are still too large are looked at again, with more bits.

Defined cases: null texts weigh nothing. Repeated rows of one id share a hash, so they can't be parted: a bucket that is
still too large when all hash bits are used is returned with fits = false; so is one that a single very long text fills.
Ties: ids whose hash bits are equal stay together, as repeated rows do. Rows without an id hash as the empty string. Extra
columns are ignored by `shard` and kept by `write_shards`, whose folders are named shard=p and the prefix, or shard_=, with
as many underscores as it takes, where the documents have a column of that name. An empty table gives no shards. The hash
is MD5, which SQL engines share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

LIMIT, BITS, ROUND_BITS = 64 << 20, 60, 12


def _bits(id_col: str) -> Column:
    """The first 60 bits of MD5(id as text), as 0s and 1s."""
    return F.lpad(F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 2), BITS, "0")


def directory(sized: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(prefix, depth, shard_bytes, shard_docs, fits) of the buckets, for rows of (bits, n_bytes)."""
    total = sized.agg(F.sum("n_bytes").alias("n")).first()["n"]
    if total is None:
        return sized.select(F.col("bits").alias("prefix"), F.lit(0).alias("depth"), F.col("n_bytes").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_docs"), F.lit(True).alias("fits")).limit(0)
    shallow, deep = 0, min(BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + 6)
    rows, done = sized, None
    while True:
        cells = rows.groupBy(F.substring("bits", 1, deep).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_docs"))
        cells = cut(cells)
        levels = cells.select("cell", "n_bytes", "n_docs", F.explode(F.sequence(F.lit(shallow), F.lit(deep))).alias("depth")).withColumn("prefix", F.expr("substring(cell, 1, depth)"))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n_docs").alias("shard_docs"))
        fits = (F.col("shard_bytes") <= limit) | F.lit(deep == BITS) & (F.col("depth") == BITS)
        # A prefix is a bucket if it fits and its parent, a prefix one bit shorter, does not.
        parents = sums.where(F.col("shard_bytes") > limit).select((F.col("depth") + 1).alias("d"), F.col("prefix").alias("p"))
        below = sums.where(fits).withColumn("parent", F.expr("substring(prefix, 1, depth - 1)"))
        split = below.where(F.col("depth") > shallow).join(parents, (F.col("depth") == F.col("d")) & (F.col("parent") == F.col("p")), "left_semi")
        found = split.unionByName(below.where(F.col("depth") == shallow)).select("prefix", "depth", "shard_bytes", "shard_docs", (F.col("shard_bytes") <= limit).alias("fits"))
        done = found if done is None else done.unionByName(found)
        large = cells.where(F.col("n_bytes") > limit).select("cell")
        if deep == BITS or large.isEmpty():
            return done
        rows = rows.withColumn("cell", F.substring("bits", 1, deep)).join(large, "cell", "left_semi").drop("cell")
        shallow, deep = deep + 1, min(BITS, deep + ROUND_BITS)
        # A cell that didn't fit has been split: its halves are judged next, whose parent is known to be too large.


def shard(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, shard (hash prefix), depth, shard_bytes, shard_docs, fits."""
    sized = documents.select(F.col(id_col).alias("doc_id"), _bits(id_col).alias("bits"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    buckets = cut(directory(sized, limit))
    depths = [r["depth"] for r in buckets.select("depth").distinct().orderBy("depth").toLocalIterator()]  # at most 61 values
    # The depths differ by a few; each row asks the directory for its prefix at each depth and finds exactly one.
    asked = sized.select("doc_id", "n_bytes", F.explode(F.array(*[F.substring("bits", 1, d) for d in depths] or [F.lit("")])).alias("prefix"))
    return asked.join(buckets, "prefix").select("doc_id", "n_bytes", F.col("prefix").alias("shard"), "depth", "shard_bytes", "shard_docs", "fits")


def write_shards(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> None:
    """Write the documents as Parquet, one folder for each shard (shard=p and its prefix), with all their columns."""
    key, label = free_name(documents, "key"), free_name(documents, "shard")
    labels = shard(documents, id_col, text_col, limit).select(F.col("doc_id").alias(key), F.concat(F.lit("p"), "shard").alias(label)).distinct()
    documents.join(labels, documents[id_col].eqNullSafe(labels[key])).drop(key).repartition(label).write.partitionBy(label).parquet(path)
