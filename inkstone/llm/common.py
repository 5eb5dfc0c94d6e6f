"""Helpers that several corpus operators share: tables, shared folders, Arrow buffers, sizes."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and ASCII control white space.
BLANK = r"[\x20\x09-\x0D]+"
#: Documents without an id sort after all others and own nothing.
NO_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A temporary one stands in for it in local mode alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column of df has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_col: str, text_col: str) -> Column:
    """What a row is known by: two 64-bit hashes of its id and text, of different seeds. Rows of one key have one id and text."""
    return F.struct(F.xxhash64(F.col(id_col), F.col(text_col)).alias("a"), F.xxhash64(F.lit("second"), F.col(id_col), F.col(text_col)).alias("b"))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, from which the number of shards follows."""
    return int(df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0)


def shards_for(size: int, per_shard: int) -> int:
    return max(1, -(-size // per_shard))


def words_of(text: Column) -> Column:
    """The words of a text as an array (null and blank texts: empty array)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column without copying; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = column.type
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(kind) or pa.types.is_large_string(kind) else b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of the runs of consecutive integers in a sorted array without repeats."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(np.diff(starts) != 1) + 1
    first = starts[np.r_[0, cuts]]
    return first, starts[np.r_[cuts, len(starts)] - 1] - first + 1


def covered(starts: np.ndarray, counts: np.ndarray, width: int, length: int) -> np.ndarray:
    """Mask of the positions that windows of a width cover; each run is a first window and a number of windows."""
    steps = np.zeros(length + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + counts + width - 1, length), -1)
    return np.cumsum(steps[:-1]) > 0
