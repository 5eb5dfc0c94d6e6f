"""Blocks with a figure beside calculations: a gutter parts the marks, each side falls into rows again, and rows are looked at anew.

marks(page_id, box_id, line_id, x0, y0, x1, y1) with the line each stands in; glyphs(page_id, glyph). Rows of a side are the
bands of marks with nothing between two bands. A block's path is its place in reading order: the line, then for each split the
side and the row, so that paths sort as they are read. Pages without a glyph are left out; equal gutters go to the left one;
marks that repeat in every column stay in one row and are returned as often as they came."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import layout
from .components import checkpointed

BLOCK = ["page_id", "path"]
SIDE = [*BLOCK, "side"]


def with_gutters(marks: DataFrame, gap: float = 2.5, side: float = 3.5, least_height: float = 1.8) -> DataFrame:
    """marks with middle, that of their block's widest empty vertical band, at least `gap` glyphs wide with `side` glyphs of the
    block on both sides; null where there is none or the block is not high enough for two rows."""
    block, order = W.partitionBy(*BLOCK), W.partitionBy(*BLOCK).orderBy("x0", "x1")
    held = marks.withColumn("__stop", F.max("x1").over(order.rowsBetween(W.unboundedPreceding, -1)))
    held = held.withColumns({"__left": F.min("x0").over(block), "__right": F.max("x1").over(block), "__high": F.max("y1").over(block) - F.min("y0").over(block)})
    wide, room = F.col("x0") - F.col("__stop"), F.floor(side * F.col("glyph"))
    fits = (wide > 0) & (wide >= F.floor(gap * F.col("glyph"))) & (F.col("__stop") - F.col("__left") >= room) & (F.col("__right") - F.col("x0") >= room) & (F.col("__high") >= least_height * F.col("glyph"))
    best = F.max(F.when(fits, F.struct(wide.alias("wide"), (-F.col("__stop")).alias("first"), F.col("x0").alias("end")))).over(block)
    held = held.withColumn("__b", best).withColumn("middle", (F.col("__b.end") - F.col("__b.first")) / 2)
    return held.drop("__stop", "__left", "__right", "__high", "__b")


def banded(marks: DataFrame) -> DataFrame:
    """marks with row, the number of their band within the block's side, from the top."""
    order = W.partitionBy(*SIDE).orderBy("y0", "y1", "box_id")
    reach = F.max("y1").over(order.rowsBetween(W.unboundedPreceding, -1))
    return marks.withColumn("__new", (F.col("y0") > reach).cast("int")).withColumn("row", F.coalesce(F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)).cast("int")).drop("__new")


def with_same_rows(rows: DataFrame, tall: float = 1.6, covered: float = 0.4) -> DataFrame:
    """rows with same: whether the two sides of their block have the same rows, as a matrix has. rows: banded marks. Low rows that
    cover little of their width (limits of a bar, exponents) do not count, unless a side has no others."""
    band = W.partitionBy(*SIDE, "row")
    reach = F.max("x1").over(band.orderBy("x0", "x1").rowsBetween(W.unboundedPreceding, -1))
    inked = rows.withColumn("__new", F.greatest(F.lit(0), F.col("x1") - F.greatest("x0", reach)))
    size = lambda c: F.max(f"{c}1").over(band) - F.min(f"{c}0").over(band)
    box = inked.withColumns({"__y0": F.min("y0").over(band), "__y1": F.max("y1").over(band), "__w": size("x"), "__ink": F.sum("__new").over(band)})
    real = (F.col("__y1") - F.col("__y0") > tall * F.col("glyph")) | (F.col("__ink") / F.greatest(F.lit(1), F.col("__w")) > covered)
    counted = box.withColumn("__real", real).withColumn("__counts", F.col("__real") | ~F.bool_or("__real").over(W.partitionBy(*SIDE)))
    ranked = counted.withColumn("__rank", F.dense_rank().over(W.partitionBy(*SIDE, "__counts").orderBy("row")))
    pair = W.partitionBy(*BLOCK, "__counts", "__rank")
    ends = ranked.withColumns({f"__{p}{i}": F.max(F.when(F.col("side") == s, F.col(f"__y{i}"))).over(pair) for s, p in ((0, "a"), (1, "b")) for i in (0, 1)})
    lower = F.least(F.col("__a1") - F.col("__a0"), F.col("__b1") - F.col("__b0"))
    beside = F.col("__a0").isNotNull() & F.col("__b0").isNotNull() & (G.overlap(*layout._c("__a0", "__a1", "__b0", "__b1")) > 0.5 * lower)
    same = F.min(F.when(F.col("__counts"), beside)).over(W.partitionBy(*BLOCK))
    return ends.withColumn("same", same).select(*rows.columns, "same")


def placed(marks: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Every mark (page_id, box_id, x0, y0, x1, y1) with the path of its block, after blocks are split until none has a gutter
    between sides of different rows. All blocks of all pages advance a step in each round: windows over one shuffle by block,
    checkpointed. Blocks that do not split leave the rounds, and a split parts a block's marks, so the rounds are at most as deep
    as columns are nested."""
    held = ["page_id", "box_id", "path", "x0", "y0", "x1", "y1"]
    now, done = marks.withColumn("path", F.array(F.col("line_id").cast("int"))).select(*held).join(glyphs.select("page_id", "glyph"), "page_id"), []
    while True:
        parted = with_gutters(now).withColumn("side", ((F.col("x0") + F.col("x1")) / 2 >= F.col("middle")).cast("int"))
        judged = with_same_rows(banded(parted)).withColumn("split", F.col("middle").isNotNull() & ~F.col("same"))
        judged = checkpointed(judged.select(*now.columns, "side", "row", "split"))
        done.append(judged.where("not split").select(*held))
        split = judged.where("split")
        if not split.head(1):
            break
        now = split.withColumn("path", F.concat("path", F.array("side", "row"))).select(*now.columns)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def split_columns(marks: DataFrame, glyphs: DataFrame) -> DataFrame:
    """(page_id, box_id, path): every mark with the path of its block."""
    return placed(marks, glyphs).select("page_id", "box_id", "path")


def reading_units(marks: DataFrame, glyphs: DataFrame) -> DataFrame:
    """(page_id, position, path, x0, y0, x1, y1, n_boxes): the blocks of each page in reading order; path as text, parts joined
    by dots. A page's blocks are ordered in one window: they are at most as many as its marks."""
    box = placed(marks, glyphs).groupBy(*BLOCK).agg(*[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")], F.count("*").alias("n_boxes"))
    place = F.row_number().over(W.partitionBy("page_id").orderBy("path"))
    return box.withColumn("position", place).select("page_id", "position", F.array_join(F.transform("path", lambda i: i.cast("string")), ".").alias("path"), "x0", "y0", "x1", "y1", "n_boxes")
