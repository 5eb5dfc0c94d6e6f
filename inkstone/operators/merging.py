"""Boxes that become other boxes: merges to a fixpoint, tables that take the writing in reach, pieces and fragments that join.

`merge_*` and `table_writing` are rounds over the whole relation: every page advances a step in each round, a round's boxes are
checkpointed, and pages (or tables) in which nothing changed leave the rounds. The others are ordered folds over a page's
boxes, which a page's aggregation collects: a page holds some hundred at most."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.latex import let
from . import layout
from .components import checkpointed

CORNERS = ("x0", "y0", "x1", "y1")
BOX = "struct<box_id:int,x0:int,y0:int,x1:int,y1:int,area:bigint>"


def _typed(boxes: DataFrame) -> DataFrame:
    return boxes.select("page_id", F.col("box_id").cast("int").alias("box_id"), *[F.col(c).cast("int").alias(c) for c in CORNERS], F.col("area").cast("long").alias("area"))


# ---------------------------------------------------------------- merges to a fixpoint


def close(gap: int | None) -> Column:
    """Whether boxes a and b share columns and are less than `gap` apart; without a gap, whether more than half of the lower one
    lies in the other's band."""
    near = (-layout.overlap_y() < gap) if gap is not None else layout.overlap_y() > 0.5 * F.least(F.col("a_y1") - F.col("a_y0"), F.col("b_y1") - F.col("b_y0"))
    return (layout.overlap_x() > 0) & near


def one_row() -> Column:
    """Whether boxes a and b are pieces of one row: less than two glyphs apart, and more than half of the lower one beside the
    other."""
    shared = layout.overlap_y() > 0.5 * F.least(F.col("a_y1") - F.col("a_y0"), F.col("b_y1") - F.col("b_y0"))
    return (-layout.overlap_x() < 2 * F.col("a_glyph")) & shared


def contract(boxes: DataFrame, edges: DataFrame) -> DataFrame:
    """The boxes after one step, in which each connected group becomes its union under its smallest id."""
    rows = layout.with_rows(boxes, edges)
    joined = rows.groupBy("page_id", F.col("row_id").alias("box_id"), "glyph").agg(*[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")], F.sum("area").alias("area"), F.sum("n_boxes").alias("n_boxes"))
    return joined.select(*boxes.columns)


def _union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _settled(moving: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame | None]:
    """(boxes, pages): the boxes after steps by one condition until it joins nothing, and the pages where it joined something
    (None without any). Pages where it joins nothing leave the steps and are not written again."""
    parts, touched = [], None
    while True:
        edges = checkpointed(layout.pairs(moving, condition).select("page_id", "a_box_id", "b_box_id"))
        if not edges.head(1):
            return _union_all([*parts, moving]), touched
        pages = edges.select("page_id").distinct()
        touched = pages if touched is None else touched
        parts.append(moving.join(pages, "page_id", "left_anti"))
        moving = checkpointed(contract(moving.join(pages, "page_id", "left_semi"), edges))


def _until_stable(boxes: DataFrame, glyphs: DataFrame, conditions: list[Column]) -> DataFrame:
    """Steps by each condition in turn, each repeated until it joins nothing, until none of them joins anything. Edges are
    derived anew from the boxes that the last step made. Another turn is for the pages alone where a condition behind the first
    joined something: elsewhere every condition has joined nothing since the last step."""
    moving, done = checkpointed(boxes.withColumn("n_boxes", F.lit(1).cast("long")).join(glyphs, "page_id")), []
    while True:
        again: list[DataFrame] = []
        for i, condition in enumerate(conditions):
            moving, touched = _settled(moving, condition)
            if touched is not None and i > 0:
                again.append(touched)
            if touched is not None and i + 1 < len(conditions):
                moving = checkpointed(moving)
        if not again:
            return _union_all([*done, moving]).drop("glyph")
        pages = checkpointed(_union_all(again).distinct())
        done.append(moving.join(pages, "page_id", "left_anti"))
        moving = checkpointed(moving.join(pages, "page_id", "left_semi"))


def merge_close(boxes: DataFrame, gap: int | None = None) -> DataFrame:
    """Stacked boxes that are too close become one, until none are. page_id, box_id (the smallest), corners, area, n_boxes.

    A step joins connected groups, so no order of boxes bears on the result."""
    glyphs = boxes.select("page_id").distinct().withColumn("glyph", F.lit(0.0))
    return _until_stable(_typed(boxes), glyphs, [close(gap)])


def merge_rows(boxes: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Pieces of one row become one box, until none are left; glyphs: page_id, glyph."""
    return _until_stable(_typed(boxes), glyphs, [one_row()])


def merge_boxes(boxes: DataFrame, glyphs: DataFrame, gap: int | None = None) -> DataFrame:
    """Close boxes and pieces of rows in turn, until neither joins anything."""
    return _until_stable(_typed(boxes), glyphs, [close(gap), one_row()])


# ---------------------------------------------------------------- tables that take what is in reach


def _shared() -> Column:
    """Area of box b in table t."""
    side = lambda a, b: F.greatest(F.lit(0), G.overlap(F.col(f"t_{a}"), F.col(f"t_{b}"), F.col(a), F.col(b)))
    return side("x0", "x1") * side("y0", "y1")


def _of_size() -> Column:
    return (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))


def inside_table() -> Column:
    """Whether a box's centre lies within the rules (a header may stand a little above them), or most of its area does."""
    g, cx, cy = F.col("glyph"), (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    centre = cx.between(F.col("t_x0") - 0.3 * g, F.col("t_x1") + 0.3 * g) & cy.between(F.col("t_y0") - 0.8 * g, F.col("t_y1") + 0.3 * g)
    return centre | (_shared() >= 0.6 * _of_size())


def in_reach() -> Column:
    """Whether a table grows over a box: most of it lies inside, or it stands in the table's rows and either starts inside or
    is small and not far beyond a side."""
    g, cy = F.col("glyph"), (F.col("y0") + F.col("y1")) / 2
    row = cy.between(F.col("t_y0"), F.col("t_y1")) & (F.col("y1") - F.col("y0") <= 2 * g)
    starts = (F.col("t_x0") <= F.col("x0")) & (F.col("x0") < F.col("t_x1"))
    gap = F.greatest(F.col("x0") - F.col("t_x1"), F.col("t_x0") - F.col("x1"))
    return (_shared() >= 0.6 * _of_size()) | row & (starts | (F.col("x1") - F.col("x0") <= 3 * g) & (gap <= 2.5 * g))


def _taken(free: DataFrame, tables: DataFrame, condition: Column) -> DataFrame:
    """(page_id, box_id, table_id): the free boxes that a table takes; of several tables the one with the smallest id."""
    t = tables.select("page_id", "table_id", *[F.col(c).alias(f"t_{c}") for c in CORNERS])
    return free.join(t, "page_id").where(condition).groupBy("page_id", "box_id").agg(F.min("table_id").alias("table_id"))


def _grown(tables: DataFrame, free: DataFrame, taken: DataFrame) -> DataFrame:
    """The tables that took something, with the boxes that cover what they took."""
    new = free.join(taken, ["page_id", "box_id"]).select("page_id", "table_id", *CORNERS, "area")
    took = taken.select("page_id", "table_id").distinct()
    return layout.union_boxes(tables.join(took, ["page_id", "table_id"], "left_semi").select("page_id", "table_id", *CORNERS, "area").unionByName(new), "page_id", "table_id")


def table_writing(boxes: DataFrame, tables: DataFrame, glyphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables, owners): the tables with the boxes that cover their writing, and (page_id, box_id, table_id) of every box, null
    for text. tables: page_id, table_id, corners, area.

    Writing between the rules is taken first, then what is in reach of a table, round by round: what a table takes lets it
    reach further. A round asks the tables that grew in the last one alone, since what was out of reach of a table is in
    reach of it only after it has grown; so the rounds are as many as the longest chain of boxes."""
    b = _typed(boxes).join(glyphs, "page_id")
    now = checkpointed(tables.select("page_id", F.col("table_id").cast("int").alias("table_id"), *[F.col(c).cast("int").alias(c) for c in CORNERS], F.col("area").cast("long").alias("area")))
    free = checkpointed(b.join(now.select("page_id").distinct(), "page_id", "left_semi"))
    same = ["page_id", "table_id"]

    def round_of(free: DataFrame, now: DataFrame, asked: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(taken, free, tables, those of them that grew) after one round."""
        taken = checkpointed(_taken(free, asked, condition))
        grown = checkpointed(_grown(now, free, taken))
        return taken, checkpointed(free.join(taken, ["page_id", "box_id"], "left_anti")), checkpointed(now.join(grown, same, "left_anti").unionByName(grown)), grown

    found, free, now, _ = round_of(free, now, now, inside_table())
    asked = now
    while True:
        taken, free, now, asked = round_of(free, now, asked, in_reach())
        if not taken.head(1):
            return now, b.select("page_id", "box_id").join(found, ["page_id", "box_id"], "left")
        found = checkpointed(found.unionByName(taken))


# ---------------------------------------------------------------- ordered folds over a page's boxes


def _union(a: Column, b: Column) -> Column:
    return F.struct(a["box_id"].alias("box_id"), F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"), (a["area"] + b["area"]).alias("area"))


def _box() -> Column:
    return F.struct("box_id", *CORNERS, "area")


def _listed(boxes: DataFrame, name: str, *order: str) -> DataFrame:
    """(page_id, name): a page's boxes as an array in an order."""
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], _box().alias("b"))))
    return boxes.groupBy("page_id").agg(F.transform(rows, lambda r: r["b"]).alias(name))


def _replaced(boxes: Column, at: Column, new: Callable[[Column], Column]) -> Column:
    return F.transform(boxes, lambda x, i: F.when(i == at, new(x)).otherwise(x))


def _unlisted(pages: DataFrame, name: str) -> DataFrame:
    return pages.select("page_id", F.explode(name).alias("b")).select("page_id", "b.*")


def join_bar_pieces(boxes: DataFrame, glyphs: DataFrame) -> DataFrame:
    """The boxes with pieces of one fraction bar joined, under the id of the leftmost piece.

    A greedy fold from left to right: a piece joins the first bar so far that ends at most half a glyph before it, at nearly its
    height, if the two together are a bar; otherwise it begins one."""
    b = layout.sized(_typed(boxes)).join(glyphs, "page_id")
    flat = G.is_bar(F.col("w"), F.col("h"), F.col("glyph")) | (F.col("h") <= 0.3 * F.col("glyph")) & (F.col("w") >= 0.5 * F.col("glyph"))
    pages = _listed(b.where(flat), "bars", "x0", "box_id").join(glyphs, "page_id")
    g = F.col("glyph")

    def fits(a: Column, piece: Column) -> Column:
        both = _union(a, piece)
        level = F.abs((a["y0"] + a["y1"]) - (piece["y0"] + piece["y1"])) / 2 <= F.greatest(F.lit(2.0), 0.1 * g)
        return (piece["x0"] - a["x1"] <= 0.5 * g) & level & G.is_bar(both["x1"] - both["x0"], both["y1"] - both["y0"], g)

    def step(joined: Column, piece: Column) -> Column:
        first = F.array_position(F.transform(joined, lambda a: fits(a, piece)), F.lit(True))
        return let(first, lambda at: F.when(at > 0, _replaced(joined, at - 1, lambda a: _union(a, piece))).otherwise(F.concat(joined, F.array(piece))))

    bars = pages.select("page_id", F.aggregate("bars", F.array().cast(f"array<{BOX}>"), step).alias("bars"))
    return b.where(~flat).select("page_id", "box_id", *CORNERS, "area").unionByName(_unlisted(bars, "bars"))


def attach_fragments(lines: DataFrame, fragments: DataFrame, glyphs: DataFrame) -> DataFrame:
    """The lines, grown by the fragments nearest to them: each fragment, in the order of ids, goes to the nearest line less than
    a glyph above or below it that shares columns with it (three glyphs more on either side); of equally near ones to the
    first. A line that has grown is nearer to the fragments that follow. Fragments without such a line go."""
    pages = _listed(_typed(lines), "lines", "box_id").join(glyphs, "page_id").join(_listed(_typed(fragments), "pieces", "box_id"), "page_id", "left")
    g = F.col("glyph")

    def step(now: Column, f: Column) -> Column:
        def away(line: Column, i: Column) -> Column:
            d = F.greatest(F.lit(0), line["y0"] - f["y1"], f["y0"] - line["y1"])
            fits = (G.overlap(line["x0"], line["x1"], f["x0"] - 3 * g, f["x1"] + 3 * g) > 0) & (d < g)
            return F.when(fits, F.struct(d.alias("d"), i.alias("i")))

        best = F.array_min(F.filter(F.transform(now, away), lambda x: x.isNotNull()))
        return let(best, lambda at: F.when(at.isNull(), now).otherwise(_replaced(now, at["i"], lambda x: _union(x, f))))

    none = F.array().cast(f"array<{BOX}>")
    return _unlisted(pages.select("page_id", F.aggregate(F.coalesce("pieces", none), F.col("lines"), step).alias("lines")), "lines")


def _covered(f: Column, marks: Column) -> Column:
    """Share of a box's columns that the marks with their centre inside it cover."""
    inside = F.filter(marks, lambda m: ((m["x0"] + m["x1"]) / 2).between(f["x0"], f["x1"]) & ((m["y0"] + m["y1"]) / 2).between(f["y0"], f["y1"]))
    columns = F.when(f["x1"] > f["x0"], F.sequence(f["x0"], f["x1"] - 1)).otherwise(F.array().cast("array<int>"))
    hit = let(inside, lambda own: F.size(F.filter(columns, lambda c: F.exists(own, lambda m: (c >= m["x0"]) & (c < m["x1"])))))
    return hit / F.greatest(F.lit(1), f["x1"] - f["x0"])


def absorb_fragments(lines: DataFrame, marks: DataFrame, glyphs: DataFrame) -> DataFrame:
    """The lines, after rows of loose marks (limits, exponents) have joined the line they touch.

    A fragment is low, has little ink, is much narrower than its line, starts inside it and touches it, or comes within half a
    glyph if its marks cover little of its width; the line on its other side keeps its distance. The narrowest fragment that
    can join does so (of equally narrow ones the first, lines in the order of ids and joined ones last), into the nearest line
    (of equally near ones the last); then all are looked at again. A page's lines bound the steps."""
    pages = _listed(_typed(lines), "lines", "box_id").join(glyphs, "page_id").join(_listed(_typed(marks), "marks", "box_id"), "page_id", "left")
    g, marks_of = F.col("glyph"), F.coalesce("marks", F.array().cast(f"array<{BOX}>"))
    gap = lambda a, b: F.greatest(a["y0"] - b["y1"], b["y0"] - a["y1"])

    def target(now: Column, f: Column, i: Column) -> Column:
        """(w, i, j): the fragment's width and place, and the place of the line that it joins; null if it joins none."""

        def within(reach: Column) -> Column:
            def fits(line: Column, j: Column) -> Column:
                narrow = (j != i) & (f["x1"] - f["x0"] <= 0.6 * (line["x1"] - line["x0"])) & (f["x0"] >= line["x0"] - g) & (f["x1"] <= line["x1"] + g) & (f["x0"] > line["x0"] + g)
                return F.when(narrow & (gap(line, f) <= reach), F.struct(gap(line, f).alias("d"), (-j).alias("last")))

            return F.array_min(F.filter(F.transform(now, fits), lambda x: x.isNotNull()))

        def judged(best: Column) -> Column:
            j = -best["last"]

            def keeps_away(line: Column) -> Column:
                below = line["y0"] >= (f["y0"] + f["y1"]) / 2
                other = lambda x, k: (k != i) & (k != j) & (G.overlap(x["x0"], x["x1"], f["x0"], f["x1"]) > 0) & F.when(below, x["y1"] <= line["y0"]).otherwise(x["y0"] >= line["y1"]) & (gap(x, f) < 0.5 * g)
                return F.size(F.filter(now, other)) == 0

            return F.when(best.isNotNull() & let(F.get(now, j), keeps_away), F.struct((f["x1"] - f["x0"]).alias("w"), i.alias("i"), j.alias("j")))

        low = (f["y1"] - f["y0"] <= 1.6 * g) & (f["area"] <= 1.5 * g * g)
        reach = F.when(_covered(f, marks_of) <= 0.4, 0.5 * g).otherwise(F.lit(0.0))
        return F.when(low, let(let(reach, within), judged))

    def step(state: Column, _: Column) -> Column:
        now = state["lines"]
        first = F.array_min(F.filter(F.transform(now, lambda f, i: target(now, f, i)), lambda x: x.isNotNull()))

        def joined(at: Column) -> Column:
            rest = F.filter(now, lambda x, k: (k != at["i"]) & (k != at["j"]))
            return F.struct(F.concat(rest, F.array(_union(F.get(now, at["j"]), F.get(now, at["i"])))).alias("lines"), F.lit(False).alias("done"))

        return F.when(state["done"], state).otherwise(let(first, lambda at: F.when(at.isNull(), F.struct(now.alias("lines"), F.lit(True).alias("done"))).otherwise(joined(at))))

    start = F.struct(F.col("lines").alias("lines"), F.lit(False).alias("done"))
    folded = F.aggregate(F.sequence(F.lit(1), F.size("lines")), start, step, lambda s: s["lines"])
    return _unlisted(pages.select("page_id", folded.alias("lines")), "lines")
