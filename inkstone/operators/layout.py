"""Page layout as joins, windows and folds over boxes(page_id, box_id, x0, y0, x1, y1, area).

Joins carry the page as an equality, so Spark hashes by page and the geometric condition is a residual filter. A page
holds at most some hundred boxes; pairs within a page are bounded by that, not by the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.latex import let
from .components import checkpointed, connected_components

BOX = ("box_id", "x0", "y0", "x1", "y1", "area")


def sized(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({"w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0")})


def glyph_heights(boxes: DataFrame, least_h: int = 8, least_area: int = 20) -> DataFrame:
    """Median height of a page's marks, dust left out."""
    return sized(boxes).where((F.col("h") >= least_h) & (F.col("area") >= least_area)).groupBy("page_id").agg(F.median("h").alias("glyph"))


def with_glyph(boxes: DataFrame) -> DataFrame:
    return sized(boxes).join(glyph_heights(boxes), "page_id")


def drop_dust(boxes: DataFrame, strength: float = 0.5) -> DataFrame:
    """Marks too small for the page's glyph go, unless they are wide."""
    least = F.greatest(F.lit(6.0), F.pow(F.floor((0.15 + 0.2 * strength) * F.col("glyph")), 2))
    return with_glyph(boxes).where((F.col("area") >= least) | (F.col("w") >= 0.5 * F.col("glyph")))


def pairs(boxes: DataFrame, condition: Column | None = None) -> DataFrame:
    """Pairs (a, b) of a page's boxes with a.box_id < b.box_id, as prefixed columns."""
    a = boxes.select("page_id", *[F.col(c).alias(f"a_{c}") for c in boxes.columns if c != "page_id"])
    b = boxes.select("page_id", *[F.col(c).alias(f"b_{c}") for c in boxes.columns if c != "page_id"])
    both = a.join(b, (a["page_id"] == b["page_id"]) & (a["a_box_id"] < b["b_box_id"])).drop(b["page_id"])
    return both if condition is None else both.where(condition)


def _c(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def overlap_x() -> Column:
    return G.overlap(*_c("a_x0", "a_x1", "b_x0", "b_x1"))


def overlap_y() -> Column:
    return G.overlap(*_c("a_y0", "a_y1", "b_y0", "b_y1"))


def overlapping(boxes: DataFrame) -> DataFrame:
    return pairs(boxes, (overlap_x() > 0) & (overlap_y() > 0)).select("page_id", "a_box_id", "b_box_id", overlap_x().alias("overlap_x"), overlap_y().alias("overlap_y"))


def same_row_edges(boxes: DataFrame, share: float = 0.4) -> DataFrame:
    """Core marks that stand in one row: enough vertical overlap, and the shorter one's centre within the taller."""
    core = with_glyph(boxes).where((F.col("h") >= 0.5 * F.col("glyph")) & ~G.is_bar(F.col("w"), F.col("h"), F.col("glyph")) & (F.col("h") <= 1.8 * F.col("glyph")))
    a_mid, b_mid = (F.col("a_y0") + F.col("a_y1")) / 2, (F.col("b_y0") + F.col("b_y1")) / 2
    inside = F.when(F.col("a_h") <= F.col("b_h"), (a_mid >= F.col("b_y0")) & (a_mid <= F.col("b_y1"))).otherwise((b_mid >= F.col("a_y0")) & (b_mid <= F.col("a_y1")))
    return pairs(core, (overlap_y() >= share * F.least("a_h", "b_h")) & inside).select("page_id", "a_box_id", "b_box_id")


#: Edges of a page up to which its components are found in one fold; pages with more of them contract stars.
MOST_EDGES = 2000


def firsts(edges: Column, kind: str) -> Column:
    """A map from each number with an edge to the smallest one of its component, by a fold over an array of edges (a, b)."""
    none = F.array().cast(f"array<array<{kind}>>")

    def step(groups: Column, e: Column) -> Column:
        meets = lambda g: F.array_contains(g, e["a"]) | F.array_contains(g, e["b"])
        joined = F.array_distinct(F.concat(F.array(e["a"], e["b"]), F.flatten(F.filter(groups, meets))))
        return F.concat(F.filter(groups, lambda g: ~meets(g)), F.array(joined))

    first = lambda g: let(F.array_min(g), lambda first: F.transform(g, lambda x: F.struct(x.alias("box"), first.alias("first"))))
    return F.map_from_entries(F.flatten(F.transform(F.aggregate(edges, none, step), first)))


def _components_of_pages(edges: DataFrame, kind: str) -> DataFrame:
    """(page_id, firsts): the components of each page's edges."""
    return edges.groupBy("page_id").agg(F.collect_set(F.struct("a", "b")).alias("es")).select("page_id", firsts(F.col("es"), kind).alias("firsts"))


def with_rows(boxes: DataFrame, edges: DataFrame) -> DataFrame:
    """boxes with row_id, the smallest box of their connected component in an edge relation; a box without edges is its own row.

    Edges are within a page, so a page is done by itself: its edges travel once. A page with very many edges is no list for one
    task; those pages contract stars, with boxes as nodes by page and number together, so numbers may be of any size."""
    kind = boxes.schema["box_id"].dataType.simpleString()
    known = edges.select("page_id", F.col("a_box_id").cast(kind).alias("a"), F.col("b_box_id").cast(kind).alias("b")).where("a is not null and b is not null")
    known = checkpointed(known)
    large = known.groupBy("page_id").agg(F.count("*").alias("n")).where(F.col("n") > MOST_EDGES).select("page_id")
    some = bool(large.head(1))
    small = known.join(large, "page_id", "left_anti") if some else known
    own = F.coalesce(F.try_element_at("firsts", F.col("box_id")), F.col("box_id"))
    out = boxes.join(_components_of_pages(small, kind), "page_id", "left").withColumn("row_id", own).drop("firsts")
    if not some:
        return out
    node = lambda c: F.struct("page_id", F.col(c).alias("box_id"))
    parts = connected_components(known.join(large, "page_id", "left_semi").select(node("a").alias("src"), node("b").alias("dst")))
    found = parts.select("node.page_id", "node.box_id", F.col("component.box_id").alias("first"))
    return out.join(found, ["page_id", "box_id"], "left").withColumn("row_id", F.coalesce("first", "row_id")).drop("first")


def rows_of(boxes: DataFrame, edges: DataFrame) -> DataFrame:
    """(page_id, box_id, row_id) of every box, as `with_rows` gives it."""
    return with_rows(boxes.select("page_id", "box_id"), edges)


def union_boxes(boxes: DataFrame, *by: str) -> DataFrame:
    return boxes.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("area").alias("area"))


def merged_intervals(rows: DataFrame, by: list[str], low: str, high: str) -> DataFrame:
    """Union of intervals: maximal covered stretches (start, stop) for each key, by a running maximum."""
    before = W.partitionBy(*by).orderBy(low, high).rowsBetween(W.unboundedPreceding, -1)
    order = W.partitionBy(*by).orderBy(low, high).rowsBetween(W.unboundedPreceding, 0)
    reach = F.max(high).over(before)
    marked = rows.withColumn("__new", F.when(reach.isNull() | (F.col(low) > reach), 1).otherwise(0)).withColumn("__island", F.sum("__new").over(order))
    return marked.groupBy(*by, "__island").agg(F.min(low).alias("start"), F.max(high).alias("stop")).drop("__island")


def coverage(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """Share of each line's width that marks with their centre in the line cover. lines: page_id, line_id, x0..y1."""
    m = marks.select("page_id", *[F.col(c).alias(f"m_{c}") for c in ("x0", "y0", "x1", "y1")])
    cx, cy = (F.col("m_x0") + F.col("m_x1")) / 2, (F.col("m_y0") + F.col("m_y1")) / 2
    inside = lines.join(m, "page_id").where((cx >= F.col("x0")) & (cx <= F.col("x1")) & (cy >= F.col("y0")) & (cy <= F.col("y1")))
    clipped = inside.select("page_id", "line_id", F.greatest("m_x0", "x0").alias("a"), F.least("m_x1", "x1").alias("b"))
    covered = merged_intervals(clipped, ["page_id", "line_id"], "a", "b").groupBy("page_id", "line_id").agg(F.sum(F.col("stop") - F.col("start")).alias("covered"))
    return lines.join(covered, ["page_id", "line_id"], "left").select("page_id", "line_id", (F.coalesce("covered", F.lit(0)) / F.greatest(F.lit(1), F.col("x1") - F.col("x0"))).alias("share"))


def runs(rows: DataFrame, by: str, at: str) -> DataFrame:
    """Runs of consecutive integers: start and stop (exclusive) of each."""
    island = F.col(at) - F.row_number().over(W.partitionBy(by).orderBy(at))
    return rows.select(by, at).distinct().withColumn("__island", island).groupBy(by, "__island").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("stop")).drop("__island")


def gutters(boxes: DataFrame, least_gap: int, least_side: int) -> DataFrame:
    """The widest empty vertical band of each page with room on both sides; the leftmost of equal ones."""
    page = boxes.groupBy("page_id").agg(F.min("x0").alias("left"), F.max("x1").alias("right"))
    islands = merged_intervals(boxes, ["page_id"], "x0", "x1")
    gaps = islands.withColumn("gap_end", F.lead("start").over(W.partitionBy("page_id").orderBy("start"))).where("gap_end is not null")
    fit = gaps.join(page, "page_id").where((F.col("gap_end") - F.col("stop") >= least_gap) & (F.col("stop") - F.col("left") >= least_side) & (F.col("right") - F.col("gap_end") >= least_side))
    ranked = fit.withColumn("__n", F.row_number().over(W.partitionBy("page_id").orderBy((F.col("gap_end") - F.col("stop")).desc(), "stop")))
    return ranked.where("__n = 1").select("page_id", F.col("stop").alias("gap_start"), "gap_end")


def aligned(left: DataFrame, right: DataFrame, share: float = 0.5) -> DataFrame:
    """Pages whose two columns have as many rows, pairwise overlapping by more than a share of the lower one."""

    def ranked(df: DataFrame, p: str) -> DataFrame:
        w = W.partitionBy("page_id")
        return df.select("page_id", F.row_number().over(w.orderBy("y0", "box_id")).alias("rank"), F.count("*").over(w).alias(f"{p}_n"), F.col("y0").alias(f"{p}_y0"), F.col("y1").alias(f"{p}_y1"))

    both = ranked(left, "a").join(ranked(right, "b"), ["page_id", "rank"])
    good = overlap_y() > share * F.least(F.col("a_y1") - F.col("a_y0"), F.col("b_y1") - F.col("b_y0"))
    return both.groupBy("page_id").agg((F.bool_and(good) & (F.max("a_n") == F.max("b_n")) & (F.count("*") == F.max("a_n"))).alias("aligned"))


def bar_neighbours(boxes: DataFrame) -> DataFrame:
    """For each fraction bar and side, the marks within 0.3 glyph of the nearest one; only bars with both sides bind."""
    g = with_glyph(boxes)
    bars = g.where(G.is_bar(F.col("w"), F.col("h"), F.col("glyph"))).select("page_id", "glyph", *[F.col(c).alias(f"bar_{c}") for c in ("box_id", "x0", "y0", "x1", "y1")])
    near = bars.join(boxes, "page_id").where((F.col("box_id") != F.col("bar_box_id")) & (F.col("x0") >= F.col("bar_x0") - 0.25 * F.col("glyph")) & (F.col("x1") <= F.col("bar_x1") + 0.25 * F.col("glyph")))
    above, below = F.col("bar_y0") - F.col("y1"), F.col("y0") - F.col("bar_y1")
    side = F.when((above >= -3) & (above <= 0.9 * F.col("glyph")), "above").when((below >= -3) & (below <= 0.9 * F.col("glyph")), "below")
    sided = near.withColumn("side", side).where("side is not null").withColumn("gap", F.when(F.col("side") == "above", above).otherwise(below))
    w = W.partitionBy("page_id", "bar_box_id")
    kept = sided.withColumn("best", F.min("gap").over(w.partitionBy("page_id", "bar_box_id", "side"))).withColumn("sides", F.size(F.collect_set("side").over(w)))
    return kept.where((F.col("sides") == 2) & (F.col("gap") <= F.col("best") + 0.3 * F.col("glyph"))).select("page_id", "bar_box_id", "side", "box_id")


def nearest(labels: DataFrame, figures: DataFrame) -> DataFrame:
    """Each label's nearest figure of the page by the L1 distance of centres; ties go to the smaller id."""
    f = figures.select("page_id", F.col("box_id").alias("figure_id"), ((F.col("x0") + F.col("x1")) / 2).alias("fx"), ((F.col("y0") + F.col("y1")) / 2).alias("fy"))
    both = labels.join(f, "page_id").where("figure_id <> box_id")
    distance = F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("fx")) + F.abs((F.col("y0") + F.col("y1")) / 2 - F.col("fy"))
    best = both.withColumn("distance", distance).groupBy("page_id", "box_id").agg(F.min(F.struct("distance", "figure_id")).alias("m"))
    return best.select("page_id", "box_id", "m.figure_id", "m.distance")


def rule_crossings(rules: DataFrame, margin: int) -> DataFrame:
    """Crossings of a page's horizontal and vertical rules, at least `margin` inside both."""
    h = rules.where("dir = 'h'").select("page_id", F.col("rule_id").alias("h_id"), F.col("x0").alias("hx0"), F.col("x1").alias("hx1"), F.col("y0").alias("hy"))
    v = rules.where("dir = 'v'").select("page_id", F.col("rule_id").alias("v_id"), F.col("y0").alias("vy0"), F.col("y1").alias("vy1"), F.col("x0").alias("vx"))
    inside = (F.col("vx") >= F.col("hx0") + margin) & (F.col("vx") <= F.col("hx1") - margin) & (F.col("hy") >= F.col("vy0") + margin) & (F.col("hy") <= F.col("vy1") - margin)
    return h.join(v, "page_id").where(inside).select("page_id", "h_id", "v_id")


def tables_of(rules: DataFrame, margin: int) -> DataFrame:
    """Boxes of the groups of rules that cross one another."""
    cross = checkpointed(rule_crossings(rules, margin).select("page_id", F.col("h_id").alias("a_box_id"), F.col("v_id").alias("b_box_id")))
    ends = cross.groupBy("page_id").agg(F.collect_set("a_box_id").alias("hs"), F.collect_set("b_box_id").alias("vs"))
    hit = ends.select("page_id", F.array_union("hs", "vs").alias("hit"))
    members = with_rows(rules.withColumnRenamed("rule_id", "box_id"), cross).join(hit, "page_id").where(F.array_contains("hit", F.col("box_id")))
    return members.groupBy("page_id", F.col("row_id").alias("table_id")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n_rules"))


def reading_order(boxes: DataFrame) -> DataFrame:
    """Rows top to bottom, boxes left to right. A box joins the current row if it overlaps the row's first box by more
    than half of the lower one: an ordered fold that carries this box, since a window's neighbour would be the wrong one."""
    ordered = F.array_sort(F.collect_list(F.struct("y0", "box_id", "y1", "x0")))
    start = F.struct(F.lit(-1).alias("r"), F.lit(0).alias("y0"), F.lit(0).alias("y1"), F.array().cast("array<struct<r:int,x0:int,box_id:int>>").alias("out"))

    def step(a: Column, b: Column) -> Column:
        joins = (a["r"] >= 0) & (G.overlap(a["y0"], a["y1"], b["y0"], b["y1"]) > 0.5 * F.least(a["y1"] - a["y0"], b["y1"] - b["y0"]))
        r = F.when(joins, a["r"]).otherwise(a["r"] + 1).cast("int")
        return F.struct(r.alias("r"), F.when(joins, a["y0"]).otherwise(b["y0"]).alias("y0"), F.when(joins, a["y1"]).otherwise(b["y1"]).alias("y1"), F.concat(a["out"], F.array(F.struct(r.alias("r"), b["x0"].alias("x0"), b["box_id"].alias("box_id")))).alias("out"))

    folded = boxes.groupBy("page_id").agg(ordered.alias("bs")).select("page_id", F.array_sort(F.aggregate("bs", start, step, lambda a: a["out"])).alias("out"))
    return folded.select("page_id", F.posexplode("out").alias("position", "b")).select("page_id", F.col("b.box_id").alias("box_id"), F.col("b.r").alias("row"), "position")


def padded(boxes: DataFrame, pad: int, width: int, height: int) -> DataFrame:
    """Boxes grown by `pad`, within the page and, above and below, up to half the gap to the next box in their column."""
    b = boxes.select("page_id", *[F.col(c).alias(f"o_{c}") for c in ("box_id", "x0", "y0", "x1", "y1")])
    both = boxes.join(b, "page_id", "left").where((F.col("o_box_id") == F.col("box_id")) | (G.overlap(*_c("x0", "x1", "o_x0", "o_x1")) > 0))
    other = F.col("o_box_id") != F.col("box_id")
    up = F.max(F.when(other & (F.col("o_y1") <= F.col("y0")), F.col("o_y1")))
    down = F.min(F.when(other & (F.col("o_y0") >= F.col("y1")), F.col("o_y0")))
    agg = both.groupBy("page_id", "box_id", "x0", "y0", "x1", "y1").agg(up.alias("up"), down.alias("down"))
    top = F.greatest(F.lit(0), F.col("y0") - pad, F.floor((F.col("up") + F.col("y0")) / 2))
    bottom = F.least(F.lit(height), F.col("y1") + pad, F.floor((F.col("y1") + F.col("down")) / 2))
    return agg.select("page_id", "box_id", F.greatest(F.lit(0), F.col("x0") - pad).cast("int").alias("x0"), top.cast("int").alias("y0"), F.least(F.lit(width), F.col("x1") + pad).cast("int").alias("x1"), bottom.cast("int").alias("y1"))


def match_lines(lines: DataFrame, regions: DataFrame, least_share: float = 0.3) -> DataFrame:
    """Each line's region: the first that holds its centre, else the one that holds most of it (if enough).
    lines: page_id, line_id, x, y, w, h; regions: page_id, region_id, bbox."""
    cols = _c("x", "y", "w", "h")
    both = lines.join(regions, "page_id").select("page_id", "line_id", "region_id", G.center_inside(*cols, F.col("bbox")).alias("inside"), G.overlap_share(*cols, F.col("bbox")).alias("share"))
    order = F.when(F.col("inside"), F.struct(F.lit(0).alias("o"), F.lit(0.0).alias("s"), F.col("region_id"))).when(F.col("share") >= least_share, F.struct(F.lit(1).alias("o"), (-F.col("share")).alias("s"), F.col("region_id")))
    best = both.withColumn("k", order).where("k is not null").groupBy("page_id", "line_id").agg(F.min("k").alias("k"))
    return best.select("page_id", "line_id", "k.region_id", (F.col("k.o") == 0).alias("by_centre"))


def lines_of_regions(lines: DataFrame, regions: DataFrame, least_share: float = 0.3) -> DataFrame:
    """(page_id, region_id, line_ids): every region with its lines in order, an empty list for a region without any."""
    held = match_lines(lines, regions, least_share).groupBy("page_id", "region_id").agg(F.array_sort(F.collect_list("line_id")).alias("line_ids"))
    none = F.array().cast(held.schema["line_ids"].dataType)
    return regions.select("page_id", "region_id").join(held, ["page_id", "region_id"], "left").withColumn("line_ids", F.coalesce("line_ids", none))
