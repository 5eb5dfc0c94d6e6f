"""Tables and diagrams from strokes: pieces of rules that go on in each other, groups of rules that touch, strokes that meet.

rules(page_id, rule_id, dir, x0, y0, x1, y1): dir is h, left to right, or v, top to bottom; a rule may tilt, so its height is
read where it matters. regions(page_id, region_id, w, h, glyph) are parts of pages with strokes(page_id, region_id, stroke_id,
x0, y0, x1, y1) and marks(page_id, region_id, x0, y0, x1, y1, area). glyphs(page_id, glyph); sizes(page_id, width, height).

Pairs of rules, and of strokes, are within a page or region and carry it as an equality. A page without a glyph or size has
no tables; a null corner makes a rule or stroke meet nothing; a repeated row bears on counts of marks alone.

The rules of a page are gathered into arrays and folded there, pieces and tables alike: rules travel once, by page, and nothing
is written between. A page with very many rules is no array for one task: those pages take rounds of joins over checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.latex import let
from . import layout
from .components import checkpointed

REGION = ["page_id", "region_id"]
ENDS = ("x0", "y0", "x1", "y1")

#: A rule or stroke: its columns by name, be they prefixed columns of a join or fields of a struct.
At = Callable[[str], Column]

#: Rules of a page up to which they are folded as arrays; pages with more of them take rounds.
MOST_RULES = 200


def _prefixed(df: DataFrame, p: str, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys])


def _along(at: Column, a0: Column, b0: Column, a1: Column, b1: Column) -> Column:
    """Where a stroke from (a0, b0) to (a1, b1) stands on the b axis at `at` of the a axis; an end's place beyond that end."""
    share = F.when(a1 == a0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (at - a0) / F.nullif(a1 - a0, F.lit(0)))))
    return b0 + share * (b1 - b0)


def _near(a0: Column, a1: Column, b0: Column, b1: Column, k: Column) -> Column:
    """Whether stretches with these ends are at most k apart, or little more: a cheap test before an exact one that is stricter."""
    return (F.greatest(a0, a1) - F.least(b0, b1) >= -k - 1) & (F.greatest(b0, b1) - F.least(a0, a1) >= -k - 1)


def _side(p: str) -> At:
    return lambda c: F.col(f"{p}_{c}")


def height_at(r: At, x: Column) -> Column:
    return _along(x, r("x0"), r("y0"), r("x1"), r("y1"))


def place_at(r: At, y: Column) -> Column:
    return _along(y, r("y0"), r("x0"), r("y1"), r("x1"))


def _level(r: At = F.col, tilt: float = 0.18) -> tuple[Column, Column, Column, Column]:
    """(dx, dy, nearly level, nearly upright) of a stroke."""
    dx, dy = F.abs(r("x1") - r("x0")), F.abs(r("y1") - r("y0"))
    return dx, dy, dy <= tilt * dx, dx <= tilt * dy


def _large_pages(rules: DataFrame) -> DataFrame | None:
    """The pages with very many rules, None without any."""
    large = rules.groupBy("page_id").agg(F.count("*").alias("n")).where(F.col("n") > MOST_RULES).select("page_id")
    return checkpointed(large) if large.head(1) else None


def _pairs_of(a: Column, b: Column, condition: Callable[[At, At], Column]) -> Column:
    """The pairs (a, b) of numbers of rules from two arrays of which the condition holds."""
    edge = lambda x, y: F.struct(x["rule_id"].alias("a"), y["rule_id"].alias("b"))
    return F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: condition(x.getField, y.getField)), lambda y: edge(x, y))))


# ---------------------------------------------------------------- pieces of rules


def goes_on(a: At, b: At, glyph: Column, reach: float = 3.0, off: float = 0.5) -> Column:
    """Whether the horizontal piece b goes on where a ends: at most `reach` glyphs apart, at heights at most `off` glyphs apart
    where they meet, or midway where they run side by side. The left one of two pieces is a; a piece without a number meets none."""
    first = (a("x0") < b("x0")) | ((a("x0") == b("x0")) & (a("rule_id") < b("rule_id")))
    gap, shared = b("x0") - a("x1"), (b("x0") + F.least(a("x1"), b("x1"))) / 2
    beside = _near(a("y0"), a("y1"), b("y0"), b("y1"), off * glyph) & (F.abs(height_at(a, shared) - height_at(b, shared)) <= off * glyph)
    meet = F.when(gap < 0, beside).otherwise(F.abs(a("y1") - b("y0")) <= off * glyph)
    return first & (gap <= reach * glyph) & meet & a("rule_id").isNotNull() & b("rule_id").isNotNull()


def continuations(rules: DataFrame, reach: float = 3.0, off: float = 0.5) -> DataFrame:
    """Pairs of horizontal pieces (rules with glyph) of which the right one goes on where the left one ends."""
    both = _prefixed(rules, "a", "page_id").join(_prefixed(rules, "b", "page_id"), "page_id")
    return both.where(goes_on(_side("a"), _side("b"), F.col("a_glyph"), reach, off)).select("page_id", F.col("a_rule_id").alias("a_box_id"), F.col("b_rule_id").alias("b_box_id"))


def _piece(number: Column, left: Column, right: Column, n: Column) -> Column:
    return F.struct(number.alias("rule_id"), *[end[c].cast("double").alias(c) for end, c in ((left, "x0"), (left, "y0"), (right, "x1"), (right, "y1"))], n.cast("long").alias("n_pieces"))


def _whole_piece() -> Column:
    row = F.struct(*ENDS)
    return _piece(F.col("rule_id"), row, row, F.lit(1))


def _joined(pieces: Column, glyph: Column, kind: str) -> Column:
    """A page's array of pieces after all rounds: each joins connected groups, until none do. A round that joins leaves a piece
    less or is the last, so there are no more rounds than pieces."""

    def union(first: Column, own: Column) -> Column:
        left = F.array_min(F.transform(own, lambda p: F.struct(p["x0"].alias("x0"), p["rule_id"].alias("r"), p["y0"].alias("y0"))))
        right = F.array_max(F.transform(own, lambda p: F.struct(p["x1"].alias("x1"), (-p["rule_id"]).alias("r"), p["y1"].alias("y1"))))
        n = F.aggregate(own, F.lit(0).cast("long"), lambda n, p: n + p["n_pieces"])
        return F.when(F.size(own) == 1, F.get(own, F.lit(0))).otherwise(let(left, lambda left: let(right, lambda right: _piece(first, left, right, n))))

    def contract(now: Column, firsts: Column) -> Column:
        first = lambda p: F.coalesce(F.try_element_at(firsts, p["rule_id"]), p["rule_id"])
        return F.transform(F.array_distinct(F.transform(now, first)), lambda f: let(F.filter(now, lambda p: first(p).eqNullSafe(f)), lambda own: union(f, own)))

    after = lambda done, now: F.struct(F.lit(done).alias("done"), now.alias("now"))

    def step(state: Column, _: Column) -> Column:
        now = state["now"]
        known = _pairs_of(now, now, lambda a, b: goes_on(a, b, glyph))
        moved = lambda es: after(False, let(layout.firsts(es, kind), lambda firsts: contract(now, firsts)))
        return F.when(state["done"] | (F.size(now) < 2), state).otherwise(let(known, lambda es: F.when(F.size(es) == 0, after(True, now)).otherwise(moved(es))))

    start = after(False, pieces)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(pieces))), start, step, lambda state: state["now"])


def join_pieces(pieces: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Horizontal pieces that go on in each other become one rule, from the leftmost end to the rightmost, until none do:
    page_id, rule_id (the smallest), ends, n_pieces.

    A round joins connected groups at once, so no order of pieces bears on the result; a longer rule tilts anew, so pairs are
    derived again from the joined rules."""
    large, kind = _large_pages(pieces), pieces.schema["rule_id"].dataType.simpleString()
    small = pieces if large is None else pieces.join(large, "page_id", "left_anti")
    pages = small.groupBy("page_id").agg(F.collect_list(_whole_piece()).alias("ps")).join(glyphs, "page_id")
    out = pages.select("page_id", F.inline(_joined(F.col("ps"), F.col("glyph"), kind)))
    return out if large is None else out.unionByName(_joined_in_rounds(pieces.join(large, "page_id", "left_semi"), glyphs))


def _joined_in_rounds(pieces: DataFrame, glyphs: DataFrame) -> DataFrame:
    """join_pieces over the whole relation. Pages at rest leave the rounds; each round joins at least two pieces of each other page."""
    rule = pieces.select("page_id", "rule_id", *[F.col(c).cast("double").alias(c) for c in ENDS], F.lit(1).cast("long").alias("n_pieces"))
    moving, rest = checkpointed(rule.join(glyphs, "page_id")), []
    while True:
        edges = checkpointed(continuations(moving))
        pages = edges.select("page_id").distinct()
        rest.append(moving.join(pages, "page_id", "left_anti"))
        if not edges.head(1):
            break
        still = moving.join(pages, "page_id", "left_semi")
        groups = layout.with_rows(still.withColumnRenamed("rule_id", "box_id"), edges).withColumnRenamed("box_id", "rule_id")
        ends = groups.groupBy("page_id", F.col("row_id").alias("rule_id"), "glyph").agg(
            F.min(F.struct("x0", "rule_id", "y0")).alias("left"), F.max(F.struct("x1", (-F.col("rule_id")).alias("r"), "y1")).alias("right"), F.sum("n_pieces").alias("n_pieces")
        )
        moving = checkpointed(ends.select("page_id", "rule_id", "left.x0", "left.y0", "right.x1", "right.y1", "n_pieces", "glyph"))
    out = rest[0]
    for more in rest[1:]:
        out = out.unionByName(more)
    return out.drop("glyph")


# ---------------------------------------------------------------- tables


def _within(h: At, v: At, x: Column, y: Column, k: Column) -> Column:
    return x.between(h("x0") + k, h("x1") - k) & y.between(v("y0") + k, v("y1") - k)


def touching(horiz: DataFrame, vert: DataFrame, margin: float = 0.7) -> DataFrame:
    """(page_id, h_id, v_id, crosses): pairs of a horizontal (with glyph) and a vertical rule that touch within `margin` glyphs;
    crosses: each goes on past the other by as much on both sides."""
    both = _prefixed(horiz, "h", "page_id").join(_prefixed(vert, "v", "page_id"), "page_id")
    both = both.withColumn("y", height_at(_side("h"), (F.col("v_x0") + F.col("v_x1")) / 2)).withColumn("x", place_at(_side("v"), F.col("y")))
    m = margin * F.col("h_glyph")
    within = lambda k: _within(_side("h"), _side("v"), F.col("x"), F.col("y"), k)
    return both.where(within(-m)).select("page_id", F.col("h_rule_id").alias("h_id"), F.col("v_rule_id").alias("v_id"), within(m).alias("crosses"))


def _touching_of(hs: Column, vs: Column, m: Column) -> Column:
    """The pairs (a, b, crosses) of `touching` within a page's arrays of rules."""

    def near(h: Column, v: Column) -> Column:
        return _near(h["y0"], h["y1"], v["y0"], v["y1"], m) & _near(h["x0"], h["x1"], v["x0"], v["x1"], m)

    def pair(h: Column, v: Column) -> Column:
        ha, va = h.getField, v.getField
        found = lambda x, y: F.struct(h["rule_id"].alias("a"), v["rule_id"].alias("b"), _within(ha, va, x, y, m).alias("crosses"), _within(ha, va, x, y, -m).alias("touches"))
        return let(height_at(ha, (v["x0"] + v["x1"]) / 2), lambda y: let(place_at(va, y), lambda x: found(x, y)))

    return F.filter(F.flatten(F.transform(hs, lambda h: F.transform(F.filter(vs, lambda v: near(h, v)), lambda v: pair(h, v)))), lambda p: p["touches"])


def goes_up(a: At, b: At, glyph: Column, margin: float = 0.7) -> Column:
    """Whether a and b are pieces of one vertical rule: at most a glyph apart, at one place midway between them."""
    low, high = F.greatest(a("y0"), b("y0")), F.least(a("y1"), b("y1"))
    y = (low + high) / 2
    return (a("rule_id") < b("rule_id")) & (low - high <= glyph) & (F.abs(place_at(a, y) - place_at(b, y)) <= margin * glyph)


def upright_pieces(vert: DataFrame, margin: float = 0.7) -> DataFrame:
    """Pairs of pieces of one vertical rule (with glyph)."""
    both = _prefixed(vert, "a", "page_id").join(_prefixed(vert, "b", "page_id"), "page_id")
    return both.where(goes_up(_side("a"), _side("b"), F.col("a_glyph"), margin)).select("page_id", F.col("a_rule_id").alias("a_box_id"), F.col("b_rule_id").alias("b_box_id"))


def _plus_least(w: Column, h: Column, glyph: Column) -> tuple[Column, Column]:
    """How wide and how high the strokes of a plus are at least."""
    return F.greatest(F.floor(4 * glyph), F.floor(_share(30, w))), F.greatest(F.floor(1.5 * glyph), F.floor(_share(35, h)))


def plus_signs(regions: DataFrame, strokes: DataFrame, margin: float = 0.7) -> DataFrame:
    """(page_id, region_id): the regions with a plus, a long level stroke and a long upright one that go past each other on both
    sides. The legs of a triangle meet at their ends alone."""
    across, down = _plus_least(*layout._c("w", "h", "glyph"))
    wide = regions.where((F.col("w") > across) & (F.col("h") > down)).select(*REGION, across.alias("across"), down.alias("down"), (margin * F.col("glyph")).alias("m"))
    dx, dy, level, upright = _level()
    long = strokes.join(wide, REGION).withColumns({"level": level & (dx >= F.col("across")), "upright": upright & (dy >= F.col("down"))})
    h = long.where("level").select(*REGION, "m", F.least("x0", "x1").alias("left"), F.greatest("x0", "x1").alias("right"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    v = long.where("upright").select(*REGION, ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.least("y0", "y1").alias("top"), F.greatest("y0", "y1").alias("bottom"))
    inside = F.col("x").between(F.col("left") + F.col("m"), F.col("right") - F.col("m")) & F.col("y").between(F.col("top") + F.col("m"), F.col("bottom") - F.col("m"))
    return h.join(v, REGION).where(inside).select(*REGION).distinct()


def _has_plus(strokes: Column, w: Column, h: Column, glyph: Column, margin: float = 0.7) -> Column:
    """`plus_signs` of one region with an array of strokes."""
    (across, down), m = _plus_least(w, h, glyph), margin * glyph

    def passes(a: Column, b: Column) -> Column:
        x, y = (b["x0"] + b["x1"]) / 2, (a["y0"] + a["y1"]) / 2
        beyond = x.between(F.least(a["x0"], a["x1"]) + m, F.greatest(a["x0"], a["x1"]) - m)
        return beyond & y.between(F.least(b["y0"], b["y1"]) + m, F.greatest(b["y0"], b["y1"]) - m)

    def wide(a: Column) -> Column:
        dx, _, level, _ = _level(a.getField)
        return level & (dx >= across)

    def high(b: Column) -> Column:
        _, dy, _, upright = _level(b.getField)
        return upright & (dy >= down)

    return (w > across) & (h > down) & F.exists(strokes, lambda a: wide(a) & F.exists(strokes, lambda b: high(b) & passes(a, b)))


def _tables_of(hs: Column, vs: Column, glyph: Column, width: Column, kind: str, margin: float = 0.7) -> Column:
    """(table_id, ends, n_rules): the array of a page's tables, from those of its joined horizontal and of its vertical rules."""

    def box(first: Column, own: Column) -> Column:
        low = lambda c: F.floor(F.array_min(F.transform(own, lambda r: F.least(r[f"{c}0"], r[f"{c}1"])))).cast("int")
        high = lambda c: (F.floor(F.array_max(F.transform(own, lambda r: F.greatest(r[f"{c}0"], r[f"{c}1"])))) + 1).cast("int")
        return F.struct(first.alias("table_id"), low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"), F.size(own).cast("long").alias("n_rules"), own.alias("own"))

    def fits(t: Column) -> Column:
        w, h = t["x1"] - t["x0"], t["y1"] - t["y0"]
        rows = F.size(F.filter(t["own"], lambda r: r["is_h"]))
        return (w < 0.9 * width) & (h >= 1.5 * glyph) & ((rows >= 2) | ((rows == 1) & _has_plus(t["own"], w, h, glyph)))

    def grouped(pairs: Column, firsts: Column) -> Column:
        first = lambda number: F.coalesce(F.try_element_at(firsts, number), number)
        rule = lambda r, is_h: F.struct(first(r["rule_id"]).alias("first"), *[r[c].alias(c) for c in ENDS], F.lit(is_h).alias("is_h"))
        rules = F.concat(F.transform(hs, lambda r: rule(r, True)), F.transform(vs, lambda r: rule(r, False)))
        crossed = F.array_distinct(F.transform(F.filter(pairs, lambda p: p["crosses"]), lambda p: first(p["a"])))
        boxes = let(rules, lambda rs: F.transform(crossed, lambda f: let(F.filter(rs, lambda r: r["first"] == f), lambda own: box(f, own))))
        return F.transform(F.filter(boxes, fits), lambda t: F.struct(*[t[c].alias(c) for c in ("table_id", *ENDS, "n_rules")]))

    def edges(pairs: Column) -> Column:
        numbered = F.filter(pairs, lambda p: p["a"].isNotNull() & p["b"].isNotNull())
        touch = F.transform(numbered, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")))
        return F.concat(touch, _pairs_of(vs, vs, lambda a, b: goes_up(a, b, glyph)))

    found = lambda pairs: let(layout.firsts(edges(pairs), kind), lambda firsts: grouped(pairs, firsts))
    return let(_touching_of(hs, vs, margin * glyph), lambda pairs: F.when(F.exists(pairs, lambda p: p["crosses"]), found(pairs)))


def find_tables(rules: DataFrame, glyphs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(page_id, table_id, x0, y0, x1, y1, n_rules): boxes of the groups of rules that touch and of which a pair crosses, with
    two horizontal rules, or one that makes a plus in the group's box; narrower than nine tenths of the page and at least 1.5
    glyphs high. table_id is the smallest rule of the group."""
    large, kind = _large_pages(rules), rules.schema["rule_id"].dataType.simpleString()
    small = rules if large is None else rules.join(large, "page_id", "left_anti")
    _, _, level, upright = _level()
    of = lambda good: F.collect_list(F.when(good, _whole_piece()))
    pages = small.groupBy("page_id").agg(of((F.col("dir") == "h") & level).alias("hs"), of((F.col("dir") == "v") & upright).alias("vs")).where((F.size("hs") > 0) & (F.size("vs") > 0))
    pages, g = pages.join(glyphs, "page_id").join(sizes, "page_id"), F.col("glyph")
    hs = F.filter(_joined(F.filter("hs", lambda r: _long(r.getField, g)), g, kind), lambda r: r["x1"] - r["x0"] >= 5 * g)
    vs = F.filter("vs", lambda r: _high(r.getField, g))
    out = pages.select("page_id", F.inline(let(vs, lambda vs: F.when(F.size(vs) > 0, let(hs, lambda hs: _tables_of(hs, vs, g, F.col("width"), kind))))))
    return out if large is None else out.unionByName(_tables_in_rounds(rules.join(large, "page_id", "left_semi"), glyphs, sizes))


def _long(r: At, g: Column) -> Column:
    """Whether a level rule is a piece of a horizontal one."""
    return _level(r)[0] >= 2.5 * g


def _high(r: At, g: Column) -> Column:
    """Whether an upright rule is a vertical one: not too short, and not as high as the page."""
    dy = _level(r)[1]
    return (dy >= 2.5 * g) & (dy <= 0.4 * F.col("height"))


def _tables_in_rounds(rules: DataFrame, glyphs: DataFrame, sizes: DataFrame) -> DataFrame:
    """find_tables over the whole relation, for pages with very many rules."""
    known, g = rules.join(glyphs, "page_id").join(sizes, "page_id"), F.col("glyph")
    _, _, level, upright = _level()
    h = _joined_in_rounds(known.where((F.col("dir") == "h") & level & _long(F.col, g)).select("page_id", "rule_id", *ENDS), glyphs).join(glyphs, "page_id").where(F.col("x1") - F.col("x0") >= 5 * g).select("page_id", "rule_id", *ENDS, "glyph")
    v = known.where((F.col("dir") == "v") & upright & _high(F.col, g)).select("page_id", "rule_id", *[F.col(c).cast("double").alias(c) for c in ENDS], "glyph")
    pairs = checkpointed(touching(h, v))
    edges = pairs.select("page_id", F.col("h_id").alias("a_box_id"), F.col("v_id").alias("b_box_id")).unionByName(upright_pieces(v))
    both = h.withColumn("is_h", F.lit(1)).unionByName(v.withColumn("is_h", F.lit(0)))
    groups = layout.with_rows(both.withColumnRenamed("rule_id", "box_id"), edges).withColumnRenamed("box_id", "rule_id")
    crossed = pairs.where("crosses").select("page_id", F.col("h_id").alias("rule_id")).distinct().withColumn("crosses", F.lit(True))
    member = checkpointed(groups.join(crossed, ["page_id", "rule_id"], "left").withColumnRenamed("row_id", "region_id"))
    box = member.groupBy(*REGION, "glyph").agg(
        *[F.floor(F.min(F.least(f"{c}0", f"{c}1"))).cast("int").alias(f"{c}0") for c in "xy"], *[(F.floor(F.max(F.greatest(f"{c}0", f"{c}1"))) + 1).cast("int").alias(f"{c}1") for c in "xy"],
        F.sum("is_h").alias("rows"), F.count("*").alias("n_rules"), F.bool_or(F.coalesce("crosses", F.lit(False))).alias("crosses"),
    ).join(sizes, "page_id")
    fit = box.withColumns({"w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0")}).where(F.col("crosses") & (F.col("w") < 0.9 * F.col("width")) & (F.col("h") >= 1.5 * g))
    plus = plus_signs(fit.where("rows = 1"), member.select(*REGION, *ENDS)).withColumn("plus", F.lit(True))
    return fit.join(plus, REGION, "left").where("rows >= 2 or plus").select("page_id", F.col("region_id").alias("table_id"), *ENDS, "n_rules")


# ---------------------------------------------------------------- regions


def text_rows(regions: DataFrame, marks: DataFrame) -> DataFrame:
    """(page_id, region_id, rows): bands of marks at least half a glyph high, with nothing between two bands; rules (long and
    thin marks) are no writing. Regions without writing are not returned."""
    b = marks.join(regions.select(*REGION, "glyph"), REGION)
    w, h, g = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("glyph")
    rule = (F.greatest(w, h) >= 2.5 * g) & (F.least(w, h) <= _share(45, g))
    bands = layout.merged_intervals(b.where(~rule), [*REGION, "glyph"], "y0", "y1")
    return bands.where(F.col("stop") - F.col("start") >= 0.5 * g).groupBy(*REGION).agg(F.count("*").alias("rows"))


def _length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def _share(hundredths: int, x: Column) -> Column:
    """A share of a number, exact where it is one: 0.35 * 360 is 125.99999999999999 in floating point, this is 126."""
    return x * hundredths / 100


def _angle(p: str) -> Column:
    return F.pmod(F.abs(F.degrees(F.atan2(F.col(f"{p}_y1") - F.col(f"{p}_y0"), F.col(f"{p}_x1") - F.col(f"{p}_x0")))), F.lit(180.0))


def _acute(angle: Column) -> Column:
    return F.least(angle, 180 - angle)


def _distance(x: Column, y: Column, p: str) -> Column:
    """Distance of a point from a stroke."""
    x0, y0, x1, y1 = layout._c(f"{p}_x0", f"{p}_y0", f"{p}_x1", f"{p}_y1")
    dx, dy = x1 - x0, y1 - y0
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x0) * dx + (y - y0) * dy) / F.greatest(F.lit(1.0), dx * dx + dy * dy)))
    return _length(x - x0 - t * dx, y - y0 - t * dy)


def meeting_strokes(regions: DataFrame, strokes: DataFrame, reach: float = 0.8, least_angle: float = 25.0) -> DataFrame:
    """(page_id, region_id): the regions in which a long oblique stroke (20 to 70 degrees, at least two fifths of the region's
    larger side) ends at another stroke of a clearly different angle. Strokes under 2.5 glyphs are not looked at."""
    s = strokes.select(*REGION, "stroke_id", *[F.col(c).cast("double").alias(c) for c in ENDS]).join(regions.select(*REGION, "w", "h", "glyph"), REGION)
    length = _length(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    s = s.where(length >= F.floor(2.5 * F.col("glyph")))
    a = _prefixed(s.withColumn("length", length), "a", *REGION).withColumn("a_angle", _angle("a"))
    oblique = a.where(_acute(F.col("a_angle")).between(20, 70) & (F.col("a_length") >= _share(40, F.greatest("a_w", "a_h"))))
    b = _prefixed(s.drop("w", "h", "glyph"), "b", *REGION).withColumn("b_angle", _angle("b"))
    near = F.least(_distance(F.col("a_x0"), F.col("a_y0"), "b"), _distance(F.col("a_x1"), F.col("a_y1"), "b")) <= _share(round(100 * reach), F.col("a_glyph"))
    turns = _acute(F.abs(F.col("a_angle") - F.col("b_angle"))) >= least_angle
    return oblique.join(b, REGION).where((F.col("a_stroke_id") != F.col("b_stroke_id")) & turns & near).select(*REGION).distinct()


def line_art(regions: DataFrame, marks: DataFrame, most_marks: int = 15) -> DataFrame:
    """(page_id, region_id): the regions with few marks of which at least 55 % of the ink is large, thin and sparse."""
    b = marks.join(regions.select(*REGION, "glyph"), REGION)
    w, h, g = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("glyph")
    sparse = (F.greatest(w, h) >= 3.5 * g) & (F.least(w, h) >= _share(220, g)) & (F.col("area") * 100 < w * h * 12)
    ink = b.groupBy(*REGION).agg(F.sum("area").alias("ink"), F.coalesce(F.sum(F.when(sparse, F.col("area"))), F.lit(0)).alias("art"), F.count("*").alias("n"))
    return ink.where((F.col("ink") > 0) & (F.col("art") * 100 >= F.col("ink") * 55) & (F.col("n") <= most_marks)).select(*REGION)


def classify(regions: DataFrame, marks: DataFrame, strokes: DataFrame) -> DataFrame:
    """(page_id, region_id, kind): table for a region of two glyphs or more with two rows of writing and a plus; else diagram for
    line art in which strokes meet; else line."""
    rows = text_rows(regions, marks).where("rows >= 2").select(*REGION)
    high = regions.where(F.col("h") >= 2 * F.col("glyph")).join(rows, REGION, "left_semi")
    tables = plus_signs(high, strokes).withColumn("is_table", F.lit(True))
    drawn = meeting_strokes(regions.join(line_art(regions, marks), REGION, "left_semi"), strokes).withColumn("is_diagram", F.lit(True))
    kind = F.when(F.col("is_table"), "table").when(F.col("is_diagram"), "diagram").otherwise("line")
    return regions.select(*REGION).join(tables, REGION, "left").join(drawn, REGION, "left").select(*REGION, kind.alias("kind"))


# ---------------------------------------------------------------- labels


def _turn(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Positive or negative as the point p lies on one side or the other of the line from a to b, 0 on it."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _reaches(reach: Column) -> Column:
    """Whether the box (x0, y0, x1, y1) is at most `reach` away from the stroke (s_x0 ...): an end of the stroke is near the box,
    a corner of the box is near the stroke, or the stroke crosses a diagonal of the box."""
    x0, y0, x1, y1 = layout._c(*ENDS)
    sx0, sy0, sx1, sy1 = layout._c(*[f"s_{c}" for c in ENDS])
    beyond = lambda v, a, b: F.greatest(a - v, v - b, F.lit(0))
    ends = [_length(beyond(x, x0, x1), beyond(y, y0, y1)) for x, y in ((sx0, sy0), (sx1, sy1))]
    corners = [_distance(x, y, "s") for x in (x0, x1) for y in (y0, y1)]

    def cut(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
        stroke = _turn(sx0, sy0, sx1, sy1, ax, ay) * _turn(sx0, sy0, sx1, sy1, bx, by) <= 0
        return stroke & (_turn(ax, ay, bx, by, sx0, sy0) * _turn(ax, ay, bx, by, sx1, sy1) <= 0)

    return (F.least(*ends, *corners) <= reach) | cut(x0, y0, x1, y1) | cut(x0, y1, x1, y0)


def figure_labels(marks: DataFrame, strokes: DataFrame, figures: DataFrame, glyphs: DataFrame) -> DataFrame:
    """(page_id, box_id, figure_id): the small marks within a glyph of any figure's stroke, each with the figure whose centre is
    nearest (by the sum of both distances; ties go to the smaller id). Figures are taken as they came: a label does not move the
    centre for the next one, so no order of marks bears on the result. strokes: page_id, ends; figures: page_id, figure_id, ends."""
    doubles = [F.col(c).cast("double").alias(c) for c in ENDS]
    g = F.col("glyph")
    small = marks.select("page_id", "box_id", *doubles).join(glyphs, "page_id").where((F.col("x1") - F.col("x0") <= 2.2 * g) & (F.col("y1") - F.col("y0") <= 1.6 * g))
    s = _prefixed(strokes.select("page_id", *doubles), "s", "page_id")
    near = small.join(s, "page_id").where(_reaches(g)).select("page_id", "box_id", *ENDS).distinct()
    f = figures.select("page_id", "figure_id", ((F.col("x0") + F.col("x1")) / 2).alias("fx"), ((F.col("y0") + F.col("y1")) / 2).alias("fy"))
    away = F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("fx")) + F.abs((F.col("y0") + F.col("y1")) / 2 - F.col("fy"))
    best = near.join(f, "page_id").groupBy("page_id", "box_id").agg(F.min(F.struct(away.alias("away"), "figure_id")).alias("m"))
    return best.select("page_id", "box_id", "m.figure_id")


def labelled_figures(figures: DataFrame, marks: DataFrame, labels: DataFrame) -> DataFrame:
    """The figures with boxes that cover their labels, and n_labels."""
    own = marks.select("page_id", "box_id", *ENDS).join(labels, ["page_id", "box_id"]).select("page_id", "figure_id", *ENDS, F.lit(1).alias("n"))
    both = figures.select("page_id", "figure_id", *ENDS, F.lit(0).alias("n")).unionByName(own)
    return both.groupBy("page_id", "figure_id").agg(*[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")], F.sum("n").alias("n_labels"))
