"""The registered page queries, each with DuckDB SQL that states the same result independently (where SQL can)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import latex as L
from ..operators import calls, columns, drawings, evaluate, layout, merging, pages, reask, rules
from ..sources import derived as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *needs: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = D.duck(sql, *needs)
        return f

    return add


_SIZED = "select *, x1 - x0 w, y1 - y0 h from boxes"
_GLYPH = "select page_id, median(y1 - y0) glyph from boxes where y1 - y0 >= 8 and area >= 20 group by 1"

# ---------------------------------------------------------------- geometry


@query("select page_id, box_id, x0 as x, y0 as y, x1 - x0 as w, y1 - y0 as h from boxes", "boxes")
def geom_bbox(spark, sf):
    b = D.boxes(spark, sf).select("page_id", "box_id", G.bbox(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))).alias("b"))
    return b.select("page_id", "box_id", "b.x", "b.y", "b.w", "b.h")


@query("select a.page_id, a.box_id a_box_id, b.box_id b_box_id, least(a.x1, b.x1) - greatest(a.x0, b.x0) overlap_x, least(a.y1, b.y1) - greatest(a.y0, b.y0) overlap_y from boxes a join boxes b on a.page_id = b.page_id and a.box_id < b.box_id where overlap_x > 0 and overlap_y > 0", "boxes")
def geom_overlap(spark, sf):
    return layout.overlapping(D.boxes(spark, sf))


@query(f"with s as ({_SIZED}), g as ({_GLYPH}) select page_id, box_id, w >= 0.8 * glyph and h <= 0.45 * glyph and w >= 3 * h as is_bar from s join g using (page_id)", "boxes")
def geom_is_bar(spark, sf):
    return layout.with_glyph(D.boxes(spark, sf)).select("page_id", "box_id", G.is_bar(F.col("w"), F.col("h"), F.col("glyph")).alias("is_bar"))


@query(_GLYPH, "boxes")
def geom_glyph_height(spark, sf):
    return layout.glyph_heights(D.boxes(spark, sf))


@query(f"with s as ({_SIZED}), g as ({_GLYPH}) select page_id, box_id, area from s join g using (page_id) where area >= greatest(6.0, power(floor(0.25 * glyph), 2)) or w >= 0.5 * glyph", "boxes")
def geom_drop_dust(spark, sf):
    return layout.drop_dust(D.boxes(spark, sf)).select("page_id", "box_id", "area")


@query(f"with g as ({_GLYPH}) select page_id, box_id, area from boxes join g using (page_id) where area >= 0.5 * glyph * glyph", "boxes")
def geom_low_ink(spark, sf):
    return layout.with_glyph(D.boxes(spark, sf)).where("area >= 0.5 * glyph * glyph").select("page_id", "box_id", "area")


@query("select page_id, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1, cast(sum(area) as bigint) area from boxes group by 1", "boxes")
def geom_union_box(spark, sf):
    return layout.union_boxes(D.boxes(spark, sf), "page_id")


_ISLANDS = """with b as (select page_id, x0, x1, max(x1) over (partition by page_id order by x0, x1 rows between unbounded preceding and 1 preceding) reach from boxes),
    i as (select *, sum(case when reach is null or x0 > reach then 1 else 0 end) over (partition by page_id order by x0, x1 rows between unbounded preceding and current row) island from b),
    m as (select page_id, island, min(x0) start, max(x1) stop from i group by 1, 2)"""


@query(_ISLANDS + ", u as (select page_id, min(x0) x0, max(x1) x1 from boxes group by 1) select u.page_id, 0 as line_id, cast(sum(m.stop - m.start) as double) / greatest(1, any_value(u.x1 - u.x0)) as share from u join m using (page_id) group by u.page_id", "boxes")
def geom_coverage(spark, sf):
    boxes = D.boxes(spark, sf)
    lines = layout.union_boxes(boxes, "page_id").withColumn("line_id", F.lit(0))
    return layout.coverage(lines, boxes)


@query("select page_id, min(idx) start, max(idx) + 1 stop from (select page_id, idx, idx - row_number() over (partition by page_id order by idx) island from base) group by page_id, island", "base")
def geom_runs(spark, sf):
    return layout.runs(D.base(spark, sf), "page_id", "idx")


@query(_ISLANDS + """, g as (select page_id, stop gap_start, lead(start) over (partition by page_id order by start) gap_end from m), u as (select page_id, min(x0) l, max(x1) r from boxes group by 1)
    select page_id, gap_start, gap_end from g join u using (page_id) where gap_end - gap_start >= 40 and gap_start - l >= 60 and r - gap_end >= 60 qualify row_number() over (partition by page_id order by gap_end - gap_start desc, gap_start) = 1""", "boxes")
def geom_find_gutter(spark, sf):
    return layout.gutters(D.boxes(spark, sf), 40, 60)


@query("""with a as (select page_id, row_number() over (partition by page_id order by y0, box_id) r, count(*) over (partition by page_id) n, y0, y1 from boxes where box_id % 2 = 1),
    b as (select page_id, row_number() over (partition by page_id order by y0, box_id) r, count(*) over (partition by page_id) n, y0, y1 from boxes where box_id % 2 = 0)
    select a.page_id, bool_and(least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.5 * least(a.y1 - a.y0, b.y1 - b.y0)) and max(a.n) = max(b.n) and count(*) = max(a.n) as aligned from a join b using (page_id, r) group by 1""", "boxes")
def geom_rows_aligned(spark, sf):
    b = D.boxes(spark, sf)
    return layout.aligned(b.where("box_id % 2 = 1"), b.where("box_id % 2 = 0"))


_EDGES = f"""s as ({_SIZED}), g as ({_GLYPH}), c as (select s.*, glyph from s join g using (page_id) where h >= 0.5 * glyph and h <= 1.8 * glyph and not (w >= 0.8 * glyph and h <= 0.45 * glyph and w >= 3 * h)),
    e as (select a.page_id, a.box_id a_box_id, b.box_id b_box_id from c a join c b on a.page_id = b.page_id and a.box_id < b.box_id where least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 0.4 * least(a.h, b.h)
        and case when a.h <= b.h then (a.y0 + a.y1) / 2 between b.y0 and b.y1 else (b.y0 + b.y1) / 2 between a.y0 and a.y1 end)"""


@query(f"with {_EDGES} select page_id, a_box_id, b_box_id from e", "boxes")
def geom_same_row(spark, sf):
    return layout.same_row_edges(D.boxes(spark, sf))


@query(f"""with recursive {_EDGES}, u as (select page_id, a_box_id a, b_box_id b from e union select page_id, b_box_id, a_box_id from e),
    r(page_id, box_id, root) as (select page_id, box_id, box_id from boxes union select r.page_id, u.b, r.root from r join u on u.page_id = r.page_id and u.a = r.box_id)
    select page_id, box_id, min(root) as row_id from r group by 1, 2""", "boxes")
def geom_components(spark, sf):
    b = D.boxes(spark, sf)
    return layout.rows_of(b, layout.same_row_edges(b))


@query(f"""with s as ({_SIZED}), g as ({_GLYPH}), bars as (select s.*, glyph from s join g using (page_id) where w >= 0.8 * glyph and h <= 0.45 * glyph and w >= 3 * h),
    n as (select b.page_id, b.box_id bar_box_id, glyph, o.box_id, case when b.y0 - o.y1 between -3 and 0.9 * glyph then 'above' when o.y0 - b.y1 between -3 and 0.9 * glyph then 'below' end side, case when b.y0 - o.y1 between -3 and 0.9 * glyph then b.y0 - o.y1 else o.y0 - b.y1 end gap
        from bars b join boxes o on o.page_id = b.page_id and o.box_id <> b.box_id and o.x0 >= b.x0 - 0.25 * glyph and o.x1 <= b.x1 + 0.25 * glyph),
    m as (select *, min(gap) over (partition by page_id, bar_box_id, side) best from n where side is not null), t as (select page_id, bar_box_id from m group by 1, 2 having count(distinct side) = 2)
    select m.page_id, m.bar_box_id, m.side, m.box_id from m join t using (page_id, bar_box_id) where gap <= best + 0.3 * glyph""", "boxes")
def geom_fraction_bars(spark, sf):
    return layout.bar_neighbours(D.boxes(spark, sf))


@query("""with f as (select * from boxes where x1 - x0 > 150), l as (select * from boxes where x1 - x0 < 70)
    select l.page_id, l.box_id, f.box_id figure_id, abs((l.x0 + l.x1) / 2 - (f.x0 + f.x1) / 2) + abs((l.y0 + l.y1) / 2 - (f.y0 + f.y1) / 2) as distance from l join f using (page_id) qualify row_number() over (partition by l.page_id, l.box_id order by distance, f.box_id) = 1""", "boxes")
def geom_nearest_figure(spark, sf):
    b = D.boxes(spark, sf)
    return layout.nearest(b.where("x1 - x0 < 70"), b.where("x1 - x0 > 150"))


def _rules(spark, sf):
    mid = F.floor((F.col("x0") + F.col("x1")) / 2).cast("int")
    b = D.boxes(spark, sf)
    tall = b.select("page_id", (F.col("box_id") * 2 + 1).alias("rule_id"), F.lit("v").alias("dir"), mid.alias("x0"), (F.col("y0") - 80).alias("y0"), mid.alias("x1"), (F.col("y1") + 80).alias("y1"))
    return b.select("page_id", (F.col("box_id") * 2).alias("rule_id"), F.lit("h").alias("dir"), "x0", "y0", "x1", F.col("y0").alias("y1")).unionByName(tall)


_RULES = """r as (select page_id, box_id * 2 rule_id, 'h' dir, x0, y0, x1, y0 y1 from boxes union all select page_id, box_id * 2 + 1, 'v', (x0 + x1) // 2, y0 - 80, (x0 + x1) // 2, y1 + 80 from boxes),
    x as (select h.page_id, h.rule_id h_id, v.rule_id v_id from r h join r v on h.page_id = v.page_id and h.dir = 'h' and v.dir = 'v' and v.x0 between h.x0 + 10 and h.x1 - 10 and h.y0 between v.y0 + 10 and v.y1 - 10)"""


@query(f"with {_RULES} select page_id, h_id, v_id from x", "boxes")
def geom_rule_crossings(spark, sf):
    return layout.rule_crossings(_rules(spark, sf), 10)


@query(f"""with recursive {_RULES}, u as (select page_id, h_id a, v_id b from x union select page_id, v_id, h_id from x),
    c(page_id, id, root) as (select distinct page_id, a, a from u union select c.page_id, u.b, c.root from c join u on u.page_id = c.page_id and u.a = c.id), t as (select page_id, id, min(root) table_id from c group by 1, 2)
    select t.page_id, t.table_id, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1, count(*) n_rules from t join r on r.page_id = t.page_id and r.rule_id = t.id group by 1, 2""", "boxes")
def geom_tables(spark, sf):
    return layout.tables_of(_rules(spark, sf), 10)


@query("""with p as (select a.page_id, a.box_id a_id, b.box_id b_id, a.x0 * 1.0::double ax, a.y0 * 1.0::double ay, (a.x1 - a.x0) * 1.0::double aw, (a.y1 - a.y0) * 1.0::double ah, b.x0 * 1.0::double bx, b.y1 * 1.0::double byy, (b.x1 - b.x0) * 1.0::double bw, (b.y0 - b.y1) * 1.0::double bh from boxes a join boxes b on a.page_id = b.page_id and a.box_id < b.box_id),
    q as (select *, aw * bh - ah * bw det, sqrt(aw * aw + ah * ah) la, sqrt(bw * bw + bh * bh) lb from p), s as (select *, ((bx - ax) * bh - (byy - ay) * bw) / nullif(det, 0) t, ((bx - ax) * ah - (byy - ay) * aw) / nullif(det, 0) u from q)
    select page_id, a_id, b_id from s where t * la >= 3 and (1 - t) * la >= 3 and u * lb >= 3 and (1 - u) * lb >= 3""", "boxes")
def geom_segment_crossing(spark, sf):
    d = lambda c: F.col(c).cast("double")
    p = layout.pairs(D.boxes(spark, sf))
    a = F.struct(d("a_x0").alias("x0"), d("a_y0").alias("y0"), d("a_x1").alias("x1"), d("a_y1").alias("y1"))
    b = F.struct(d("b_x0").alias("x0"), d("b_y1").alias("y0"), d("b_x1").alias("x1"), d("b_y0").alias("y1"))
    return p.where(G.crossing(a, b, F.lit(3.0))).select("page_id", F.col("a_box_id").alias("a_id"), F.col("b_box_id").alias("b_id"))


#: Levels of the rule pieces are 120 apart, so only the two pieces of one level can meet, and the joined rule's ends are theirs.
_JOINED = """g as (select distinct page_id, 20 + page_id % 7 glyph from rule_pieces), l as (select page_id, rule_id // 4 level, max(case when rule_id % 4 = 2 then x1 end) stop, max(case when rule_id % 4 = 2 then y1 end) y, max(case when rule_id % 4 = 3 then x0 end) start, max(case when rule_id % 4 = 3 then y0 end) yy from rule_pieces where dir = 'h' group by 1, 2),
    m as (select page_id, level, start - stop <= 3 * glyph and abs(y - yy) <= 0.5 * glyph meet from l join g using (page_id)),
    j as (select page_id, min(rule_id) rule_id, arg_min(x0, x0)::double x0, arg_min(y0, x0)::double y0, arg_max(x1, x1)::double x1, arg_max(y1, x1)::double y1, count(*) n_pieces from (select r.*, case when meet then 0 else rule_id % 2 end part, level from rule_pieces r join m on m.page_id = r.page_id and m.level = r.rule_id // 4 where dir = 'h') group by page_id, level, part)"""


def _rule_pieces(spark, sf):
    rules = D.rule_pieces(spark, sf)
    pages = D.base(spark, sf).select("page_id").distinct()  # every line has a rule
    return rules, pages.withColumn("glyph", (20 + F.col("page_id") % 7).cast("double")), pages.select("page_id", F.lit(900).alias("width"), F.lit(520).alias("height"))


@query(f"with {_JOINED} select page_id, rule_id, x0, y0, x1, y1, n_pieces from j", "rule_pieces")
def geom_rule_pieces(spark, sf):
    rules, glyphs, _ = _rule_pieces(spark, sf)
    return drawings.join_pieces(rules.where("dir = 'h'"), glyphs)


@query(f"""with recursive {_JOINED}, h as (select j.*, glyph, 0.7 * glyph k from j join g using (page_id) where x1 - x0 >= 5 * glyph), v as (select r.*, glyph from rule_pieces r join g using (page_id) where dir = 'v' and y1 - y0 >= 2.5 * glyph and y1 - y0 <= 208 and x1 - x0 <= 0.18 * (y1 - y0)),
    t as (select h.page_id, h.rule_id h_id, v.rule_id v_id, k, h.x0 hx0, h.x1 hx1, v.x0 vx0, v.x1 vx1, v.y0 vy0, v.y1 vy1, h.y0 + least(1, greatest(0, ((v.x0 + v.x1) / 2 - h.x0) / (h.x1 - h.x0))) * (h.y1 - h.y0) y from h join v using (page_id)),
    c as (select *, vx0 + least(1, greatest(0, (y - vy0) / (vy1 - vy0))) * (vx1 - vx0) x from t), e as (select page_id, h_id, v_id, x between hx0 + k and hx1 - k and y between vy0 + k and vy1 - k crosses from c where x between hx0 - k and hx1 + k and y between vy0 - k and vy1 + k),
    w as (select a.page_id, a.rule_id a, b.rule_id b, (greatest(a.y0, b.y0) + least(a.y1, b.y1)) / 2 y, a.glyph, a.x0 ax0, a.x1 ax1, a.y0 ay0, a.y1 ay1, b.x0 bx0, b.x1 bx1, b.y0 by0, b.y1 by1 from v a join v b on a.page_id = b.page_id and a.rule_id < b.rule_id where greatest(a.y0, b.y0) - least(a.y1, b.y1) <= a.glyph),
    z as (select page_id, a, b from w where abs(ax0 + least(1, greatest(0, (y - ay0) / (ay1 - ay0))) * (ax1 - ax0) - bx0 - least(1, greatest(0, (y - by0) / (by1 - by0))) * (bx1 - bx0)) <= 0.7 * glyph),
    u as (select page_id, h_id a, v_id b from e union select page_id, v_id, h_id from e union select page_id, a, b from z union select page_id, b, a from z),
    r as (select page_id, rule_id, x0, y0, x1, y1, 1 is_h from h union all select page_id, rule_id, x0, y0, x1, y1, 0 from v),
    q(page_id, id, root) as (select page_id, rule_id, rule_id from r union select q.page_id, u.b, q.root from q join u on u.page_id = q.page_id and u.a = q.id), n as (select page_id, id, min(root) table_id from q group by 1, 2),
    x as (select n.page_id, table_id, cast(floor(min(least(x0, x1))) as int) x0, cast(floor(min(least(y0, y1))) as int) y0, cast(floor(max(greatest(x0, x1))) + 1 as int) x1, cast(floor(max(greatest(y0, y1))) + 1 as int) y1, sum(is_h) n_h, count(*) n_rules, max(20 + n.page_id % 7) glyph,
        bool_or(exists (select 1 from e where e.page_id = n.page_id and e.h_id = n.id and e.crosses)) crosses from n join r on r.page_id = n.page_id and r.rule_id = n.id group by 1, 2),
    d as (select n.page_id, n.table_id, r.x0, r.x1, r.y0, r.y1, is_h from n join r on r.page_id = n.page_id and r.rule_id = n.id),
    s as (select distinct a.page_id, a.table_id from d a join d b on a.page_id = b.page_id and a.table_id = b.table_id and a.is_h = 1 and b.is_h = 0 join x on x.page_id = a.page_id and x.table_id = a.table_id
        where a.x1 - a.x0 >= greatest(floor(4 * glyph), floor(0.3 * (x.x1 - x.x0))) and b.y1 - b.y0 >= greatest(floor(1.5 * glyph), floor(0.35 * (x.y1 - x.y0))) and abs(a.y1 - a.y0) <= 0.18 * (a.x1 - a.x0)
        and (b.x0 + b.x1) / 2 between a.x0 + 0.7 * glyph and a.x1 - 0.7 * glyph and (a.y0 + a.y1) / 2 between b.y0 + 0.7 * glyph and b.y1 - 0.7 * glyph)
    select x.page_id, x.table_id, x.x0, x.y0, x.x1, x.y1, n_rules from x left join s using (page_id, table_id) where crosses and x.x1 - x.x0 < 810 and x.y1 - x.y0 >= 1.5 * glyph and (n_h >= 2 or s.page_id is not null)""", "rule_pieces")
def geom_find_tables(spark, sf):
    return drawings.find_tables(*_rule_pieces(spark, sf))


_PLUS = """k as (select *, abs(x1 - x0) dx, abs(y1 - y0) dy from drawing_strokes), big as (select *, greatest(floor(4 * glyph), floor(0.3 * w)) across, greatest(floor(1.5 * glyph), floor(0.35 * h)) down from drawing_regions),
    plus as (select distinct r.page_id from big r join k a using (page_id) join k b using (page_id) where w > across and h > down and a.dx >= across and a.dy <= 0.18 * a.dx and b.dy >= down and b.dx <= 0.18 * b.dy
        and (b.x0 + b.x1) / 2 between a.x0 + 0.7 * glyph and a.x1 - 0.7 * glyph and (a.y0 + a.y1) / 2 between b.y0 + 0.7 * glyph and b.y1 - 0.7 * glyph)"""
_MEET = """ob as (select s.*, w, h, glyph, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) len, degrees(atan2(y1 - y0, x1 - x0)) ang from drawing_strokes s join drawing_regions using (page_id) where sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) >= floor(2.5 * glyph)),
    ends as (select a.page_id, a.glyph, e.px, e.py, b.x0, b.y0, b.x1 - b.x0 dx, b.y1 - b.y0 dy from ob a join ob b on a.page_id = b.page_id and a.stroke_id <> b.stroke_id, lateral (values (a.x0, a.y0), (a.x1, a.y1)) e(px, py)
        where a.ang between 20 and 70 and a.len >= 0.4 * greatest(a.w, a.h) and least(abs(a.ang - b.ang), 180 - abs(a.ang - b.ang)) >= 25),
    along as (select *, greatest(0, least(1, ((px - x0) * dx + (py - y0) * dy) / greatest(1, dx * dx + dy * dy))) t from ends), meet as (select distinct page_id from along where sqrt((px - x0 - t * dx) ** 2 + (py - y0 - t * dy) ** 2) <= 0.8 * glyph)"""


@query(f"with {_MEET} select page_id, 0 as region_id from meet", "drawing_regions")
def geom_meeting_strokes(spark, sf):
    return drawings.meeting_strokes(D.drawing_regions(spark, sf), D.drawing_strokes(spark, sf))


@query(f"""with {_PLUS}, {_MEET}, art as (select page_id from (select page_id, area, (greatest(m.x1 - m.x0, m.y1 - m.y0) >= 3.5 * glyph and least(m.x1 - m.x0, m.y1 - m.y0) >= 2.2 * glyph and area < 0.12 * (m.x1 - m.x0) * (m.y1 - m.y0)) sparse from drawing_marks m join drawing_regions using (page_id)) group by 1
        having sum(area) > 0 and coalesce(sum(area) filter (where sparse), 0) >= 0.55 * sum(area) and count(*) <= 15),
    b as (select m.*, glyph from drawing_marks m join drawing_regions using (page_id) where not (greatest(x1 - x0, y1 - y0) >= 2.5 * glyph and least(x1 - x0, y1 - y0) <= 0.45 * glyph)),
    i as (select *, case when y0 <= max(y1) over (partition by page_id order by y0, y1 rows between unbounded preceding and 1 preceding) then 0 else 1 end fresh from b), n as (select *, sum(fresh) over (partition by page_id order by y0, y1 rows unbounded preceding) band from i),
    bands as (select page_id from (select page_id, band, max(y1) - min(y0) tall, any_value(glyph) glyph from n group by 1, 2) where tall >= 0.5 * glyph group by 1 having count(*) >= 2)
    select r.page_id, 0 as region_id, case when r.h >= 2 * r.glyph and r.page_id in (select page_id from bands) and r.page_id in (select page_id from plus) then 'table' when r.page_id in (select page_id from art) and r.page_id in (select page_id from meet) then 'diagram' else 'line' end as kind from drawing_regions r""", "drawing_regions", "drawing_marks")
def geom_classify(spark, sf):
    return drawings.classify(D.drawing_regions(spark, sf), D.drawing_marks(spark, sf), D.drawing_strokes(spark, sf))


def _cut(a: str, b: str) -> str:
    side = lambda p, q, x, y: f"(({q[0]} - {p[0]}) * ({y} - {p[1]}) - ({q[1]} - {p[1]}) * ({x} - {p[0]}))"
    s, e, a, b = ("sx0", "sy0"), ("sx1", "sy1"), a.split(), b.split()
    return f"({side(s, e, *a)} * {side(s, e, *b)} <= 0 and {side(a, b, *s)} * {side(a, b, *e)} <= 0)"


def _corner(x: str, y: str) -> str:
    t = f"greatest(0, least(1, (({x} - sx0) * (sx1 - sx0) + ({y} - sy0) * (sy1 - sy0)) / greatest(1, (sx1 - sx0) ** 2 + (sy1 - sy0) ** 2)))"
    return f"sqrt(({x} - sx0 - {t} * (sx1 - sx0)) ** 2 + ({y} - sy0 - {t} * (sy1 - sy0)) ** 2)"


_ENDS_NEAR = ", ".join(f"sqrt(greatest(x0 - {x}, {x} - x1, 0) ** 2 + greatest(y0 - {y}, {y} - y1, 0) ** 2)" for x, y in (("sx0", "sy0"), ("sx1", "sy1")))
_CORNERS_NEAR = ", ".join(_corner(x, y) for x in ("x0", "x1") for y in ("y0", "y1"))


@query(f"""with f as (select page_id, stroke_id % 2 figure_id, min(x0) fx0, min(y0) fy0, max(x1) fx1, max(y1) fy1 from drawing_strokes group by 1, 2),
    m as (select page_id, box_id, d.x0, d.y0, d.x1, d.y1, s.x0 sx0, s.y0 sy0, s.x1 sx1, s.y1 sy1, glyph from drawing_marks d join drawing_regions using (page_id) join drawing_strokes s using (page_id) where d.x1 - d.x0 <= 2.2 * glyph and d.y1 - d.y0 <= 1.6 * glyph),
    n as (select distinct page_id, box_id, x0, y0, x1, y1 from m where least({_ENDS_NEAR}, {_CORNERS_NEAR}) <= glyph or {_cut("x0 y0", "x1 y1")} or {_cut("x0 y1", "x1 y0")}),
    o as (select page_id, box_id, figure_id, x0, y0, x1, y1 from n join f using (page_id) qualify row_number() over (partition by page_id, box_id order by abs((x0 + x1) / 2 - (fx0 + fx1) / 2) + abs((y0 + y1) / 2 - (fy0 + fy1) / 2), figure_id) = 1),
    u as (select page_id, figure_id, fx0 x0, fy0 y0, fx1 x1, fy1 y1, 0 n from f union all select page_id, figure_id, x0, y0, x1, y1, 1 from o)
    select page_id, figure_id, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1, cast(sum(n) as bigint) n_labels from u group by 1, 2""", "drawing_regions", "drawing_marks")
def geom_figure_labels(spark, sf):
    strokes, marks = D.drawing_strokes(spark, sf), D.drawing_marks(spark, sf)
    figures = layout.union_boxes(strokes.withColumns({"figure_id": F.col("stroke_id") % 2, "area": F.lit(0)}), "page_id", "figure_id").drop("area")
    labels = drawings.figure_labels(marks, strokes, figures, D.drawing_regions(spark, sf).select("page_id", "glyph"))
    return drawings.labelled_figures(figures, marks, labels)


@query()
def geom_columns(spark, sf):
    """Rounds that split and cluster anew: no SQL; tests/test_columns.py holds them against a plain walk."""
    boxes = D.boxes(spark, sf)
    return columns.reading_units(boxes.withColumn("line_id", F.lit(0)), _glyphs(spark, sf))


@query()
def geom_reading_order(spark, sf):
    return layout.reading_order(D.boxes(spark, sf))


@query("""with n as (select a.*, max(case when b.box_id <> a.box_id and b.y1 <= a.y0 then b.y1 end) up, min(case when b.box_id <> a.box_id and b.y0 >= a.y1 then b.y0 end) down from boxes a join boxes b on a.page_id = b.page_id and (a.box_id = b.box_id or least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0) group by all)
    select page_id, box_id, greatest(0, x0 - 12) x0, cast(greatest(0, y0 - 12, coalesce((up + y0) // 2, 0)) as int) y0, least(1300, x1 + 12) x1, cast(least(520, y1 + 12, coalesce((y1 + down) // 2, 520)) as int) y1 from n""", "boxes")
def geom_pad(spark, sf):
    return layout.padded(D.boxes(spark, sf), 12, 1300, 520)


def _glyphs(spark, sf):
    return layout.glyph_heights(D.boxes(spark, sf))


# The queries below have no SQL: their rounds and folds change the rows that they read. tests/test_merging.py holds each
# operator against plain Python.


@query()
def geom_merge_close(spark, sf):
    return merging.merge_close(D.boxes(spark, sf), 10)


@query()
def geom_merge_rows(spark, sf):
    return merging.merge_rows(D.boxes(spark, sf), _glyphs(spark, sf))


@query()
def geom_merge_boxes(spark, sf):
    return merging.merge_boxes(D.boxes(spark, sf), _glyphs(spark, sf))


@query()
def geom_table_writing(spark, sf):
    tables = layout.tables_of(_rules(spark, sf).where("dir = 'h' or rule_id % 4 = 1"), 10).withColumn("area", F.lit(0))
    return merging.table_writing(D.boxes(spark, sf), tables, _glyphs(spark, sf))[1].where("table_id is not null")


@query()
def geom_bar_pieces(spark, sf):
    return merging.join_bar_pieces(D.strokes(spark, sf), _glyphs(spark, sf))


def _line_boxes(spark, sf):
    b = layout.with_glyph(D.boxes(spark, sf))
    return b.where("h >= 0.8 * glyph"), b.where("h < 0.8 * glyph")


@query()
def geom_attach_fragments(spark, sf):
    lines, pieces = _line_boxes(spark, sf)
    return merging.attach_fragments(lines, pieces, _glyphs(spark, sf))


@query()
def geom_absorb_fragments(spark, sf):
    return merging.absorb_fragments(D.boxes(spark, sf), D.strokes(spark, sf), _glyphs(spark, sf))


_LINES = "l as (select page_id, box_id line_id, x0 x, y0 y, x1 - x0 w, y1 - y0 h from boxes where box_id % 2 = 1), r as (select page_id, box_id region_id, x0 - 60 x, y0 - 70 y, x1 - x0 + 120 w, y1 - y0 + 100 h from boxes where box_id % 2 = 0)"


@query(f"""with {_LINES}, p as (select l.page_id, line_id, region_id, l.x + l.w / 2 between r.x and r.x + r.w and l.y + l.h / 2 between r.y and r.y + r.h as inside,
    greatest(0, least(l.x + l.w, r.x + r.w) - greatest(l.x, r.x)) * greatest(0, least(l.y + l.h, r.y + r.h) - greatest(l.y, r.y)) / greatest(1, l.w * l.h) share from l join r using (page_id))
    select page_id, line_id, region_id, inside by_centre from p where inside or share >= 0.3 qualify row_number() over (partition by page_id, line_id order by inside desc, case when inside then 0 else -share end, region_id) = 1""", "boxes")
def geom_match_lines(spark, sf):
    b = D.boxes(spark, sf)
    xywh = lambda dx, dy, dw, dh: [(F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y"), (F.col("x1") - F.col("x0") + dw).alias("w"), (F.col("y1") - F.col("y0") + dh).alias("h")]
    lines = b.where("box_id % 2 = 1").select("page_id", F.col("box_id").alias("line_id"), *xywh(0, 0, 0, 0))
    regions = b.where("box_id % 2 = 0").select("page_id", F.col("box_id").alias("region_id"), F.struct(*xywh(-60, -70, 120, 100)).alias("bbox"))
    return layout.match_lines(lines, regions)


# ---------------------------------------------------------------- sources and sinks


@query("select doc_id, case when doc_id % 6 >= 4 then 415 when doc_id % 7 = 0 then 0 + 400 when n_chars * 2000 > 10 * 1048576 then 413 end as error_code from documents")
def src_validate_upload(spark, sf):
    mime = F.get(F.array(*[F.lit(m) for m in (*pages.MIME, "text/html")]), F.least(F.col("doc_id") % 6, F.lit(4)).cast("int"))
    size = F.when(F.col("doc_id") % 7 == 0, 0).otherwise(F.col("n_chars") * 2000)
    return D.table(spark, sf, "documents").select("doc_id", pages.upload_error(mime, size).alias("error_code"))


@query("with r as (select crop_id, row_number() over (partition by crop_id order by idx) - 1 region_idx, gold latex, verified from pred_gold) select crop_id, cast(region_idx as int) region_idx, latex from r where verified and trim(latex) <> ''", "pred_gold")
def src_manifest(spark, sf):
    listed = F.array_sort(F.collect_list(F.struct("idx", F.col("gold").alias("latex"), "verified")))
    return evaluate.manifest_crops(D.pred_gold(spark, sf).groupBy(F.col("crop_id").alias("id")).agg(listed.alias("regions")))


@query("select source, coalesce(nullif(lang, 'de'), 'line') as kind, count(*) as n from documents group by 1, 2")
def src_kinds(spark, sf):
    kind = F.coalesce(F.when(F.col("lang") != "de", F.col("lang")), F.lit("line"))
    return D.table(spark, sf, "documents").groupBy("source", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("with c as (select page_id, list(x0 order by box_id) bx from boxes group by 1), n as (select page_id, list(case when page_id % 5 = 0 then x0 + 1 else x0 end order by box_id) bx from boxes where page_id % 7 <> 0 group by 1) select c.page_id, cast(len(c.bx) as int) payload from c left join n using (page_id) where n.bx is null or n.bx = c.bx", "boxes")
def src_fresh_cache(spark, sf):
    b = D.boxes(spark, sf)
    listed = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("box_id", x.alias("x")))), lambda s: s["x"])
    cached = b.groupBy("page_id").agg(listed(F.col("x0")).alias("boxes")).withColumn("payload", F.size("boxes"))
    moved = F.when(F.col("page_id") % 5 == 0, F.col("x0") + 1).otherwise(F.col("x0"))
    return pages.fresh_cache(b.where("page_id % 7 <> 0").groupBy("page_id").agg(listed(moved).alias("boxes")), cached)


@query("select doc_id, 'data:image/png;base64,' || base64(encode(text)) as url from documents")
def sink_data_url(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", pages.data_url(F.lit("image/png"), F.col("text").cast("binary")).alias("url"))


@query("select doc_id, case when doc_id % 6 >= 4 then 'error' end as status, case when doc_id % 6 >= 4 then 'unsupported type' end as detail from documents")
def sink_error(spark, sf):
    e = pages.error_row(F.when(F.col("doc_id") % 6 >= 4, 415), F.lit("unsupported type"))
    return D.table(spark, sf, "documents").select("doc_id", e.alias("e")).select("doc_id", "e.status", "e.detail")


@query("select page_id, box_id, case when least(2.5, sqrt(250000 / greatest(1, (x1 - x0) * (y1 - y0)))) > 1.05 then least(2.5, sqrt(250000 / greatest(1, (x1 - x0) * (y1 - y0)))) else 1.0 end as factor from boxes", "boxes")
def sink_crop_scale(spark, sf):
    b = D.boxes(spark, sf)
    return b.select("page_id", "box_id", G.upscale(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("factor"))


@query("select page_id, box_id idx, x0 x, y0 y, x1 - x0 w, y1 - y0 h, cast(box_id + 1 as varchar) || case when y1 - y0 > 60 then ' T' when x1 - x0 < 40 then ' D' else '' end as label, case when y1 - y0 > 60 then 'orange' when x1 - x0 < 40 then 'purple' when box_id % 3 = 0 then 'red' when box_id % 3 = 1 then 'green' else 'blue' end as colour from boxes", "boxes")
def sink_preview_overlay(spark, sf):
    kind = F.when(F.col("y1") - F.col("y0") > 60, "table").when(F.col("x1") - F.col("x0") < 40, "diagram").otherwise("line")
    b = D.boxes(spark, sf).select("page_id", F.col("box_id").alias("idx"), kind.alias("kind"), G.bbox(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))).alias("bbox"))
    return pages.overlay(b)


@query("select page_id, string_agg(text, chr(10) || chr(10) order by idx) as document from math_lines group by 1", "math_lines")
def merge_document(spark, sf):
    return pages.merge_lines(D.math_lines(spark, sf), "text")


# ---------------------------------------------------------------- text


@query("select doc_id, idx, line from (select doc_id, idx, trim(line, ' ') line from doc_lines) where line <> ''", "doc_lines")
def text_strip_fences(spark, sf):
    fenced = F.when(F.col("idx") % 2 == 0, F.concat(F.lit("```latex\n"), F.col("line"), F.lit("\n```"))).otherwise(F.trim("line"))
    return D.doc_lines(spark, sf).select("doc_id", "idx", F.trim(L.strip_fences(fenced)).alias("line")).where("line <> ''")


@query("select doc_id, '$$a ' || regexp_replace(trim(replace(text, '$', ''), ' ' || chr(10)), '\\s+', ' ', 'g') || ' b$$' || chr(10) || 'c' as t from documents")
def text_collapse_display(spark, sf):
    d = D.table(spark, sf, "documents")
    cut = F.btrim(F.replace("text", F.lit("$"), F.lit("")), F.lit(" \n"))
    return d.select("doc_id", L.collapse_display(F.concat(F.lit("$$\na\n"), cut, F.lit("\n b $$\nc"))).alias("t"))


@query("with s as (select page_id, idx, string_split(text, '$') parts from math_lines) select page_id, idx, list_aggregate(list_filter([(case when i % 2 = 1 then 't:' else 'm:' end) || parts[i] for i in range(1, len(parts) + 1)], lambda x: x <> 't:'), 'string_agg', '|') as segs, len(parts) % 2 = 0 as is_open from s", "math_lines")
def text_split_segments(spark, sf):
    s = D.math_lines(spark, sf).select("page_id", "idx", L.split_segments(F.col("text")).alias("s"))
    return s.select("page_id", "idx", F.array_join(F.transform("s.segments", lambda x: F.concat(F.when(x["kind"] == "text", "t:").otherwise("m:"), x["content"])), "|").alias("segs"), F.col("s.open").isNotNull().alias("is_open"))


@query("select page_id, idx, case when (length(text) - length(replace(text, '$', ''))) % 2 = 1 then text || '$' else text end as text from math_lines", "math_lines")
def text_join_segments(spark, sf):
    return D.math_lines(spark, sf).select("page_id", "idx", L.join_segments(L.split_segments(F.col("text"))["segments"]).alias("text"))


@query(r"select page_id, idx, regexp_matches(text, '[\\^_=<>≥≤≠∈∉∞⇒⇔→²³√±·×∪∩∀∃ℝ]') or regexp_matches(text, '[0-9]\s*[-+*/]\s*\w|\w\s*[-+*/]\s*[0-9]') or regexp_matches(text, '[0-9]\)|\([^)]*[0-9]') as math from math_lines", "math_lines")
def text_looks_math(spark, sf):
    return D.math_lines(spark, sf).select("page_id", "idx", L.looks_math(F.col("text")).alias("math"))


@query("""with t as (select distinct unnest(string_split(line, ' ')) as token from doc_lines), w as (select token, lower(regexp_extract(token, '^[(\\[]?([A-Za-zăâîșțĂÂÎȘȚşţ]+)[.,;:)\\]]?$', 1)) word from t)
    select token, regexp_matches(token, '^\\(?([A-Za-zăâîșț]{1,4}\\.){1,3}[:,)]?$') or regexp_matches(token, '^[:;,.!?]+$') or (word <> '' and word not in ('sin','cos','tg','ctg','tan','cot','ln','lg','log','lim','det','max','min','rang','arctg','arcsin','arccos','mod','gcd') and (length(word) >= 3 or lower(token) in ('pt','pt.','pe','si','in','de','la','cu','iar','sau','deci','unde','nu','este','sunt','fie','ca','din','al','ale') or word in ('pt','pe','si','in','de','la','cu','nu','ca','al'))) as prose from w""".replace("\\\\", "\\"), "doc_lines")
def text_is_prose(spark, sf):
    t = D.doc_lines(spark, sf).select(F.explode(F.split("line", " ")).alias("token")).distinct()
    return t.select("token", L.is_prose(F.col("token")).alias("prose"))


@query()
def text_wrap_math(spark, sf):
    return D.math_lines(spark, sf).select("page_id", "idx", L.wrap_math(F.replace("text", F.lit("$"), F.lit(""))).alias("text"))


@query(r"select page_id, idx, regexp_extract(text, '^(\s*(?:Subiectul\s+(?:[IVX]+|[0-9]+)\b|[0-9]{1,2}\)|[a-hA-H]\)|[IVX]+\.)\s*)', 1) as label from math_lines", "math_lines")
def text_label(spark, sf):
    return D.math_lines(spark, sf).select("page_id", "idx", L.label_of(F.col("text")).alias("label"))


@query("select doc_id, translate(lower(text), 'ăâîșțşţ', 'aaistst') as word from documents")
def text_plain(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", L.plain(F.col("text")).alias("word"))


@query("select doc_id, trim(substr(text, 21 - 18, 18 + 10 + 18), ' ') as context from documents")
def text_snippet(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", L.snippet(F.col("text"), F.lit(20), F.lit(30)).alias("context"))


# ---------------------------------------------------------------- context and rules

_CALLS = r"(select page_id, idx, unnest(regexp_extract_all(text, '([A-Z])\((-?)([A-Za-z0-9]+)\)', 1)) as name, unnest(regexp_extract_all(text, '([A-Z])\((-?)([A-Za-z0-9]+)\)', 3)) as arg from math_lines)"


@query(rf"""with c as {_CALLS}, a as (select page_id, string_agg(distinct name || ':' || arg, ',' order by name || ':' || arg) calls from c group by 1), f as (select page_id, bool_or(regexp_matches(text, '\\lim|\\to|asimpt|\\infty')) calculus, bool_or(contains(text, '\infty') or contains(text, 'asimpt')) asymptotes, bool_or(contains(text, 'orizontal')) at_infinity,
    coalesce(string_agg(distinct nullif(regexp_extract(text, '\(([0-9])\)\$$', 1), ''), ','), '') refs from math_lines group by 1) select f.page_id, coalesce(a.calls, '') calls, calculus, asymptotes, at_infinity, refs from f left join a using (page_id)""", "math_lines")
def ctx_flags(spark, sf):
    c = rules.page_context(D.math_lines(spark, sf))
    return c.select("page_id", F.array_join("calls", ",").alias("calls"), "calculus", "asymptotes", "at_infinity", F.array_join("ref_labels", ",").alias("refs"))


@query(rf"with c as {_CALLS} select a.page_id, a.idx, a.name, a.arg, '5' as digit, exists (select 1 from c b where b.page_id = a.page_id and b.name = a.name and b.arg = '5') as evidence from c a where a.arg = 's'", "math_lines")
def ctx_evidence(spark, sf):
    return rules.call_evidence(D.math_lines(spark, sf))


def _ruled(spark, sf):
    df = D.math_lines(spark, sf).withColumn("decisions", F.create_map().cast("map<string,string>"))
    return df.join(rules.page_context(D.math_lines(spark, sf)), "page_id")


@query(r"select page_id, idx, replace(replace(text, '≥', '\geq '), '∞', '\infty ') as text, contains(text, '≥') or contains(text, '∞') as noted from math_lines", "math_lines")
def rule_unicode(spark, sf):
    df = _ruled(spark, sf).withColumn("s", rules.run_rules(rules.start(F.col("text")), [rules.unicode_rule]))
    return df.select("page_id", "idx", "s.text", (F.size("s.issues") > 0).alias("noted"))


def _rule(spark, sf, *kinds):
    steps = [r for r in (*rules.RULES, *rules.LONE) if getattr(r, "kind", "") in kinds]
    df = rules.in_math(_ruled(spark, sf).withColumn("s", rules.start(F.col("text"))), steps)
    return df.select("page_id", "idx", "s.text", F.array_join(F.transform("s.issues", lambda i: F.concat_ws("/", i["kind"], i["chosen"], i["strength"])), ",").alias("noted"))


@query(r"select page_id, idx, regexp_replace(replace(text, '(=)', '\Leftrightarrow '), '=>', '\\Rightarrow ', 'g') as text, case when contains(text, '(=)') then 'arrow/⇔/weak' when contains(text, '=>') then 'arrow' else '' end as noted from math_lines", "math_lines")
def rule_arrows(spark, sf):
    return _rule(spark, sf, "arrow")


@query(r"select page_id, idx, regexp_replace(text, '= \\text\{\[illegible\]\} =', '=') as text, case when contains(text, '[illegible]') then 'scribble' else '' end as noted from math_lines", "math_lines")
def rule_scribble(spark, sf):
    return _rule(spark, sf, "scribble")


@query(r"select page_id, idx, replace(text, '$x o y', '$x \circ y') as text, case when contains(text, '$x o y') then 'circ/∘/weak' else '' end as noted from math_lines", "math_lines")
def rule_composition(spark, sf):
    return _rule(spark, sf, "circ")


@query(r"""with f as (select page_id, bool_or(regexp_matches(text, '\\lim|\\to|asimpt|\\infty')) calculus from math_lines group by 1)
    select page_id, idx, replace(text, 'e^n x', '\ln x') as text, case when contains(text, 'e^n x') then 'ln/ln/weak' else '' end as noted from math_lines join f using (page_id)""", "math_lines")
def rule_ln(spark, sf):
    return _rule(spark, sf, "ln")


@query(r"""with f as (select page_id, bool_or(contains(text, 'orizontal')) h, bool_or(contains(text, '\infty') or contains(text, 'asimpt')) a from math_lines group by 1)
    select page_id, idx, case when contains(text, '\lim') then replace(case when h then replace(text, '\to 0', '\to \infty') else text end, '{0} =', '{\infty} =') else text end as text,
    case when contains(text, '\lim') then case when h then 'infinity/∞/weak' else 'infinity/∞/strong' end else '' end as noted from math_lines join f using (page_id)""", "math_lines")
def rule_infinity(spark, sf):
    return _rule(spark, sf, "infinity")


@query(r"select page_id, idx, replace(text, '$y = l', '$y = 1') as text, case when contains(text, '$y = l') then 'digit_one/1/strong' else '' end as noted from math_lines", "math_lines")
def rule_lone_one(spark, sf):
    return _rule(spark, sf, "digit_one")


@query(rf"""with c as {_CALLS} select page_id, idx, case when contains(text, '$A(s)') and exists (select 1 from c where c.page_id = m.page_id and c.arg = '5') then replace(text, 'A(s)', 'A(5)') else text end as text,
    case when contains(text, '$A(s)') then case when exists (select 1 from c where c.page_id = m.page_id and c.arg = '5') then 'strong' else 'flag' end else '' end as noted from math_lines m""", "math_lines")
def rule_digit_argument(spark, sf):
    df = _ruled(spark, sf).withColumn("s", rules.start(F.col("text")))
    df = rules.in_math(df, [rules.argument_rule])
    return df.select("page_id", "idx", "s.text", F.array_join(F.transform("s.issues", lambda i: i["strength"]), ",").alias("noted"))


@query(r"select page_id, idx, case when regexp_matches(text, '^\$\\frac\{[0-9]+\}\{2\$$') then '1 unclosed ''{''' else '' end as errors from math_lines", "math_lines")
def rule_structural(spark, sf):
    return D.math_lines(spark, sf).select("page_id", "idx", F.array_join(L.structural_errors(F.col("text")), "; ").alias("errors"))


@query(r"select page_id, idx, case when contains(text, 'pmatrix') then 'pmatrix with a single row: possibly a flattened matrix' else '' end as errors from math_lines", "math_lines")
def rule_matrix_shape(spark, sf):
    return D.math_lines(spark, sf).select("page_id", "idx", F.array_join(L.matrix_errors(F.col("text")), "; ").alias("errors"))


_VERIFIED = r"""c as (select page_id, bool_or(contains(text, 'A(5)')) five from math_lines group by 1),
    v as (select m.*, case when contains(text, '\frac{') and contains(text, '{2$') then 'grey' when contains(text, '$A(s)') or contains(text, '(=)') or contains(text, 'pmatrix') or contains(text, '\lim') or contains(text, 'e^n x') or contains(text, '$x o y') or contains(text, '[illegible]') or contains(text, 'y = l') then 'yellow' else 'green' end status,
        case when contains(text, '$A(s)') and not five then 0 when contains(text, 'pmatrix') then 0 else 1 end own from math_lines m join c using (page_id))"""


@query(f"with {_VERIFIED} select page_id, idx, status from v", "math_lines")
def rule_status(spark, sf):
    return rules.verify(D.math_lines(spark, sf)).select("page_id", "idx", "status")


@query()
def verify_page(spark, sf):
    v = rules.verify(D.math_lines(spark, sf))
    return v.select("page_id", "idx", "latex", "status", F.array_join(F.transform("issues", lambda i: F.concat_ws("/", i["kind"], i["key"], i["chosen"], i["strength"])), ",").alias("issues"))


@query("with t as (select page_id, list_sort(list(p % 4 order by idx)) k from base group by 1), u as (select page_id, unnest(k) kind from t), c as (select page_id, kind, count(*) n from u group by 1, 2) select page_id, string_agg('k' || kind || case when n > 1 then ' (x' || n || ')' else '' end, ',' order by kind) as issues from c group by 1", "base")
def rule_dedupe(spark, sf):
    kinds = F.array_sort(F.collect_list((F.col("p") % 4).cast("int")))
    rows = D.base(spark, sf).groupBy("page_id").agg(kinds.alias("k"))
    marks = F.transform("k", lambda k: rules.issue("test", F.concat(F.lit("k"), k.cast("string")), F.lit(False)).cast(rules.ISSUE))
    return rows.select("page_id", F.array_join(F.transform(rules.dedupe(marks), lambda i: i["message"]), ",").alias("issues"))


@query("select doc_id, (contains(replace(replace(text, ' ', ''), chr(10), ''), 'thethetheand'))::int + (contains(replace(replace(text, ' ', ''), chr(10), ''), 'andtheoftheth'))::int >= 2 or contains(replace(replace(text, ' ', ''), chr(10), ''), 'Thntble') as echo from documents")
def rule_prompt_echo(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", rules.echoes_prompt(F.col("text"), ["the the the and", "and the of the th", "short"], "Thnt ble").alias("echo"))


@query(f"with {_VERIFIED} select page_id, count(*) as lines, count_if(status = 'green') as green, count_if(status = 'yellow') as yellow, count_if(status = 'grey') as grey from v group by 1", "math_lines")
def page_status_counts(spark, sf):
    return pages.page_counts(rules.verify(D.math_lines(spark, sf))).select("page_id", "lines", "green", "yellow", "grey")


@query("select page_id, count_if(idx % 3 = 0) as failed, bool_and(idx % 3 = 0) as all_failed from math_lines group by 1", "math_lines")
def page_failures(spark, sf):
    lines = D.math_lines(spark, sf).withColumn("error", F.when(F.col("idx") % 3 == 0, "timeout"))
    return pages.page_counts(rules.verify(lines)).select("page_id", "failed", "all_failed")


@query()
def page_response(spark, sf):
    return pages.response(rules.verify(D.math_lines(spark, sf)))


# ---------------------------------------------------------------- second pass


@query(f"with {_VERIFIED} select page_id, idx from v where status = 'grey' or contains(text, 'pmatrix')", "math_lines")
def reask_targets(spark, sf):
    return reask.targets(rules.verify(D.math_lines(spark, sf))).select("page_id", "idx")


@query()
def reask_first_k(spark, sf):
    q = reask.questions(rules.verify(D.math_lines(spark, sf)), 1)
    return q.select("page_id", "idx", "seq", F.col("issue.key").alias("key"), F.array_join(F.array_sort(F.map_keys("options")), ",").alias("options"))


@query("select event_id, case event_id % 8 when 0 then 'B' when 1 then 'A' when 2 then 'A' when 3 then 'B' when 4 then 'A' else null end as option from events")
def reask_match_option(spark, sf):
    texts = ["B: yes", "(A)", "answer is a", "⇒", " A. ", "A small circle", "no idea", ""]
    answer = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("event_id") % 8).cast("int"))
    options = F.create_map(F.lit("A"), F.lit("⇔"), F.lit("B"), F.lit("⇒"))
    return D.table(spark, sf, "events").select("event_id", reask.match_option(answer, options).alias("option"))


@query("""with e as (select event_id, event_id % 3 as st, case event_id % 4 when 0 then '⇔' when 1 then '⇒' when 2 then '=' end as d, case when event_id % 5 < 3 then 'arrow' else 'circ' end as kind from events)
    select event_id, d is not null and (coalesce(d, '') = '⇔' or st = 0 or (kind = 'arrow' and d in ('⇔', '⇒'))) as accepted from e""")
def reask_judge(spark, sf):
    i = F.col("event_id")
    strength = F.when(i % 3 == 0, "flag").when(i % 3 == 1, "weak").otherwise("strong")
    decision = F.when(i % 4 == 0, "⇔").when(i % 4 == 1, "⇒").when(i % 4 == 2, "=")
    return D.table(spark, sf, "events").select("event_id", reask.accepted(F.when(i % 5 < 3, "arrow").otherwise("circ"), strength, F.lit("⇔"), decision).alias("accepted"))


@query("with e as (select event_id, event_id % 3 a, event_id % 4 b, event_id % 5 c, event_id % 7 d from events) select event_id, a < b or (a = b and c < d) as better from e")
def reask_better(spark, sf):
    i = F.col("event_id")
    name = lambda x: F.when(x == 0, "green").when(x == 1, "yellow").when(x == 2, "grey").otherwise("none")
    return D.table(spark, sf, "events").select("event_id", reask.better(name(i % 3), i % 5, name(i % 4), i % 7).alias("better"))


@query("select event_type as family, count(*) as asked, count_if(value > 10) as accepted from events group by 1")
def reask_families(spark, sf):
    e = D.table(spark, sf, "events").select(F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("key"), (F.col("value") > 10).alias("accepted"))
    return reask.families(e)


@query("select doc_id, 'line:' || substr(sha1(encode(text)), 1, 12) || ':' || lang as key from documents")
def reask_call_key(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", reask.call_key(F.lit("line"), F.col("text").cast("binary"), F.col("lang")).alias("key"))


@query("with c as (select distinct user_id from events) select cast(user_id as varchar) as key, case when user_id % 2 = 0 then 'cached' else 'asked ' || user_id end as answer from c")
def reask_cached_calls(spark, sf):
    calls = D.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"))
    cache = calls.where("cast(key as bigint) % 2 = 0").distinct().withColumn("answer", F.lit("cached"))
    return reask.cached_calls(calls, cache, lambda batch: "asked " + batch["key"]).select("key", "answer")


# ---------------------------------------------------------------- model calls


@query("select doc_id, cast(greatest(64, least(4096, 1024 - floor((300 + case when n_chars <= 400 then length(text) else 0 end) / 3) - 288)) as int) as budget from documents")
def model_budget(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", L.retry_budget(F.lit(300), F.col("text")).alias("budget"))


@query("""with t as (select doc_id, regexp_replace(text, '\\s+', '', 'g') c from documents), s as (select doc_id, c, size, unnest(range(0, length(c) - size + 1, greatest(1, length(c) // 20))) st from t, (select unnest(range(1, 13)) size) where size <= length(c)),
    k as (select doc_id, size, length(c) n, (length(c) - length(replace(c, substr(c, st + 1, size), ''))) / size as cnt from s) select t.doc_id, length(any_value(t.c)) = 0 or coalesce(bool_or(cnt * size > 0.5 * n and cnt >= 12), false) as degenerate from t left join k using (doc_id) group by 1""".replace("\\\\", "\\"))
def model_degenerate(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", L.is_degenerate(F.col("text")).alias("degenerate"))


@query("""with t as (select doc_id, idx, trim(regexp_replace(trim(line, ' ' || chr(10)), '\\s+', ' ', 'g'), ' ."''') as t from doc_lines)
    select doc_id, idx, case when t = '' or length(t) > 100 or regexp_matches(t, '[\\\\${}&^_]|begin|matrix') then '$\\text{[Figura geometrica]}$' else '$\\text{[Figura geometrica: ' || t || ']}$' end as line from t""".replace("\\\\", "\\"), "doc_lines")
def model_figure_placeholder(spark, sf):
    return D.doc_lines(spark, sf).select("doc_id", "idx", L.figure_placeholder(F.col("line")).alias("line"))


def _read_line(batch):
    if batch["image"].map(lambda b: b.endswith(b"7")).any():
        raise ValueError("cannot read")
    return batch["image"].map(lambda b: "read " + b.decode())


def _read_table(batch):
    return batch["image"].map(lambda b: "c|" * 30 if len(b) % 2 == 0 else "table " + b.decode())


def _describe(batch):
    return batch["image"].map(lambda b: "a figure, " + b.decode().replace("-", " "))


@query("""with b as (select page_id, box_id idx, case box_id % 3 when 0 then 'line' when 1 then 'table' else 'diagram' end kind, page_id || '-' || box_id im from boxes),
    r as (select *, kind = 'line' or (kind = 'table' and length(im) % 2 = 0) by_line, im like '%7' fails from b)
    select page_id, idx, kind, case when kind = 'diagram' then '$\\text{[Figura geometrica: a figure, ' || replace(im, '-', ' ') || ']}$' when not by_line then 'table ' || im when fails then '' else 'read ' || im end latex,
    case when by_line and fails then 'ValueError: cannot read' end error, case when kind = 'diagram' then 'data:image/png;base64,' || base64(encode(im)) end image_url from r""".replace("\\\\", "\\"), "boxes")
def model_transcribe_regions(spark, sf):
    kind = F.get(F.array(F.lit("line"), F.lit("table"), F.lit("diagram")), F.col("box_id") % 3)
    image = F.concat_ws("-", "page_id", "box_id").cast("binary")
    regions = D.boxes(spark, sf).select("page_id", F.col("box_id").alias("idx"), kind.alias("kind"), F.lit("image/png").alias("mime"), image.alias("image"))
    return calls.transcribe_regions(regions, {"line": _read_line, "table": _read_table, "diagram": _describe})


# ---------------------------------------------------------------- evaluation


@query(r"select page_id, idx, regexp_replace(replace(replace(replace(replace(replace(replace(text, '≥', '\ge'), '(=)', '⇔'), '=>', '⇒'), '\text{[illegible]}', '[illegible]'), '\text{l sau A(s)}', 'l sau A(s)'), '$', ''), '\s+', '', 'g') as norm from math_lines", "math_lines")
def eval_normalise(spark, sf):
    return D.math_lines(spark, sf).select("page_id", "idx", L.normalise(F.col("text")).alias("norm"))


@query(r"select page_id, idx, len(regexp_extract_all(text, '\\[A-Za-z]+|\\.|\S')) as n, list_aggregate(regexp_extract_all(text, '\\[A-Za-z]+|\\.|\S'), 'string_agg', ' ') as tokens from math_lines", "math_lines")
def eval_tokens(spark, sf):
    t = D.math_lines(spark, sf).select("page_id", "idx", L.tokens(F.col("text")).alias("t"))
    return t.select("page_id", "idx", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


#: The sign of a reading stands nowhere in a gold line, so each costs one change; what the reading lacks was cut from its start.
_ERRORS = "length({g}) - length(replace({p}, '¤', ''))"
_SOLID = r"n as (select *, regexp_replace(pred, '[$\s]+', '', 'g') p, regexp_replace(gold, '[$\s]+', '', 'g') g from pred_gold), d as (select *, " + _ERRORS.format(g="g", p="p") + " e from n)"


@query("select doc_id, idx, " + _ERRORS.format(g="gold", p="pred") + " as errors from pred_gold", "pred_gold")
def eval_char_distance(spark, sf):
    return D.pred_gold(spark, sf).select("doc_id", "idx", L.edit_distance(F.col("pred"), F.col("gold")).cast("long").alias("errors"))


@query(f"with {_SOLID} select doc_id, idx, e as char_errors, length(g) as gold_chars, e as token_errors, length(g) as gold_tokens, p = g as exact from d", "pred_gold")
def eval_token_distance(spark, sf):
    return evaluate.distances(D.pred_gold(spark, sf)).select("doc_id", "idx", "char_errors", "gold_chars", "token_errors", "gold_tokens", "exact")


@query(f"""with {_SOLID} select crop_id, verified, count(*) regions, cast(sum(e) as bigint) char_errors, cast(sum(length(g)) as bigint) gold_chars, cast(sum(e) as bigint) token_errors, cast(sum(length(g)) as bigint) gold_tokens, count_if(p = g) exact, sum(e) / greatest(1, sum(length(g))) cer, sum(e) / greatest(1, sum(length(g))) ter, cast(grouping(crop_id, verified) as bigint) grain
    from d group by grouping sets ((), (crop_id), (verified))""", "pred_gold")
def eval_totals(spark, sf):
    return evaluate.totals(evaluate.distances(D.pred_gold(spark, sf)), "crop_id", "verified")


@query("""with r as (select page_id, idx region_id from base), m as (select page_id, idx region_id, max(case q % 4 when 0 then 0 when 1 then 1 when 2 then 2 else 3 end) k from base where p % 3 <> 0 group by 1, 2)
    select r.page_id, r.region_id, case k when 0 then 'green' when 1 then 'yellow' when 2 then 'grey' when 3 then 'none' else 'unmatched' end as status from r left join m using (page_id, region_id)""", "base")
def eval_worst_status(spark, sf):
    b = D.base(spark, sf).withColumnRenamed("idx", "region_id")
    name = F.when(F.col("q") % 4 == 0, "green").when(F.col("q") % 4 == 1, "yellow").when(F.col("q") % 4 == 2, "grey")
    return evaluate.worst_status(b.select("page_id", "region_id"), b.where("p % 3 <> 0").select("page_id", "region_id", name.alias("status")))


@query("select doc_id, idx, length(gold) % 17 as before, length(gold) % 5 as after, length(gold) % 17 - length(gold) % 5 as gain from pred_gold where gain <> 0 order by gain desc, doc_id, idx limit 20", "pred_gold")
def eval_topn(spark, sf):
    n = F.length("gold").cast("long")
    rows = D.pred_gold(spark, sf).select("doc_id", "idx", (n % 17).alias("before"), (n % 5).alias("after"))
    return evaluate.most_changed(rows, 20, "before", "after", "doc_id", "idx")


VARIANTS = {"raw": ("raw", None), "verified": ("verified", "status"), "reask": ("reasked", "status_after")}
_SCORED = r"""v as (select crop_id, gold, 'raw' variant, raw pred, null status from readings union all select crop_id, gold, 'verified', fixed, coalesce(status, 'unmatched') from readings union all select crop_id, gold, 'reask', reasked, coalesce(status_after, 'unmatched') from readings),
    n as (select *, regexp_replace(pred, '[$\s]+', '', 'g') p, regexp_replace(gold, '[$\s]+', '', 'g') g from v), d as (select *, """ + _ERRORS.format(g="g", p="p") + " e from n)"
_RATES = "count(*) regions, cast(sum(e) as bigint) char_errors, cast(sum(length(g)) as bigint) gold_chars, cast(sum(e) as bigint) token_errors, cast(sum(length(g)) as bigint) gold_tokens, count_if(p = g) exact, sum(e) / greatest(1, sum(length(g))) cer, sum(e) / greatest(1, sum(length(g))) ter"


@query(f"""with {_SCORED} select 'all' as grain, variant, null as status, null as crop_id, {_RATES} from d group by variant union all select 'status', variant, status, null, {_RATES} from d where status is not null group by variant, status
    union all select 'by', variant, null, crop_id, {_RATES} from d group by variant, crop_id""", "readings")
def eval_variants(spark, sf):
    return evaluate.variant_totals(evaluate.by_variant(D.readings(spark, sf), VARIANTS, "crop_id"), "crop_id")


@query(f"""with {_SCORED}, c as (select crop_id, variant, count(*) n, sum(e) / greatest(1, sum(length(g))) cer from d group by 1, 2), a as (select crop_id, count(*) reask_calls, count_if(status_after = 'green') reask_accepted from readings where status <> 'green' group by 1)
    select crop_id, max(n) regions, max(cer) filter (where variant = 'raw') raw_cer, max(cer) filter (where variant = 'verified') verified_cer, max(cer) filter (where variant = 'reask') reask_cer, coalesce(any_value(reask_calls), 0) reask_calls, coalesce(any_value(reask_accepted), 0) reask_accepted from c left join a using (crop_id) group by 1""", "readings")
def eval_crops(spark, sf):
    rows = D.readings(spark, sf)
    events = rows.where("status <> 'green'").select("crop_id", (F.col("status_after") == "green").alias("accepted"))
    return evaluate.crop_rows(evaluate.variant_totals(evaluate.by_variant(rows, VARIANTS, "crop_id"), "crop_id"), "crop_id", list(VARIANTS), events=events)


_CHANGED = r"""n as (select *, regexp_replace(fixed, '[$\s]+', '', 'g') p, regexp_replace(reasked, '[$\s]+', '', 'g') r, regexp_replace(gold, '[$\s]+', '', 'g') g from readings),
    d as (select doc_id, idx, """ + _ERRORS.format(g="g", p="p") + " before_errors, " + _ERRORS.format(g="g", p="r") + " after_errors from n where p <> r)"


@query(f"with {_CHANGED} select doc_id, idx, before_errors, after_errors, before_errors - after_errors as gain from d", "readings")
def eval_changed_regions(spark, sf):
    return evaluate.changed_regions(D.readings(spark, sf), "verified", "reasked", "doc_id", "idx").select("doc_id", "idx", "before_errors", "after_errors", "gain")


@query(f"with {_CHANGED} select case when before_errors > after_errors then 'improved' when before_errors < after_errors then 'worse' else 'same' end direction, count(*) regions, cast(sum(before_errors - after_errors) as bigint) gain from d group by 1", "readings")
def eval_movement(spark, sf):
    return evaluate.movement(evaluate.changed_regions(D.readings(spark, sf), "verified", "reasked", "doc_id", "idx"))
