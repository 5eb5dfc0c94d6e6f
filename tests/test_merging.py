"""Merges, tables that take writing, bar pieces and fragments, against plain Python on random pages."""

import random

import pytest

from inkstone.operators import layout, merging

SCHEMA = "page_id long, box_id int, x0 int, y0 int, x1 int, y1 int, area long"
CORNERS = slice(1, 5)


def pages(seed, n_pages=25, most=14, wide=300, tall=200, w=(4, 90), h=(4, 40)):
    rng = random.Random(seed)
    out = {}
    for p in range(n_pages):
        boxes = []
        for i in range(rng.randint(1, most)):
            x, y = rng.randint(0, wide), rng.randint(0, tall)
            boxes.append((i, x, y, x + rng.randint(*w), y + rng.randint(*h), rng.randint(1, 900)))
        out[p] = boxes
    return out


def table(spark, rows):
    return spark.createDataFrame([(p, *b) for p, bs in rows.items() for b in bs], SCHEMA)


def glyphs(spark, n_pages=25):
    return spark.createDataFrame([(p, 12.0 + p % 3 * 4) for p in range(n_pages)], "page_id long, glyph double")


def glyph(p):
    return 12.0 + p % 3 * 4


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.page_id, set()).add((r.box_id, r.x0, r.y0, r.x1, r.y1, r.area))
    return out


def overlap(a0, a1, b0, b1):
    return min(a1, b1) - max(a0, b0)


def union(a, b):
    return (a[0], min(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), max(a[4], b[4]), a[5] + b[5])


def is_close(a, b, gap):
    ov = overlap(a[2], a[4], b[2], b[4])
    return overlap(a[1], a[3], b[1], b[3]) > 0 and (-ov < gap if gap is not None else ov > 0.5 * min(a[4] - a[2], b[4] - b[2]))


def is_row(a, b, g):
    return -overlap(a[1], a[3], b[1], b[3]) < 2 * g and overlap(a[2], a[4], b[2], b[4]) > 0.5 * min(a[4] - a[2], b[4] - b[2])


def contracted(boxes, test):
    """Connected groups of the graph become their unions; None if there is no edge."""
    group = list(range(len(boxes)))
    edges = [(i, j) for i in range(len(boxes)) for j in range(i) if test(boxes[i], boxes[j])]
    for i, j in edges:
        group = [group[j] if x == group[i] else x for x in group]
    if not edges:
        return None
    out = {}
    for b, k in sorted(zip(boxes, group, strict=True)):
        out[k] = union(out[k], b) if k in out else b
    return list(out.values())


def settled(boxes, tests):
    while True:
        changed = False
        for test in tests:
            while (after := contracted(boxes, test)) is not None:
                boxes, changed = after, True
        if not changed:
            return set(boxes)


@pytest.mark.parametrize("gap", [None, 6])
def test_merges_against_plain_python(spark, gap):
    rows = pages(1)
    shuffled = {p: random.Random(p).sample(bs, len(bs)) for p, bs in rows.items()}
    assert collected(merging.merge_close(table(spark, shuffled), gap)) == {p: settled(bs, [lambda a, b: is_close(a, b, gap)]) for p, bs in rows.items()}
    both = merging.merge_boxes(table(spark, rows), glyphs(spark), gap)
    assert collected(both) == {p: settled(bs, [lambda a, b: is_close(a, b, gap), lambda a, b, g=glyph(p): is_row(a, b, g)]) for p, bs in rows.items()}
    assert {r.page_id: r.n for r in both.groupBy("page_id").agg({"n_boxes": "sum"}).withColumnRenamed("sum(n_boxes)", "n").collect()} == {p: len(bs) for p, bs in rows.items()}


def test_row_merges(spark):
    rows = pages(2)
    assert collected(merging.merge_rows(table(spark, rows), glyphs(spark))) == {p: settled(bs, [lambda a, b, g=glyph(p): is_row(a, b, g)]) for p, bs in rows.items()}


def test_a_union_meets_boxes_that_its_parts_do_not(spark):
    """Two boxes of a staircase reach a third one only together: a second round joins it."""
    rows = {1: [(5, 0, 0, 10, 20, 1), (7, 8, 12, 60, 30, 1), (9, 0, 29, 9, 45, 1)], 2: [(1, 0, 0, 5, 5, 1)]}
    got = collected(merging.merge_close(table(spark, rows), 2))
    assert got == {1: {(5, 0, 0, 60, 45, 3)}, 2: {(1, 0, 0, 5, 5, 1)}}
    assert collected(merging.merge_boxes(table(spark, {}), glyphs(spark), 2)) == {}


# ---------------------------------------------------------------- tables


def plain_tables(boxes, tables, g):
    """Rounds: what lies inside, then what is in reach of the tables as they were when the round began."""
    now, owner = {t[0]: t for t in tables}, {}
    shared = lambda t, b: max(0, overlap(t[1], t[3], b[1], b[3])) * max(0, overlap(t[2], t[4], b[2], b[4]))
    size = lambda b: (b[3] - b[1]) * (b[4] - b[2])

    def inside(t, b):
        cx, cy = (b[1] + b[3]) / 2, (b[2] + b[4]) / 2
        return t[1] - 0.3 * g <= cx <= t[3] + 0.3 * g and t[2] - 0.8 * g <= cy <= t[4] + 0.3 * g or shared(t, b) >= 0.6 * size(b)

    def reach(t, b):
        row = t[2] <= (b[2] + b[4]) / 2 <= t[4] and b[4] - b[2] <= 2 * g
        return shared(t, b) >= 0.6 * size(b) or row and (t[1] <= b[1] < t[3] or b[3] - b[1] <= 3 * g and max(b[1] - t[3], t[1] - b[3]) <= 2.5 * g)

    test = inside
    while True:
        new = {b[0]: min(ks) for b in boxes if b[0] not in owner and (ks := [k for k, t in now.items() if test(t, b)])}
        owner |= new
        for b in boxes:
            if b[0] in new:
                now[new[b[0]]] = union(now[new[b[0]]], b)
        if not new and test is reach:
            return set(now.values()), owner
        test = reach


def test_tables_take_writing_in_reach(spark):
    rng = random.Random(4)
    rows = pages(3, most=18, w=(3, 40), h=(4, 25))
    tables = {p: [(k, x, y, x + rng.randint(30, 90), y + rng.randint(20, 60), 5) for k in range(rng.randint(0, 3)) for x, y in [(rng.randint(0, 250), rng.randint(0, 150))]] for p in rows}
    named = table(spark, tables).withColumnRenamed("box_id", "table_id")
    grown, owners = merging.table_writing(table(spark, rows), named, glyphs(spark))
    want = {p: plain_tables(rows[p], tables[p], glyph(p)) for p in rows}
    assert collected(grown.withColumnRenamed("table_id", "box_id")) == {p: t for p, (t, _) in want.items() if t}
    assert {(r.page_id, r.box_id): r.table_id for r in owners.collect()} == {(p, b[0]): want[p][1].get(b[0]) for p in rows for b in rows[p]}


def test_a_chain_of_boxes_and_two_tables(spark):
    """A table takes a chain of small boxes one after another; a box in reach of two tables goes to the first."""
    chain = [(i, 40 + 20 * i, 10, 45 + 20 * i, 18, 1) for i in range(6)]
    rows = {0: [*chain, (50, 400, 10, 405, 18, 1), (51, 600, 100, 620, 110, 1)]}
    tables = {0: [(2, 410, 0, 440, 40, 1), (1, 0, 0, 40, 40, 1), (0, 350, 0, 390, 40, 1)]}
    grown, owners = merging.table_writing(table(spark, rows), table(spark, tables).withColumnRenamed("box_id", "table_id"), glyphs(spark))
    assert {r.box_id: r.table_id for r in owners.collect()} == {**dict.fromkeys(range(6), 1), 50: 0, 51: None}
    assert {r.table_id: r.x1 for r in grown.collect()} == {1: 145, 0: 405, 2: 440}


# ---------------------------------------------------------------- folds


def is_bar(w, h, g):
    return w >= 0.8 * g and h <= 0.45 * g and w >= 3 * h


def test_bar_pieces(spark):
    rng = random.Random(6)
    rows = {p: [(i, x, y, x + rng.randint(2, 40), y + rng.randint(1, 7), 3) for i in range(rng.randint(1, 16)) for x, y in [(rng.randint(0, 120), rng.choice([10, 11, 12, 13, 40]))]] for p in range(25)}

    def plain(boxes, g):
        w, h = (lambda b: b[3] - b[1]), (lambda b: b[4] - b[2])
        flat = sorted((b for b in boxes if is_bar(w(b), h(b), g) or h(b) <= 0.3 * g and w(b) >= 0.5 * g), key=lambda b: (b[1], b[0]))
        joined = []
        for b in flat:
            for k, a in enumerate(joined):
                u = union(a, b)
                if b[1] - a[3] <= 0.5 * g and abs(a[2] + a[4] - b[2] - b[4]) / 2 <= max(2, 0.1 * g) and is_bar(w(u), h(u), g):
                    joined[k] = u
                    break
            else:
                joined.append(b)
        return {*joined, *(b for b in boxes if b not in flat)}

    got = collected(merging.join_bar_pieces(table(spark, rows), glyphs(spark)))
    assert got == {p: plain(bs, glyph(p)) for p, bs in rows.items()}
    assert any(len(got[p]) < len(rows[p]) for p in rows)


def test_fragments_go_to_the_nearest_line(spark):
    lines, pieces = pages(7, most=6, w=(60, 200), h=(15, 30)), pages(8, most=9, w=(2, 12), h=(2, 8))
    pieces.pop(3)

    def plain(lines, pieces, g):
        lines = list(lines)
        for f in pieces:
            best, best_d = None, g
            for k, ln in enumerate(lines):
                d = max(0, ln[2] - f[4], f[2] - ln[4])
                if overlap(ln[1], ln[3], f[1] - 3 * g, f[3] + 3 * g) > 0 and d < best_d:
                    best, best_d = k, d
            if best is not None:
                lines[best] = union(lines[best], f)
        return set(lines)

    got = collected(merging.attach_fragments(table(spark, lines), table(spark, pieces), glyphs(spark)))
    assert got == {p: plain(bs, pieces.get(p, []), glyph(p)) for p, bs in lines.items()}


def test_loose_marks_join_the_line_they_touch(spark):
    rng = random.Random(9)
    lines = {p: [(i, x, y, x + w, y + rng.randint(8, 24), rng.randint(20, 500)) for i in range(rng.randint(2, 9)) for x, y, w in [(rng.randint(0, 80), rng.randint(0, 110), rng.choice([10, 25, 60, 150, 220]))]] for p in range(60)}
    marks = pages(10, n_pages=60, most=12, wide=250, tall=120, w=(3, 30), h=(4, 12))

    def coverage(box, blobs):
        covered = [False] * max(1, box[3] - box[1])
        for b in blobs:
            if box[1] <= (b[1] + b[3]) / 2 <= box[3] and box[2] <= (b[2] + b[4]) / 2 <= box[4]:
                for c in range(max(0, b[1] - box[1]), min(len(covered), max(0, b[3] - box[1]))):
                    covered[c] = True
        return sum(covered) / len(covered)

    def plain(lines, blobs, g):
        lines, changed, joins = list(lines), True, 0
        gap = lambda a, b: max(a[2] - b[4], b[2] - a[4])
        while changed:
            changed = False
            for f in sorted(lines, key=lambda c: c[3] - c[1]):
                if f[4] - f[2] > 1.6 * g or f[5] > 1.5 * g * g:
                    continue
                best, near = None, 0.5 * g if coverage(f, blobs) <= 0.4 else 0.0
                for ln in lines:
                    if ln is f or f[3] - f[1] > 0.6 * (ln[3] - ln[1]) or f[1] < ln[1] - g or f[3] > ln[3] + g or f[1] <= ln[1] + g:
                        continue
                    if gap(ln, f) <= near:
                        best, near = ln, gap(ln, f)
                if best is None:
                    continue
                below = best[2] >= (f[2] + f[4]) / 2
                other = [gap(ln, f) for ln in lines if ln is not f and ln is not best and overlap(ln[1], ln[3], f[1], f[3]) > 0 and (ln[4] <= best[2] if below else ln[2] >= best[4])]
                if other and min(other) < 0.5 * g:
                    continue
                lines = [ln for ln in lines if ln is not f and ln is not best] + [union(best, f)]
                changed, joins = True, joins + 1
                break
        return set(lines), joins

    got = collected(merging.absorb_fragments(table(spark, lines), table(spark, marks), glyphs(spark, 60)))
    want = {p: plain(bs, marks[p], glyph(p)) for p, bs in lines.items()}
    assert got == {p: x for p, (x, _) in want.items()}
    assert sum(n for _, n in want.values()) > 10


def test_components_of_pages_with_very_many_edges(spark, monkeypatch):
    """Pages over the bound on edges contract stars, the others are folded: both as one walk over all edges says."""
    rng = random.Random(9)
    edges = [(page, *sorted(rng.sample(range(30), 2))) for page in range(6) for _ in range(4 * page + 1)]
    first = {(page, box): box for page in range(6) for box in range(30)}
    for _ in range(30):
        for page, a, b in edges:
            first[page, a] = first[page, b] = min(first[page, a], first[page, b])
    boxes = spark.createDataFrame(list(first), "page_id long, box_id int")
    for bound in (2000, 10, 0):
        monkeypatch.setattr(layout, "MOST_EDGES", bound)
        got = layout.rows_of(boxes, spark.createDataFrame(edges, "page_id long, a_box_id int, b_box_id int"))
        assert {(r.page_id, r.box_id): r.row_id for r in got.collect()} == first


def test_components_of_pages_shuffle_by_page_alone(spark):
    """A page's edges travel once; rounds over the whole relation are for pages with very many edges."""
    boxes = spark.createDataFrame([(1, 5), (1, 7)], "page_id long, box_id int")
    plan = layout.rows_of(boxes, spark.createDataFrame([(1, 5, 7)], "page_id long, a_box_id int, b_box_id int"))._jdf.queryExecution().toString()
    assert "hashpartitioning(page_id" in plan and "box_id" not in "".join(x.split(")")[0] for x in plan.split("hashpartitioning(")[1:])
