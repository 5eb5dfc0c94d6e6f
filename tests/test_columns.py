"""Blocks split at gutters, against a plain recursive walk on random pages, and nested columns."""

import random

from inkstone.operators import columns

SCHEMA = "page_id long, box_id int, line_id int, x0 int, y0 int, x1 int, y1 int"


def runs(intervals):
    out = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def rows_of(marks):
    bands = runs([(m[2], m[4]) for m in marks])
    return [[m for m in marks if a <= m[2] <= b] for a, b in bands]


def real(rows, g):
    def counts(row):
        covered = sum(b - a for a, b in runs([(m[1], m[3]) for m in row]))
        width = max(m[3] for m in row) - min(m[1] for m in row)
        return max(m[4] for m in row) - min(m[2] for m in row) > 1.6 * g or covered / max(1, width) > 0.4

    return [r for r in rows if counts(r)] or rows


def same(left, right, g):
    left, right = real(left, g), real(right, g)
    ends = lambda r: (min(m[2] for m in r), max(m[4] for m in r))
    if len(left) != len(right):
        return False
    return all(min(a[1], b[1]) - max(a[0], b[0]) > 0.5 * min(a[1] - a[0], b[1] - b[0]) for a, b in zip(map(ends, left), map(ends, right)))


def walk(marks, path, g):
    x0, x1 = min(m[1] for m in marks), max(m[3] for m in marks)
    gaps = runs([(m[1], m[3]) for m in marks])
    fit = [(a[1], b[0]) for a, b in zip(gaps, gaps[1:]) if b[0] - a[1] >= int(2.5 * g) and a[1] - x0 >= int(3.5 * g) and x1 - b[0] >= int(3.5 * g)]
    if max(m[4] for m in marks) - min(m[2] for m in marks) >= 1.8 * g and fit:
        start, end = max(fit, key=lambda f: (f[1] - f[0], -f[0]))
        sides = [[m for m in marks if ((m[1] + m[3]) / 2 >= (start + end) / 2) == bool(s)] for s in (0, 1)]
        rows = [rows_of(s) for s in sides]
        if not same(*rows, g):
            return {k: v for s in (0, 1) for i, r in enumerate(rows[s]) for k, v in walk(r, (*path, s, i), g).items()}
    return {m[0]: path for m in marks}


def got(spark, pages, g):
    df = spark.createDataFrame([(p, m[0], 0, *m[1:]) for p, marks in pages.items() for m in marks], SCHEMA)
    glyphs = spark.createDataFrame([(p, g) for p in pages], "page_id long, glyph double")
    out = {}
    for r in columns.split_columns(df, glyphs).collect():
        out.setdefault(r.page_id, {})[r.box_id] = tuple(r.path)
    return out, df, glyphs


def test_random_pages(spark):
    rng = random.Random(11)
    pages = {}
    for p in range(40):
        marks = []
        for i in range(rng.randint(1, 16)):
            x, y = rng.choice([0, 150, 300]) + rng.randint(0, 50), rng.randint(0, 120)
            marks.append((i, x, y, x + rng.randint(5, 50), y + rng.randint(4, 24)))
        pages[p] = marks
    found, *_ = got(spark, pages, 10.0)
    assert found == {p: walk(marks, (0,), 10.0) for p, marks in pages.items()}
    assert any(len(path) > 1 for page in found.values() for path in page.values())


def test_nested_columns_and_a_matrix(spark):
    """1: a tall mark beside a block that is itself a tall mark beside two lines; 2: two columns of the same rows; 3: one mark."""
    nested = [(0, 0, 0, 60, 100), (1, 100, 0, 160, 90), (2, 200, 0, 260, 12), (3, 200, 30, 260, 42), (4, 200, 60, 260, 72), (5, 100, 110, 260, 122)]
    matrix = [(0, 0, 0, 60, 12), (1, 0, 30, 60, 42), (2, 120, 0, 180, 12), (3, 120, 30, 180, 42)]
    found, df, glyphs = got(spark, {1: nested, 2: matrix, 3: [(0, 0, 0, 9, 9)]}, 10.0)
    assert found == {1: walk(nested, (0,), 10.0), 2: dict.fromkeys(range(4), (0,)), 3: {0: (0,)}}
    assert found[1][0] == (0, 0, 0) and found[1][5] == (0, 1, 1) and [found[1][i] for i in (1, 2, 3, 4)] == [(0, 1, 0, 0, 0), (0, 1, 0, 1, 0), (0, 1, 0, 1, 1), (0, 1, 0, 1, 2)]
    units = [(r.position, r.path, r.n_boxes) for r in columns.reading_units(df, glyphs).where("page_id = 1").orderBy("position").collect()]
    assert units == [(1, "0.0.0", 1), (2, "0.1.0.0.0", 1), (3, "0.1.0.1.0", 1), (4, "0.1.0.1.1", 1), (5, "0.1.0.1.2", 1), (6, "0.1.1", 1)]


def test_a_round_is_one_shuffle(spark):
    marks = spark.createDataFrame([(1, 0, 0, 0, 5, 5, 10.0)], "page_id long, box_id int, x0 int, y0 int, x1 int, y1 int, glyph double").selectExpr("*", "array(0) as path")
    parted = columns.with_gutters(marks).selectExpr("*", "int(x0 + x1 >= 2 * middle) as side")
    plan = columns.with_same_rows(columns.banded(parted))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_marks_of_one_number_count_where_they_stand(spark):
    """Two marks of one number on both sides of a gutter: each counts in its own block."""
    marks = [(0, 0, 0, 60, 100), (1, 100, 0, 160, 12), (1, 100, 30, 160, 42), (0, 100, 60, 160, 72)]
    df = spark.createDataFrame([(1, m[0], 0, *m[1:]) for m in marks], SCHEMA)
    units = columns.reading_units(df, spark.createDataFrame([(1, 10.0)], "page_id long, glyph double")).orderBy("position").collect()
    assert [(r.path, r.n_boxes, r.y0, r.y1) for r in units] == [("0.0.0", 1, 0, 100), ("0.1.0", 1, 0, 12), ("0.1.1", 1, 30, 42), ("0.1.2", 1, 60, 72)]


def test_no_marks(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert columns.reading_units(empty, spark.createDataFrame([], "page_id long, glyph double")).count() == 0
