"""Page operators: rules on examples, order-dependent folds against plain Python, plans, and the driver's entry."""

import random

import pytest
from pyspark.sql import functions as F

from inkstone.config import Settings
from inkstone.functions import latex as L
from inkstone.operators import evaluate, layout, pages, reask, rules
from inkstone.operators.components import connected_components
from tests.conftest import DATA


def one(spark, column, *values, types=None):
    df = spark.createDataFrame([values], types or [f"c{i}" for i in range(len(values))])
    return df.select(column.alias("x")).first()["x"]


def verify(spark, lines, **columns):
    """[(latex, status, issues)] of one page."""
    rows = [(1, i, t, columns.get("errors", {}).get(i), columns.get("kinds", {}).get(i, "line"), columns.get("decisions", {}).get(i, {})) for i, t in enumerate(lines)]
    df = spark.createDataFrame(rows, "page_id long, idx int, text string, error string, kind string, decisions map<string,string>")
    out = rules.verify(df, ["transcribe every line of the page", "use dollars around the math"], "I_2,A(x),det(A)").orderBy("idx").collect()
    return [(r.latex, r.status, r.issues) for r in out]


def test_evidence_decides_an_argument(spark):
    got = verify(spark, ["$A(5) = 1$", "$A(s) = 2$", "$B(s) = 3$"])
    assert got[1][0] == "$A(5) = 2$" and got[1][2][0].strength == "strong"
    assert got[2][0] == "$B(s) = 3$" and got[2][2][0].strength == "flag" and got[2][1] == "yellow"
    assert got[0][1] == "green"


def test_rules_in_order(spark):
    got = verify(spark, ["x ≥ 3", "$x (=) y => z$", "$x o y$", r"$\lim_{x \to 50} \frac{1}{x}$", r"$a = \text{[illegible]} = b$", "e^n x", "f' = 1"])
    texts = [g[0] for g in got]
    assert texts[0] == r"$x \geq 3$" and got[0][1] == "green"
    assert texts[1].split() == r"$x \Leftrightarrow y \Rightarrow z$".split() and got[1][1] == "yellow"
    assert texts[2] == r"$x \circ y$"
    assert r"\infty" in texts[3]
    assert texts[4] == "$a = b$"
    assert texts[5] == r"$\ln x$"


def test_answers_override_rules(spark):
    raw = ["$x (=) y$", "$x o y$"]
    kept = verify(spark, raw, decisions={0: {"arrow:(=)": "⇔"}, 1: {"o_vs_circ": "o"}})
    assert kept[0][1] == "green" and kept[0][2][0].resolved_by == "reask"
    assert kept[1][0] == "$x o y$" and not kept[1][2][0].fixed


def test_rules_touch_math_alone(spark):
    cases = [
        ("Fie o functie f", "Fie o functie f"), ("Ecuatia are o solutie reala $x = 1$", "Ecuatia are o solutie reala $x = 1$"), ("Deci l se simplifica", "Deci l se simplifica"),
        (r"$x = \text{l sau A(s)} + l$", r"$x = \text{l sau A(s)} + 1$"), ("$x = \ue000 + l$", "$x = \ue000 + 1$"), ("$x =) y$", r"$x \Rightarrow y$"), (r"$x \left(=\right) y$", r"$x \Leftrightarrow y$"),
        ("$x c=) y$", r"$x \Leftrightarrow y$"), (r"$\sin c = )$", r"$\sin \Leftrightarrow$"), ("$abc = )$", "$abc = )$"), (r"$A(\ell) = t$", "$A(1) = 1$"), (r"$\begin{array}{l} 2 \\ 3 \end{array}$", r"$\begin{array}{l} 2 \\ 3 \end{array}$"),
        (r"$\left[\begin{array}{cc} 1 & 2 \\ 3 & 4 \end{array}\right]$", r"$\begin{bmatrix} 1 & 2 \\ 3 & 4 \end{bmatrix}$"), (r"$x^{2}.I_{2} + 2.5$", r"$x^{2} \cdot I_{2} + 2.5$"), ("$e.g. x$", "$e.g. x$"),
        (r"$x = 2, A^{\alpha}$", r"$x = 2, \text{,,A''}$"), ("$x = A^2$", "$x = A^2$"), ("$3A^2$", "$3A^2$"), ("$√(a+b) ⁴$", r"$\sqrt{(a+b)} ^{4}$"), (r"\text{Subiectul} 3", "Subiectul 3"), (r"deci \alpha unde $x$", r"deci $\alpha$ unde $x$"),
    ]
    got = verify(spark, [line for line, _ in cases])
    assert [(line, g[0].split()) for (line, _), g in zip(cases, got, strict=True)] == [(line, latex.split()) for line, latex in cases]


def test_a_page_that_defines_t_keeps_it(spark):
    cases = [("$t = 2^x$", True), ("$2t + 1$", True), ("$f(t)$", True), (r"$t \geq 0$", True), ("$t^2$", True), ("notam asa", True), ("$t = y = x$", False), ("$x = t$", False)]
    df = spark.createDataFrame([(i, 0, line) for i, (line, _) in enumerate(cases)], "page_id long, idx int, text string")
    assert [r.t_is_variable for r in rules.page_context(df).orderBy("page_id").collect()] == [kept for _, kept in cases]


def test_statuses(spark):
    got = verify(spark, ["", "text only here", r"$\frac{1$", "x", r"$\text{[illegible]}$", "Transcribe every line of the page. transcribe every line of the page use dollars around the math", "$$a\n+ b$$"], errors={3: "timeout"}, kinds={1: "diagram"})
    assert [g[1] for g in got] == ["grey", "green", "grey", "grey", "grey", "grey", "green"]
    assert [g[2][0].kind for g in got[:4]] == ["empty", "diagram", "syntax", "vlm_error"]
    assert got[5][2][0].kind == "prompt_echo" and got[6][0] == "$$a + b$$"


def test_table_arrows(spark):
    table = r"$\begin{array}{cc} f'(x) & \downarrow \\ f(x) & \downarrow \end{array}$"
    got = verify(spark, [table, table], kinds={0: "table"})
    assert got[0][0].count(r"\searrow") == 1 and got[0][0].count(r"\downarrow") == 1
    assert got[1][0] == table


def test_equal_findings_are_counted(spark):
    got = verify(spark, [r"$\begin{pmatrix} 1 & 2 \end{pmatrix} + \begin{pmatrix} 3 & 4 \end{pmatrix}$"])
    assert [i.message for i in got[0][2]] == ["pmatrix with a single row: possibly a flattened matrix (x2)"]


@pytest.mark.parametrize(
    ("text", "segments", "left_open"),
    [("a $b$ c", [("text", "a "), ("$", "b"), ("text", " c")], None), ("$$x$$", [("$$", "x")], None), (r"5\$ $y", [("text", r"5\$ "), ("$", "y")], "$"), ("", [], None), ("$a$$b$", [("$", "a"), ("$", "b")], None)],
)
def test_segments(spark, text, segments, left_open):
    got = one(spark, L.split_segments(F.col("c0")), text)
    assert [(s.kind, s.content) for s in got.segments] == segments and got.open == left_open
    if left_open is None:
        assert one(spark, L.join_segments(L.split_segments(F.col("c0"))["segments"]), text) == text


@pytest.mark.parametrize(
    ("text", "wrapped"),
    [("a) x = 2 deci y = 3", "a) $x = 2$ deci $y = 3$"), ("Subiectul 2", "Subiectul 2"), ("only words here", "only words here"), (r"\frac{a b}{2} = 1", r"$\frac{a b}{2} = 1$"), (r"x = {a unde b}", r"$x = {a unde b}$")],
)
def test_wrapping(spark, text, wrapped):
    assert one(spark, L.wrap_math(F.col("c0")), text) == wrapped


@pytest.mark.parametrize(("a", "b", "same"), [(r"x \geq 2", "x≥2", True), (r"\left( x \right)", "(x)", True), ("x^{2}", "x^2", True), (r"\dfrac{1}{2}", r"\frac{1}{2}", True), ("a <=> b", r"a \iff b", True), ("x+1", "x-1", False), (r"a \\ -3", r"a -3", False)])
def test_normal_forms(spark, a, b, same):
    x = one(spark, F.struct(L.normalise(F.col("c0")).alias("a"), L.normalise(F.col("c1")).alias("b")), a, b)
    assert (x.a == x.b) is same


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[j - 1] + 1, row[j - 1] + (x != y)))
    return out


def test_token_distance(spark):
    rng = random.Random(1)
    pairs = [([rng.choice(["\\frac", "x", "é", "\\{"]) for _ in range(rng.randint(0, 9))], [rng.choice(["\\frac", "x", "é", "{"]) for _ in range(rng.randint(0, 9))]) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    got = [r.d for r in df.select("a", "b", L.token_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [plain_distance(a, b) for a, b in pairs]


def test_token_distance_of_very_many_tokens(spark):
    a = [chr(0x4E00 + i) for i in range(9000)]
    df = spark.createDataFrame([(a, a[:5] + ["\\x"] + a[6:8990])], "a array<string>, b array<string>")
    assert df.select(L.token_distance(F.col("a"), F.col("b"))).first()[0] == 11


@pytest.mark.parametrize(
    ("tex", "errors"),
    [(r"\begin{pmatrix} 1 \end{vmatrix}", [r"\end{vmatrix} without matching \begin"]), (r"\begin{a}\begin{b}\end{b}\end{a}", []), (r"\end{a}{", ["1 unclosed '{'", r"\end{a} without matching \begin"]), (r"\begin{a}\left(", [r"\begin{a} without \end", r"1 \left vs 0 \right"]), (r"\{}}", ["unmatched '}'", "unmatched '}'"][:2])],
)
def test_structure(spark, tex, errors):
    assert one(spark, L.structural_errors(F.col("c0")), tex) == errors


@pytest.mark.parametrize(("a", "b"), [("(\\begin{array}{c} 1 \\end{array})", "\\begin{pmatrix}1\\end{pmatrix}"), (r"\left| \begin{matrix}1\end{matrix} \right|", r"\begin{vmatrix}1\end{vmatrix}"), ("x =) y", "x ⇒ y"), ("( = )", r"\Leftrightarrow"), (r"x \text{ ,,A'' }", '"A "'.join(["x", ""])), (r"a\,b\quad", "ab"), (r"\operatorname{rang} A", "rangA"), ("ℝ²", r"\mathbb{R}^{2}"), (r"$\text{[Figura geometrica: x]}$ y", "y")])
def test_more_normal_forms(spark, a, b):
    x = one(spark, F.struct(L.normalise(F.col("c0")).alias("a"), L.normalise(F.col("c1")).alias("b")), a, b)
    assert x.a == x.b


@pytest.mark.parametrize(("token", "prose"), [("ex.", True), ("(d.e.", True), ("C.E.:", True), (":", True), ("", False), ("sin", False), ("si", True), ("x", False), ("(unde)", True), ("abc.)", True), ("functie,", True), ("a.b.c.d.", False), ("x1", False), ("până", True)])
def test_prose(spark, token, prose):
    assert one(spark, L.is_prose(F.col("c0")), token) is prose


@pytest.mark.parametrize(("text", "math"), [("a + 2", True), ("2)", True), ("f(x2)", True), ("f(x)", False), ("word - word", False), ("x ∈ A", True), ("2 ) (", False), ("a_b", True), ("", False), ("(a) 2", False)])
def test_mathematics(spark, text, math):
    assert one(spark, L.looks_math(F.col("c0")), text) is math


def test_rows_of_pages_with_very_many_boxes(spark):
    boxes = spark.createDataFrame([(1, 5), (1, 1005), (2, 5), (2, 2005)], "page_id long, box_id int")
    edges = spark.createDataFrame([(1, 1005, 5), (2, 2005, 5)], "page_id long, a_box_id int, b_box_id int")
    assert sorted(map(tuple, layout.rows_of(boxes, edges).collect())) == [(1, 5, 5), (1, 1005, 5), (2, 5, 5), (2, 2005, 5)]
    assert sorted(map(tuple, layout.rows_of(boxes, edges.limit(0)).collect())) == [(1, 5, 5), (1, 1005, 1005), (2, 5, 5), (2, 2005, 2005)]


@pytest.mark.parametrize(("text", "looped"), [("", True), ("c|" * 40, True), ("a normal line of text", False), ("ab" * 5, False), (r"\text{ } & " * 20, True)])
def test_degenerate(spark, text, looped):
    assert one(spark, L.is_degenerate(F.col("c0")), text) is looped


OPTIONS = {"A": "⇔", "B": "⇒", "C": "="}


@pytest.mark.parametrize(
    ("answer", "options", "expected"),
    [("B", OPTIONS, "B"), ("(b)", OPTIONS, "B"), ("B: implies", OPTIONS, "B"), ("Answer: C", OPTIONS, "C"), ("it is ⇒ here", OPTIONS, "B"), ("A small circle", OPTIONS, None), ("⇒ or =", OPTIONS, None), ("", OPTIONS, None), ("yes, there is", {"yes": "yes", "no": "no"}, "yes"), ("the digit 5", {"5": "5", "s": "s"}, "5"), ("5 or s", {"5": "5", "s": "s"}, "5"), ("maybe s or 5", {"5": "5", "s": "s"}, None), ("S", {"s": "s", "S": "S"}, "S"), (None, OPTIONS, None), ("B) ⇒", OPTIONS, "B"), ("a - equivalent", OPTIONS, "A"), ("The answer is (b), I think", OPTIONS, "B"), ("choice: c", OPTIONS, "C"), ("answer is unclear", OPTIONS, None), ("option D", OPTIONS, None), ("Before: ⇒", OPTIONS, "B")],
)
def test_match_option(spark, answer, options, expected):
    df = spark.createDataFrame([(answer, options)], "a string, o map<string,string>")
    assert df.select(reask.match_option(F.col("a"), F.col("o"))).first()[0] == expected


def test_second_pass(spark):
    lines = spark.createDataFrame([(1, 0, "$x (=) y$"), (1, 1, "$x o y$"), (2, 0, "$A(s) = 1$")], "page_id long, idx int, text string")
    asked = reask.questions(rules.verify(lines)).withColumn("key", F.concat_ws(":", "page_id", "idx", "seq"))
    cache = spark.createDataFrame([("1:0:0", "A")], "key string, answer string")
    answers = reask.cached_calls(asked.select("key"), cache, lambda b: b["key"].map({"1:1:0": "B, the letter", "2:0:0": "5"}))
    decided, events = reask.decisions(asked, answers)
    assert {(r.page_id, r.idx): r.decisions for r in decided.collect()} == {(1, 0): {"arrow:(=)": "⇔"}, (2, 0): {"s_vs_5:A(s)": "5"}}
    assert sorted((r.page_id, r.idx, r.accepted) for r in events.collect()) == [(1, 0, True), (1, 1, False), (2, 0, True)]
    again = rules.verify(lines.join(decided, ["page_id", "idx"], "left").withColumn("decisions", F.coalesce("decisions", F.create_map().cast("map<string,string>"))))
    assert {(r.page_id, r.idx): (r.latex, r.status) for r in again.collect()}[2, 0] == ("$A(5) = 1$", "green")


def test_questions_name_what_was_read(spark):
    lines = spark.createDataFrame([(1, 0, r"$x (=) y$"), (2, 0, r"$A(s) = 1$")], "page_id long, idx int, text string")
    asked = {r.page_id: r for r in reask.questions(rules.verify(lines)).collect()}
    assert "'(=)'" in asked[1].question and "$x" in asked[1].question and asked[1].question.endswith("A, B or C.")
    assert "A(s)" in asked[2].question and asked[2].question.endswith("5 or s.")
    ell = spark.range(1).select(reask.question_options(F.lit(r"ell_vs_1"), F.array(F.lit("1"), F.lit(r"\ell"))).alias("o"), reask.question_text(F.lit("ell_vs_1"), F.array(F.lit("1"), F.lit(r"\ell")), F.lit("x")).alias("q")).first()
    assert ell.o == {"1": "1", "l": r"\ell"} and ell.q.endswith("1 or l.")


def test_second_pass_end_to_end(spark):
    """A failed line is read again, a worse reading is refused, an answer decides a line; lines without an image stay."""
    rows = [(1, 0, None, "timeout"), (1, 1, r"$\begin{pmatrix}1 & 2\end{pmatrix}$", None), (1, 2, "$A(s) = 1$", None), (2, 0, "$A(s) = 1$", None)]
    lines = spark.createDataFrame(rows, "page_id long, idx int, text string, error string")
    images = spark.createDataFrame([(1, i, bytes([i])) for i in range(3)], "page_id long, idx int, image binary")
    final, events = reask.second_pass(lines, images, lambda b: b["idx"].map({0: "$x = 1$", 1: "$x = {$"}), lambda b: b["prompt"].map(lambda p: "5" if "A(s)" in p else None))
    got = {(r.page_id, r.idx): (r.latex, r.status) for r in final.collect()}
    assert got == {(1, 0): ("$x = 1$", "green"), (1, 1): (rows[1][2], "yellow"), (1, 2): ("$A(5) = 1$", "green"), (2, 0): ("$A(s) = 1$", "yellow")}
    seen = sorted((r.page_id, r.idx, r.event, r.accepted) for r in events.collect())
    assert seen == [(1, 0, "retranscribe", True), (1, 1, "retranscribe", False), (1, 2, "question", True)]


def test_second_pass_outlives_failing_calls_and_asks_nothing_twice(spark):
    rows = [(1, 0, None, "timeout"), (1, 1, None, "timeout"), (1, 2, "$A(s) = 1$", None), (2, 0, "$A(s) = 1$", None)]
    lines = spark.createDataFrame(rows, "page_id long, idx int, text string, error string")
    images = spark.createDataFrame([(p, i, bytes([p, i])) for p, i, _, _ in rows], "page_id long, idx int, image binary")

    def transcribe(batch):
        if (batch["idx"] == 1).any():
            raise RuntimeError("model gone")
        return batch["idx"].map({0: "$x = 1$"})

    def ask(batch):
        if (batch["page_id"] == 2).any():
            raise ValueError("no answer")
        return batch["prompt"].map(lambda p: "5")

    kept = []
    final, events = reask.second_pass(lines, images, transcribe, ask, remember=lambda df: kept.append(df.toPandas()))
    want = {(1, 0): ("$x = 1$", "green"), (1, 1): ("", "grey"), (1, 2): ("$A(5) = 1$", "green"), (2, 0): ("$A(s) = 1$", "yellow")}
    assert {(r.page_id, r.idx): (r.latex, r.status) for r in final.collect()} == want
    told = {(r.page_id, r.idx): (r.accepted, r.detail) for r in events.collect()}
    assert told[1, 0] == (True, "grey -> green") and told[1, 1] == (False, "failed: RuntimeError: model gone") and told[2, 0] == (False, "failed: ValueError: no answer")
    assert [len(x) for x in kept] == [1, 1]
    cache = spark.createDataFrame([tuple(r) for x in kept for r in x[["key", "answer"]].itertuples(index=False)], "key string, answer string")

    def never(batch):
        raise AssertionError("asked again")

    again, events = reask.second_pass(lines, images, never, never, cache=cache)
    assert {(r.page_id, r.idx): (r.latex, r.status) for r in again.collect()} == want
    assert sum(r.accepted for r in events.collect()) == 2


def test_regions_are_read_by_kind_and_fail_alone(spark):
    from inkstone.operators import calls

    seen = [(1, 0, "line", b"a"), (1, 1, "line", b"bad"), (1, 2, "table", b"t"), (1, 3, "table", b"loop"), (1, 4, "diagram", b"d"), (1, 5, "diagram", b"bad"), (1, 6, "note", b"n"), (2, 0, "line", b"a"), (2, 1, "table", b"bad loop")]
    regions = spark.createDataFrame([(p, i, k, "image/png", b) for p, i, k, b in seen], "page_id long, idx int, kind string, mime string, image binary").coalesce(1)

    def line(batch):
        if batch["image"].map(lambda b: b.startswith(b"bad")).any():
            raise OSError("down")
        return batch["image"].map(lambda b: "line " + b.decode())

    def diagram(batch):
        if (batch["image"] == b"bad").any():
            raise OSError("down")
        return batch["image"].map(lambda b: "a triangle.")

    readers = {"line": line, "table": lambda batch: batch["image"].map(lambda b: "|" * 40 if b.endswith(b"loop") else "a & b"), "diagram": diagram}
    got = {(r.page_id, r.idx): (r.latex, r.error, r.image_url) for r in calls.transcribe_regions(regions, readers).collect()}
    plain = r"$\text{[Figura geometrica]}$"
    assert got == {
        (1, 0): ("line a", None, None), (1, 1): ("", "OSError: down", None), (1, 2): ("a & b", None, None), (1, 3): ("line loop", None, None), (1, 4): (plain[:-3] + ": a triangle]}$", None, "data:image/png;base64,ZA=="),
        (1, 5): (plain, None, "data:image/png;base64,YmFk"), (1, 6): ("line n", None, None), (2, 0): ("line a", None, None), (2, 1): ("", "OSError: down", None),
    }
    assert calls.transcribe_regions(regions.where("false"), readers).collect() == []


def test_regions_without_lines_stay(spark):
    lines = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (1, 1, 2, 2, 4, 4)], "page_id long, line_id int, x int, y int, w int, h int")
    box = "struct<x:int,y:int,w:int,h:int>"
    regions = spark.createDataFrame([(1, 0, (0, 0, 20, 20)), (1, 1, (90, 90, 5, 5)), (2, 0, (0, 0, 5, 5))], f"page_id long, region_id int, bbox {box}")
    assert sorted(map(tuple, layout.lines_of_regions(lines, regions).collect())) == [(1, 0, [0, 1]), (1, 1, []), (2, 0, [])]


def test_merge(spark):
    df = spark.createDataFrame([(1, 1, "b \n\n c"), (1, 0, "```\na\n```"), (1, 2, " "), (2, 0, "")], "page_id long, idx int, latex string")
    assert {r.page_id: r.document for r in pages.merge_lines(df).collect()} == {1: "a\n\nb\n c", 2: ""}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3), (999, 999)]
    root = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_reading_order(spark):
    rng = random.Random(5)
    boxes = [(p, i, rng.randint(0, 500), y := rng.randint(0, 300), 0, y + rng.randint(10, 60), 1) for p in range(8) for i in range(12)]
    want = {}
    for p in range(8):
        rows = []
        for b in sorted((b for b in boxes if b[0] == p), key=lambda b: (b[3], b[1])):
            if rows and min(rows[-1][0][5], b[5]) - max(rows[-1][0][3], b[3]) > 0.5 * min(rows[-1][0][5] - rows[-1][0][3], b[5] - b[3]):
                rows[-1].append(b)
            else:
                rows.append([b])
        want[p] = [b[1] for row in rows for b in sorted(row, key=lambda b: (b[2], b[1]))]
    df = spark.createDataFrame(boxes, "page_id int, box_id int, x0 int, y0 int, x1 int, y1 int, area int")
    got = {p: [] for p in range(8)}
    for r in layout.reading_order(df).orderBy("page_id", "position").collect():
        got[r.page_id].append(r.box_id)
    assert got == want


def test_plans_have_no_cross_joins(spark):
    from inkstone.sources import derived

    boxes = derived.boxes(spark, f"{DATA}/sf0.001")
    for df in (layout.overlapping(boxes), layout.padded(boxes, 5, 10, 10), layout.bar_neighbours(boxes), layout.nearest(boxes, boxes)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_totals_count_unmatched_regions(spark):
    rows = spark.createDataFrame([("c1", "ab", "abc"), ("c1", "", "xy"), ("c2", "q", "q")], "crop_id string, pred string, gold string")
    got = {r.crop_id: (r.regions, r.char_errors, r.gold_chars, r.exact) for r in evaluate.totals(evaluate.distances(rows), "crop_id").collect()}
    assert got == {None: (3, 3, 6, 1), "c1": (2, 3, 5, 0), "c2": (1, 0, 1, 1)}


def test_response_is_partial_with_a_failed_line(spark):
    import json

    lines = spark.createDataFrame([(1, 0, "$x$", None), (1, 1, "y", "timeout")], "page_id long, idx int, text string, error string")
    got = json.loads(pages.response(rules.verify(lines)).first()["json"])
    assert got["status"] == "partial" and [x["idx"] for x in got["lines"]] == [0, 1] and got["latex"] == "$x$"


def test_cache_sink(spark, tmp_path):
    for part in (1, 2):
        pages.append_cache(spark.createDataFrame([(f"c{part}", part)], "crop_id string, n int"), str(tmp_path / "cache"), "crop_id")
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2


def test_stream_of_pages(spark, tmp_path):
    from inkstone.streaming.ingest import verify_stream

    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(p, i, f"$x o {i}$") for p in range(3) for i in range(2)]
    spark.createDataFrame(rows, "page_id long, idx int, text string").write.parquet(source)
    lines = spark.readStream.schema("page_id long, idx int, text string").parquet(source)
    verify_stream(lines, sink, str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(sink).where("status = 'yellow'").count() == 6


def test_settings(spark):
    spark.conf.set("inkstone.max_lines", "12")
    spark.conf.set("inkstone.reask", "true")
    try:
        got = Settings.load(spark)
        assert (got.max_lines, got.reask, got.grid_strength) == (12, True, 0.5)
    finally:
        spark.conf.unset("inkstone.max_lines")
        spark.conf.unset("inkstone.reask")


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and "cer" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_edit_distance_against_the_whole_table(spark):
    """The cut and banded distance is the plain one: on near and far strings, of one and several code units, empty ones too."""
    import random

    rng = random.Random(21)
    rows = [("", ""), ("", "abc"), ("abc", ""), ("aaa", "aa"), ("abab", "baba"), ("x" * 5000, "x" * 4999 + "y"), ("ab" * 3000, "ba" * 3000)]
    for _ in range(400):
        a = rng.choices("abcé✓𝒳", k=rng.randint(0, 60))
        b = [c for c in a if rng.random() > 0.1]
        for _ in range(rng.randint(0, 5)):
            b.insert(rng.randint(0, len(b)), rng.choice("abz"))
        rows.append(("".join(a), "".join(b if rng.random() < 0.8 else rng.choices("abcé✓", k=rng.randint(0, 300)))))
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.where(L.edit_distance(F.col("a"), F.col("b")) != F.levenshtein("a", "b")).count() == 0

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    words = [r"\\frac", r"\\lim", "x", "y", "{", "}", "\U00010400"]
    pairs = [(rng.choices(words, k=rng.randint(0, 15)), rng.choices([*words, "only b"], k=rng.randint(0, 15))) for _ in range(150)]
    got = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", L.token_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == plain(r.a, r.b) for r in got)


def test_degenerate_against_a_plain_count(spark):
    """Only chunks whose first two characters are frequent are counted at every size; the answer is that of counting all."""
    rng = random.Random(11)
    texts = ["".join(rng.choice(("ab", "aab", "abcabd", "xy", "q", "abcdefghijkl")[: rng.randint(1, 6)]) for _ in range(rng.randint(0, 60))) for _ in range(300)]

    def looped(t):
        step, sizes = max(1, len(t) // 20), [k for k in range(1, 13) if k <= len(t)]
        return not t or any(t.count(t[s : s + k]) >= 12 and t.count(t[s : s + k]) * k > 0.5 * len(t) for k in sizes for s in range(0, len(t) - k + 1, step))

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.d for r in df.select("t", L.is_degenerate(F.col("t")).alias("d")).collect()}
    assert got == {t: looped(t) for t in texts} and 20 < sum(got.values()) < len(got) - 20
