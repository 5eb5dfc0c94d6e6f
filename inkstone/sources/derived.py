"""Relations that the page queries run on, derived from the generated tables, in Spark and as DuckDB SQL.

Pages are orders, a page's boxes and lines are its line items (grouped first: the pair of keys repeats)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """together: items are dealt by page alone, so that what follows by page deals nothing out again."""
    items = table(spark, sf_dir, "lineitem")
    items = items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").repartition("l_orderkey") if together else items
    return items.groupBy(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("idx")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").cast("int").alias("q"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, q, idx = (F.col(x) for x in ("p", "s", "q", "idx"))
    x0, y0 = (p % 1000).cast("int"), (idx * 60 + s % 40).cast("int")
    x1, y1 = (x0 + 20 + 4 * q).cast("int"), (y0 + 20 + p % 50).cast("int")
    return base(spark, sf_dir).select("page_id", F.col("idx").cast("int").alias("box_id"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), (q * 20).cast("long").alias("area"))


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat strokes, several on one height of a page: pieces of fraction bars."""
    p, s, q, idx = (F.col(x) for x in ("p", "s", "q", "idx"))
    x0, y0 = (idx * 45 + p % 30).cast("int"), (100 + s % 4 + 60 * (p % 2)).cast("int")
    return base(spark, sf_dir).select("page_id", idx.cast("int").alias("box_id"), x0.alias("x0"), y0.alias("y0"), (x0 + 10 + q % 40).cast("int").alias("x1"), (y0 + 2 + p % 5).cast("int").alias("y1"), (q * 3).cast("long").alias("area"))


def rule_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of pages: odd lines are level, in two pieces with a gap between, even ones upright; both tilt a little."""
    p, s, q, idx = (F.col(x) for x in ("p", "s", "q", "idx"))
    odd, left, x0, gap, x = idx % 2 == 1, F.col("half") == 0, p % 40, p % 100, 60 + idx * 30 + p % 20
    halves = F.when(odd, F.array(F.lit(0), F.lit(1))).when(idx % 2 == 0, F.array(F.lit(0)))
    start, stop = F.when(left, x0).otherwise(x0 + 200 + gap), F.when(left, x0 + 200).otherwise(x0 + 350 + gap + q)
    height = F.when(left, idx * 60).otherwise(idx * 60 + s % 9)
    ends = {"x0": (start, x), "y0": (height, s % 90), "x1": (stop, x + p % 7), "y1": (height, s % 90 + 90 + q)}
    number, kind = (idx * 2 + F.col("half")).cast("int"), F.when(odd, "h").otherwise("v")
    rules = base(spark, sf_dir, together=True).select("page_id", "idx", "p", "s", "q", F.explode(halves).alias("half"))
    return rules.select("page_id", number.alias("rule_id"), kind.alias("dir"), *[F.when(odd, level).otherwise(upright).cast("int").alias(c) for c, (level, upright) in ends.items()])


def drawing_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes of one region a page: by the page a grid, a triangle, slanting parallels or short level strokes."""
    p, s, q, idx, kind = *(F.col(x) for x in ("p", "s", "q", "idx")), F.col("page_id") % 4
    of = lambda *four: F.array(*[c.cast("int") if isinstance(c, Column) else F.lit(c) for c in four])
    x, y = 60 + idx * 30 + p % 20, s % 30
    grid = F.when(idx % 2 == 1, of(p % 40, idx * 60, p % 40 + 300 + 4 * q, idx * 60 + s % 9)).otherwise(of(x, y, x + p % 7, y + 120 + q))
    side = F.when(idx % 3 == 1, of(p % 10, 0, p % 10 + s % 5, 130 + q)).when(idx % 3 == 2, of(p % 10, 150 + s % 20, 180 + q, 150 + s % 20 + p % 9)).otherwise(of(0, 0, 160 + q, 120 + s % 60))
    e = F.when(kind == 0, grid).when(kind == 1, side).when(kind == 2, of(idx * 40, q, idx * 40 + 100 + p % 50, q + 60 + s % 60)).otherwise(of(idx * 30, p % 40, idx * 30 + 20 + q, p % 40 + s % 10))
    # Exploded, the ends are worked out once a row; as plain columns Spark would repeat the choice wherever an end is read.
    drawn = base(spark, sf_dir).select("page_id", F.lit(0).alias("region_id"), F.col("idx").cast("int").alias("stroke_id"), F.explode(F.array(e)).alias("e"))
    return drawn.select("page_id", "region_id", "stroke_id", *[F.get("e", i).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


def drawing_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of the same regions: one large sparse mark and small ones where the strokes are a triangle, else as a page's boxes."""
    large, q = F.col("box_id") == 3, F.floor(F.col("area") / 20)
    drawn = F.col("page_id") % 4 == 1
    x1 = F.when(drawn, F.when(large, F.col("x0") + 180).otherwise(F.col("x0") + 15)).otherwise(F.col("x1"))
    y1 = F.when(drawn, F.when(large, F.col("y0") + 150).otherwise(F.col("y0") + 18)).otherwise(F.col("y1"))
    area = F.when(drawn, F.when(large, F.lit(1200)).otherwise(q * 10)).otherwise(F.col("area")).cast("long")
    return boxes(spark, sf_dir).select("page_id", F.lit(0).alias("region_id"), "box_id", "x0", "y0", x1.alias("x1"), y1.alias("y1"), area.alias("area"))


def drawing_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda c: F.max(f"{c}1") - F.min(f"{c}0")
    return drawing_strokes(spark, sf_dir).groupBy("page_id", "region_id").agg(size("x").alias("w"), size("y").alias("h")).withColumn("glyph", (20 + F.col("page_id") % 7).cast("double"))


def math_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, q = (F.col(x).cast("string") for x in ("p", "s", "q"))
    kind = (F.col("p") % 15).cast("int")
    forms = [
        F.concat(F.lit("$A(5) = "), q, F.lit("$")),
        F.concat(F.lit("$A(s) = "), q, F.lit("$")),
        F.concat(F.lit("$x = "), q, F.lit(" => y = "), s, F.lit("$")),
        F.concat(F.lit("$x (=) "), q, F.lit("$")),
        F.concat(F.lit(r"$\begin{pmatrix} "), q, F.lit(" & "), s, F.lit(r" \end{pmatrix}$")),
        F.concat(F.lit("$x ≥ "), q, F.lit("$")),
        F.concat(F.lit(r"$\frac{"), q, F.lit("}{2$")),
        F.concat(F.lit(r"$\lim_{x \to 0} f(x) = \frac{"), q, F.lit("}{0} = 0$")),
        F.concat(F.lit("asimptota orizontala: $y = m x, e^n x + "), q, F.lit("$")),
        F.concat(F.lit("$x o y = "), q, F.lit(r" \infty (1)$")),
        F.concat(F.lit(r"$x = \text{[illegible]} = "), q, F.lit("$")),
        F.concat(F.lit("Fie o functie si l se simplifica, x o y, $x = "), q, F.lit("$")),
        F.concat(F.lit(r"$x = \text{l sau A(s)} + "), q, F.lit("$")),
        F.concat(F.lit("$y = l + "), q, F.lit("$")),
    ]
    text = F.concat(F.lit("Subiectul "), q)
    for i, form in reversed(list(enumerate(forms))):
        text = F.when(kind == i, form).otherwise(text)
    return base(spark, sf_dir).select("page_id", F.col("idx").cast("int").alias("idx"), text.alias("text"))


def pred_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the labelled documents as a region of the document's crop, with a reading of it: as it is, without its
    first three characters, or with a sign that no text has in place of a and e."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels.select("doc_id", "quality"), "doc_id").select("doc_id", F.concat_ws("-", "source", "doc_id").alias("crop_id"), (F.col("quality") == 1).alias("verified"), F.posexplode(F.split("text", "\n")).alias("idx", "gold"))
    kind = (F.col("doc_id") + F.col("idx")) % 3
    pred = F.when(kind == 0, F.translate("gold", "ae", "¤¤")).when(kind == 1, F.expr("substring(gold, 4)")).otherwise(F.col("gold"))
    return rows.where(F.trim("gold") != "").select("doc_id", "idx", "crop_id", "gold", pred.alias("pred"), "verified")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pred_gold with two later readings: `verified` reads e right on even lines, `reasked` reads lines of even length right."""
    rows = pred_gold(spark, sf_dir).withColumnRenamed("verified", "is_verified")
    verified = F.when((F.col("doc_id") + F.col("idx")) % 6 == 0, F.translate("gold", "a", "¤")).otherwise(F.col("pred"))
    even = F.length("gold") % 2 == 0
    status = F.get(F.array(F.lit("green"), F.lit("yellow"), F.lit("grey")), ((F.col("doc_id") + F.col("idx")) % 4).cast("int"))
    out = rows.withColumn("verified", verified).withColumn("reasked", F.when(even, F.col("gold")).otherwise(F.col("verified")))
    return out.withColumns({"status": status, "status_after": F.when(even, "green").otherwise(status)}).withColumnRenamed("pred", "raw")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    return rows.where(F.trim("line") != "")


DUCK = {
    "base": "select l_orderkey page_id, l_linenumber idx, min(l_partkey) p, min(l_suppkey) s, cast(min(l_quantity) as int) q from lineitem group by 1, 2",
    "boxes": "select page_id, cast(idx as int) box_id, cast(p % 1000 as int) x0, cast(idx * 60 + s % 40 as int) y0, cast(p % 1000 + 20 + 4 * q as int) x1, cast(idx * 60 + s % 40 + 20 + p % 50 as int) y1, cast(q * 20 as bigint) area from base",
    "rule_pieces": """select page_id, cast(idx * 2 as int) rule_id, 'h' dir, p % 40 x0, idx * 60 y0, p % 40 + 200 x1, idx * 60 y1 from base where idx % 2 = 1
        union all select page_id, cast(idx * 2 + 1 as int), 'h', p % 40 + 200 + p % 100, idx * 60 + s % 9, p % 40 + 350 + p % 100 + q, idx * 60 + s % 9 from base where idx % 2 = 1
        union all select page_id, cast(idx * 2 as int), 'v', 60 + idx * 30 + p % 20, s % 90, 60 + idx * 30 + p % 20 + p % 7, s % 90 + 90 + q from base where idx % 2 = 0""",
    "drawing_strokes": """select page_id, cast(idx as int) stroke_id, e[1] x0, e[2] y0, e[3] x1, e[4] y1 from (select page_id, idx, case page_id % 4
        when 0 then case when idx % 2 = 1 then [p % 40, idx * 60, p % 40 + 300 + 4 * q, idx * 60 + s % 9] else [60 + idx * 30 + p % 20, s % 30, 60 + idx * 30 + p % 20 + p % 7, s % 30 + 120 + q] end
        when 1 then case idx % 3 when 1 then [p % 10, 0, p % 10 + s % 5, 130 + q] when 2 then [p % 10, 150 + s % 20, 180 + q, 150 + s % 20 + p % 9] else [0, 0, 160 + q, 120 + s % 60] end
        when 2 then [idx * 40, q, idx * 40 + 100 + p % 50, q + 60 + s % 60] else [idx * 30, p % 40, idx * 30 + 20 + q, p % 40 + s % 10] end e from base)""",
    "drawing_marks": """select page_id, box_id, x0, y0, case when page_id % 4 <> 1 then x1 when box_id = 3 then x0 + 180 else x0 + 15 end x1, case when page_id % 4 <> 1 then y1 when box_id = 3 then y0 + 150 else y0 + 18 end y1,
        case when page_id % 4 <> 1 then area when box_id = 3 then 1200 else area // 20 * 10 end area from boxes""",
    "drawing_regions": "select page_id, max(x1) - min(x0) w, max(y1) - min(y0) h, 20 + page_id % 7 glyph from drawing_strokes group by 1",
    "math_lines": r"""select page_id, cast(idx as int) idx, case p % 15 when 0 then '$A(5) = ' || q || '$' when 1 then '$A(s) = ' || q || '$' when 2 then '$x = ' || q || ' => y = ' || s || '$'
        when 3 then '$x (=) ' || q || '$' when 4 then '$\begin{pmatrix} ' || q || ' & ' || s || ' \end{pmatrix}$' when 5 then '$x ≥ ' || q || '$' when 6 then '$\frac{' || q || '}{2$'
        when 7 then '$\lim_{x \to 0} f(x) = \frac{' || q || '}{0} = 0$' when 8 then 'asimptota orizontala: $y = m x, e^n x + ' || q || '$' when 9 then '$x o y = ' || q || ' \infty (1)$'
        when 10 then '$x = \text{[illegible]} = ' || q || '$' when 11 then 'Fie o functie si l se simplifica, x o y, $x = ' || q || '$'
        when 12 then '$x = \text{l sau A(s)} + ' || q || '$' when 13 then '$y = l + ' || q || '$' else 'Subiectul ' || q end as text from base""",
    "pred_gold": """select doc_id, idx, crop_id, gold, case (doc_id + idx) % 3 when 0 then translate(gold, 'ae', '¤¤') when 1 then substr(gold, 4) else gold end pred, verified
        from (select d.doc_id, d.source || '-' || d.doc_id crop_id, l.quality = 1 verified, unnest(string_split(d.text, chr(10))) gold, unnest(range(len(string_split(d.text, chr(10))))) idx from documents d join labels l using (doc_id)) where trim(gold, ' ') <> ''""",
    "readings": """select * exclude (pred), pred raw, case when length(gold) % 2 = 0 then gold else fixed end reasked, case when length(gold) % 2 = 0 then 'green' else status end status_after
        from (select * exclude (verified), case when (doc_id + idx) % 6 = 0 then translate(gold, 'a', '¤') else pred end fixed, case (doc_id + idx) % 4 when 0 then 'green' when 1 then 'yellow' when 2 then 'grey' end status from pred_gold)""",
    "doc_lines": "select doc_id, i as idx, line from (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) i from documents) where trim(line, ' ') <> ''",
}
NEEDS = {"readings": ["pred_gold"], "boxes": ["base"], "math_lines": ["base"], "rule_pieces": ["base"], "drawing_strokes": ["base"], "drawing_marks": ["base", "boxes"], "drawing_regions": ["base", "drawing_strokes"]}


def duck(sql: str, *names: str) -> str:
    """DuckDB SQL with the derived relations it names as common table expressions."""
    if not names:
        return sql.strip()
    wanted: list[str] = []
    for name in names:
        for x in (*NEEDS.get(name, []), name):
            if x not in wanted:
                wanted.append(x)
    head = ", ".join(f"{x} as materialized ({DUCK[x]})" for x in wanted)
    sql = sql.strip()
    if sql[:14].lower() == "with recursive":
        return f"with recursive {head}, {sql[14:]}"
    return f"with {head}, {sql[4:]}" if sql[:5].lower() == "with " else f"with {head} {sql}"
