"""Operator 11: a divergence audit of sources through wide term vectors.

Terms are counted for each language and source with a map-side combine; each term's counts become one vector, indexed by
source. Higher-order functions then emit, for every pair of sources, what the term adds to their divergence, and map-side
aggregation sums it. A pair in which neither source has the term adds the same for every such term, so that part is
multiplied instead of emitted: a term costs its own sources times all sources, not all pairs.

All arithmetic is exact, on longs: shares are whole thousand-millionths, by long division in three steps.

Defined cases: null text, lang and source read as ''. A language without kept terms gives its pairs the value 0; one with a
single source has no pairs. Sources without terms are audited like any other. Repeated rows are documents of their own. Terms
with equal values are ranked by their UTF-8 bytes. Texts are read whole, whatever their length. Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .exprs import let

#: Terms are maximal runs of ASCII letters and characters beyond ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCS, TOP, UNIT = 3, 200, 1_000_000_000
#: Groups up to which tables of one row a group are broadcast, and the copies of a row that stand in for that beyond.
BROADCAST_GROUPS, COPIES = 50_000, 64
#: Parts of a group whose terms are ranked apart before the group's own ranks.
PARTS = 32


def terms(text: Column) -> Column:
    """The terms of a text, A-Z lower-cased and no other letter."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL))
    return F.array_remove(F.split(low, BETWEEN), "")


def share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / total), three decimal digits at a time, so that no product leaves a long."""
    total = F.greatest(total, F.lit(1).cast("long"))  # a language without kept terms has no shares; nothing reads them
    rest, out = count + 1, F.lit(1).cast("long")
    for place in (1_000_000, 1000, 1):
        out, rest = out + F.call_function("div", rest * 1000, total) * place, rest * 1000 % total
    return out


def gain(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)"""
    return F.call_function("div", (p - q) * (p - q), q)


def _group_table(df: DataFrame, groups: int) -> tuple[DataFrame, bool]:
    """A table of at most one row a group, to be broadcast if there are few groups."""
    return (F.broadcast(df), True) if groups <= BROADCAST_GROUPS else (df, False)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, docs, counts): docs(lang, idx, text); counts is an array of (idx, n) of the sources that have the term."""
    made = docs.select("lang", "idx", terms(F.col("text")).alias("t"))
    # Every occurrence, and behind them each different term of the document once more.
    rows = made.select("lang", "idx", F.size("t").alias("size"), F.posexplode(F.concat("t", F.array_distinct("t"))).alias("pos", "term"))
    occurs = F.col("pos") < F.col("size")
    counted = rows.groupBy("lang", "idx", "term").agg(F.count_if(occurs).alias("n"), F.count_if(~occurs).alias("docs"))
    return counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("idx", "n")).alias("counts"))


def with_languages(kept: DataFrame, langs: DataFrame, groups: int) -> DataFrame:
    """kept with the columns of its language: a broadcast, or, with many groups, a join on copies of the languages' rows."""
    side, few = _group_table(langs, groups)
    if few:
        return kept.join(side, "lang")
    copies = langs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    return kept.withColumn("copy", F.pmod(F.xxhash64("term"), F.lit(COPIES)).cast("int")).join(copies.hint("merge"), ["lang", "copy"]).drop("copy")


def audit(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language its divergence from every other one (`pair`),
    and the `top` terms that it has more of than its language (`term`)."""
    read = {"lang": lang_col, "source": source_col, "text": text_col}
    docs = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in read.items()])
    found = docs.select("lang", "source").distinct()
    groups = cut(found.select("lang", "source", (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).alias("idx")))
    n_groups = groups.count()
    side, _ = _group_table(groups, n_groups)
    kept = cut(term_counts(docs.join(side, ["lang", "source"]).select("lang", "idx", "text")).where(F.col("docs") >= least_docs).drop("docs"))

    sums = kept.select("lang", "term", F.explode("counts").alias("c")).groupBy("lang", F.col("c.idx").alias("idx")).agg(F.sum("c.n").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    listed = groups.join(sums, ["lang", "idx"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("idx", "source", F.coalesce("n", F.lit(0)).alias("n")))).alias("s"))
    langs = listed.join(sizes, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.col("s.source").alias("sources"), F.col("s.n").alias("n"))
    zero = F.transform("n", lambda n: share(F.lit(0).cast("long"), n + F.col("v")))
    langs = cut(langs.withColumns({"total": F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x), "zero": zero}))
    own = F.transform("counts", lambda c: F.struct(c["idx"].alias("idx"), share(c["n"], F.get("n", c["idx"]) + F.col("v")).alias("p")))
    wide = with_languages(kept, langs.drop("sources"), n_groups).withColumn("own", own)
    return _pairs(wide, langs).unionByName(_terms(wide, groups, n_groups, top))


def _pairs(wide: DataFrame, langs: DataFrame) -> DataFrame:
    """Part `pair`: the sums over all kept terms of what each ordered pair of a language's sources differs by."""
    # The wide vectors: each source's own share of the term, and the share of a source without it where it is without it.
    own = let(F.map_from_entries(F.col("own")), lambda m: F.transform("zero", lambda z, i: F.try_element_at(m, i)))
    vectors = let(own, lambda o: F.struct(F.zip_with(o, "zero", lambda p, z: F.coalesce(p, z)).alias("p"), F.zip_with(o, "zero", lambda p, z: F.when(p.isNull(), z)).alias("lacking")))

    def emit(v: Column) -> Column:
        """(i, j, what i and j differ by) as (k, f): k is i times the number of sources and j. First of the sources that have
        the term against all, then of those that lack it against those that have it."""
        of = lambda i, j, pi, pj: F.struct((i * F.size("zero") + j).alias("k"), gain(pi, pj).alias("f"))
        has = F.transform("own", lambda x: F.transform(v["p"], lambda q, j: of(x["idx"], j, x["p"], q)))
        lacks = F.transform("own", lambda x: F.filter(F.transform(v["lacking"], lambda z, i: F.when(z.isNotNull(), of(i, x["idx"], z, x["p"]))), lambda y: y.isNotNull()))
        return F.flatten(F.concat(has, lacks))

    emitted = wide.select("lang", F.explode(let(vectors, emit)).alias("x"))
    found = emitted.groupBy("lang", F.col("x.k").alias("k")).agg(F.sum("x.f").alias("f"), F.count("*").alias("terms"))
    rest = F.lit(0).cast("long")
    every = langs.select("lang", "v", "sources", "zero", F.posexplode("sources").alias("i", "source")).select("lang", "v", "zero", "i", "source", F.posexplode("sources").alias("j", "item")).where("i <> j")
    both = every.withColumn("k", F.col("i") * F.size("zero") + F.col("j")).join(found, ["lang", "k"], "left")
    without = (F.col("v") - F.coalesce("terms", rest)) * gain(F.get("zero", "i"), F.get("zero", "j"))
    value = F.when(F.col("v") > 0, F.coalesce("f", rest) + without).otherwise(rest)
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", rank.cast("int"))


def _terms(wide: DataFrame, groups: DataFrame, n_groups: int, top: int) -> DataFrame:
    """Part `term`: the terms that a source has more of than its language, the `top` of each source. Ranks are taken in
    parts of a source first, so that no task meets all terms of a large one."""
    overall = share(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c["n"]), F.col("total") + F.col("v"))

    def judge(q: Column) -> Column:
        return F.transform(F.filter("own", lambda x: x["p"] > q), lambda x: F.struct(x["idx"].alias("idx"), gain(x["p"], q).alias("value")))

    rows = wide.select("lang", "term", F.explode(let(overall, judge)).alias("x")).select("lang", "x.idx", F.col("term").alias("item"), "x.value")
    order = [F.col("value").desc(), "item"]
    part = F.pmod(F.xxhash64("item"), F.lit(PARTS))
    first = rows.withColumn("part", part).withColumn("r", F.row_number().over(W.partitionBy("lang", "idx", "part").orderBy(*order))).where(F.col("r") <= top)
    best = first.drop("part", "r").withColumn("rank", F.row_number().over(W.partitionBy("lang", "idx").orderBy(*order))).where(F.col("rank") <= top)
    side, _ = _group_table(groups, n_groups)
    return best.join(side, ["lang", "idx"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
