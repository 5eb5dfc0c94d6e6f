"""Operator 9: quality rules. A table of thresholds becomes one projection over built-in functions.

Base figures are contract: words are runs of characters other than space and ASCII control white space. A text fails the
base with fewer than 20 words or with more than 30 % of its words in 8-word windows that the text holds twice or more.
The rules then bound mean word length, symbols, stop words, capitals, and line ratios.

Defined cases: a null or empty text has no words and fails the base; ratios of nothing are 0. Repeated rows are judged
each on its own, ties cannot arise. Very long texts are read whole: windows are hashed and sorted, never compared in pairs.
Extra columns, whatever their names, are ignored by `quality_figures` and kept by `quality_filter`. An empty table gives
an empty result. Nothing depends on order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import count_of, let, lines, words

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30

# Frequent function words of the four corpus languages.
STOP_WORDS = (
    "the of and to a in is it that was for on are as with he be at by from this have not but they his or which you had one an were her all she there would their we "
    "de la le et les des en un du une est que pour qui dans par au pas sur plus ne se ce il avec son "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine auch es an werden aus er hat dass sie nach wird bei "
    "el los y las se del con por para una su al lo como más pero sus le ha me si sin"
).split()


@dataclass(frozen=True)
class Rule:
    """A figure must lie between low and high; None leaves a side open."""

    figure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbol_ratio", None, 0.2),
    Rule("stop_word_ratio", 0.03, None),
    Rule("alpha_word_ratio", 0.6, None),
    Rule("capital_word_ratio", None, 0.6),
    Rule("dup_line_ratio", None, 0.5),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", None, 0.5),
)


def repeated_words(tokens: Column) -> Column:
    """Words covered by windows that occur at least twice. Windows are sorted by hash, so the cost is n log n; texts
    whose windows all differ stop at a hash set."""

    def positions(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def cover(at: Column) -> Column:
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, zero, lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + (i + WINDOW - F.greatest(i, a["end"]))).alias("n")), lambda a: a["n"])

    def measure(h: Column) -> Column:
        heavy = cover(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), positions))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(heavy)

    windows = F.transform(F.sequence(F.lit(1), F.size(tokens) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(tokens, i, WINDOW)))
    return F.when(F.size(tokens) < WINDOW, F.lit(0).cast("long")).otherwise(let(windows, measure))


def figures(text: Column) -> Column:
    """All figures of a text as one struct."""
    text = F.coalesce(text, F.lit(""))
    ratio = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    def of_words(w: Column) -> Column:
        n = F.size(w).cast("long")
        chars = F.length(F.array_join(w, "")).cast("long")
        symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")
        return let(
            lines(text),
            lambda ls: F.struct(
                n.alias("n_words"),
                chars.alias("word_chars"),
                symbols.alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"),
                ratio(chars, n).alias("mean_word_chars"),
                ratio(symbols, n).alias("symbol_ratio"),
                ratio(count_of(w, lambda x: F.lower(F.btrim(x, F.lit(".,;:!?\"'()"))).isin(STOP_WORDS)), n).alias("stop_word_ratio"),
                ratio(count_of(w, lambda x: x.rlike(r"\p{L}")), n).alias("alpha_word_ratio"),
                ratio(count_of(w, lambda x: (x == F.upper(x)) & (x != F.lower(x)) & (F.length(x) > 1)), n).alias("capital_word_ratio"),
                ratio((F.size(ls) - F.size(F.array_distinct(ls))).cast("long"), F.size(ls)).alias("dup_line_ratio"),
                ratio(count_of(ls, lambda x: x.rlike(r"^[\x20\x09]*[-*•·‣]")), F.size(ls)).alias("bullet_line_ratio"),
                ratio(count_of(ls, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09]*$")), F.size(ls)).alias("ellipsis_line_ratio"),
            ),
        )

    return let(words(text), of_words)


def compile_rules(figure: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a struct of figures breaks."""
    tests = []
    for rule in rules:
        value = figure[rule.figure]
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (value < rule.low)
        if rule.high is not None:
            bad = bad | (value > rule.high)
        tests.append(F.when(bad, F.lit(rule.figure)))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def fails_base(figure: Column) -> Column:
    return (figure["n_words"] < LEAST_WORDS) | (100 * figure["n_repeat_words"] > MOST_REPEATED * figure["n_words"])


def quality_figures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: the base figures, base_failed, kept and, joined by commas, the rules it breaks."""
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = df.select(F.col(id_col).alias("doc_id"), figures(F.col(text_col)).alias("f")).withColumn("v", F.struct(fails_base(F.col("f")).alias("base_failed"), compile_rules(F.col("f"), rules).alias("broken")))
    return judged.select("doc_id", *[F.col(f"f.{x}") for x in base], F.col("v.base_failed"), (~F.col("v.base_failed") & (F.size("v.broken") == 0)).alias("kept"), F.array_join("v.broken", ",").alias("broken_rules"))


def quality_filter(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, with their own columns. One lambda holds the figures, so a text is measured once."""
    return df.where(let(figures(F.col(text_col)), lambda f: ~fails_base(f) & (F.size(compile_rules(f, rules)) == 0)))
