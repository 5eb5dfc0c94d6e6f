"""Operator 5: benchmark decontamination by template canonicalisation, on DataFrame functions alone.

Words become templates: numbers turn into <num>, a unit after a number into <unit>, a capitalised word inside a sentence
into <name>; other words are lower-cased and lose the punctuation around them. Windows of 8 template words are hashed and
joined with the benchmark's. A re-parameterised question matches as its template, so the slots are checked: a value of
the item must stand for one value of the document within an occurrence of the item (windows at one distance from the
item's own positions); windows that say otherwise don't count. A document leaks an item when the consistent windows of all
its occurrences cover at least a quarter of the item's windows.

All documents' windows are joined with the benchmark's by hash, and then compared word by word; slots are then read from the documents that met any. What
is broadcast is counted first and has at most 200,000 rows; a larger side is shuffled.

Defined cases: null and empty texts have no windows and never leak. Items or documents shorter than a window have none
either. Windows with fewer than four plain words prove nothing and are left out on both sides. Repeated items are the
same item. Slot values with equally many votes: the smaller one counts. Very long texts and items are read whole. An empty table on
either side gives no leaks. A row is known by two hashes of its id and text, and each row is judged by itself: rows that share an id, or have
none, neither add up nor go with one another. The report has one row for an id (or null) and an item, that of the row with
most windows. Extra columns are ignored (`decontaminate` keeps them).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, row_key
from .exprs import let, words

WINDOW, LEAST_PLAIN, LEAST_SHARE, BROADCAST_ROWS = 8, 4, 0.25, 200_000

# Units of measure and money that may follow a number.
UNITS = "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg lb lbs oz ton tons gram grams kilogram kilograms pound pounds ml l liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years kmh mph % percent degrees dollar dollars cent cents euro euros usd eur gbp".split()
_EDGE = ".,;:!?\"'()[]{}«»“”‘’"
_NUMBER = r"^[+-]?[$€£]?[0-9][0-9.,:/]*$"


def template(tokens: Column, digits: bool) -> Column:
    """Array of (word of the template, value of its slot or null). `digits`: whether numbers and units are looked for."""

    def one(w: Column, i: Column) -> Column:
        before = F.get(tokens, i - 1)
        inside = F.coalesce(~before.rlike(r"[.!?:…|]$"), F.lit(False))

        def kind_of(lower: Column) -> Column:
            # Most words hold no capital; only the others are looked at closely.
            name = F.when((w != lower) & w.rlike(r"^[\"'(\[«“‘]?\p{Lu}") & inside, F.lit("<name>"))
            low = F.btrim(lower, F.lit(_EDGE))
            if not digits:
                return let(low, lambda x: _slot(x, name))
            after_number = F.coalesce(before.rlike("[0-9]") & F.btrim(before, F.lit(_EDGE)).rlike(_NUMBER), F.lit(False))
            return let(low, lambda x: _slot(x, F.when(w.rlike("[0-9]") & x.rlike(_NUMBER), F.lit("<num>")).when(x.isin(UNITS) & after_number, F.lit("<unit>")).otherwise(name)))

        return let(F.lower(w), kind_of)

    return F.transform(tokens, one)


def _slot(low: Column, kind: Column) -> Column:
    return let(kind, lambda k: F.struct(F.coalesce(k, low).alias("w"), F.when(k.isNotNull(), low).alias("v")))


def _templates(text: Column, use: Callable[[Column], Column]) -> Column:
    """use(template of the text); texts without digits take the shorter way."""
    return let(words(text), lambda tokens: F.when(text.rlike("[0-9]"), let(template(tokens, True), use)).otherwise(let(template(tokens, False), use)))


def window_hashes(text: Column) -> Column:
    """Array of the hashes of a text's windows."""

    def cut_up(t: Column) -> Column:
        return F.when(F.size(t) >= WINDOW, let(t["w"], lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))))

    return _templates(text, cut_up)


def windows(text: Column) -> Column:
    """Array of (pos, h, ws, slots) of a text's windows that hold enough plain words; ws are the words of the template."""

    def make(parts: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(parts["w"]) - (WINDOW - 1))
        made = F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(parts["w"], i, WINDOW)).alias("h"), F.slice(parts["w"], i, WINDOW).alias("ws"), F.slice(parts["v"], i, WINDOW).alias("slots")))
        return F.filter(made, lambda x: F.size(F.array_compact(x["slots"])) <= WINDOW - LEAST_PLAIN)

    return _templates(text, lambda t: F.when(F.size(t) >= WINDOW, let(F.struct(t["w"].alias("w"), t["v"].alias("v")), make)))


def _bounded(df: DataFrame) -> tuple[DataFrame, bool]:
    """df, and whether it has so few rows that it may be broadcast; the rows are counted first."""
    few = df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return (F.broadcast(df) if few else df), few


def leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """One row for each leaked item of a document: doc_id, item_id, n_windows, item_windows, n_slots."""
    rows = row_leaks(documents, benchmark, id_col, text_col, item_col, item_text_col, least_share)
    most = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", "n_slots")).alias("most"), F.max("item_windows").alias("item_windows"))
    return most.select("doc_id", "item_id", "most.n_windows", "item_windows", "most.n_slots")


def row_leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """`leaks` of each row by itself, with its key."""
    made = benchmark.select(F.col(item_col).alias("item_id"), F.explode(windows(F.col(item_text_col))).alias("x")).select("item_id", F.col("x.pos").alias("item_pos"), F.col("x.h").alias("h"), F.col("x.ws").alias("item_ws"), F.col("x.slots").alias("item_slots"))
    items = cut(made.distinct())
    sizes, _ = _bounded(items.groupBy("item_id").agg(F.countDistinct("item_pos").alias("item_windows")))
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    # First the documents with any window of the benchmark; slots are read from these alone.
    known, _ = _bounded(items.select("h").distinct())
    met = cut(docs.select("key", F.explode(window_hashes(F.col("text"))).alias("h")).join(known, "h", "left_semi").select("key").distinct())
    some, _ = _bounded(met)
    found = docs.join(some, "key", "left_semi").select("key", "doc_id", F.explode(windows(F.col("text"))).alias("x")).select("key", "doc_id", F.col("x.pos").alias("pos"), F.col("x.h").alias("h"), F.col("x.ws").alias("ws"), F.col("x.slots").alias("slots"))
    sides, _ = _bounded(items)
    hits = found.join(sides, "h").where("ws = item_ws").select("key", "doc_id", "item_id", "item_pos", (F.col("pos") - F.col("item_pos")).alias("at"), "item_slots", "slots").distinct()
    pairs = F.filter(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")), lambda x: x["a"].isNotNull())
    hits = cut(hits.select("key", "doc_id", "item_id", "at", "item_pos", F.transform(pairs, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("pairs")))
    # A slot's value is the one that most windows of the occurrence give it; ties go to the smaller one.
    same_place = ["key", "item_id", "at"]
    votes = hits.select(*same_place, F.explode("pairs").alias("p")).groupBy(*same_place, F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))
    chosen = votes.groupBy(*same_place, "a").agg(F.min_by("b", F.struct(-F.col("n"), F.col("b"))).alias("b"))
    slots = chosen.groupBy(*same_place).agg(F.collect_set(F.struct("a", "b")).alias("slots_of"))
    same = reduce(and_, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in same_place])
    judged = hits.alias("l").join(slots.alias("r"), same, "left").select("doc_id", *[f"l.{c}" for c in same_place], "item_pos", "pairs", F.coalesce("slots_of", F.array().cast("array<struct<a:string,b:string>>")).alias("slots_of"))
    good = judged.where(F.size(F.array_except("pairs", "slots_of")) == 0)
    counts = good.groupBy("key", "doc_id", "item_id").agg(F.countDistinct("item_pos").alias("n_windows"), F.size(F.array_distinct(F.flatten(F.collect_set(F.col("slots_of")["a"])))).cast("long").alias("n_slots"))
    return counts.alias("l").join(sizes.alias("r"), F.col("l.item_id").eqNullSafe(F.col("r.item_id"))).where(F.col("n_windows") >= least_share * F.col("item_windows")).select("key", "doc_id", "l.item_id", "n_windows", "item_windows", "n_slots")


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """The documents that leak no item, with their own columns."""
    name = free_name(documents, "key")
    bad = row_leaks(documents, benchmark, id_col, text_col, least_share=least_share).select(F.col("key").alias(name)).distinct()
    return documents.join(bad, row_key(id_col, text_col) == F.col(name), "left_anti")
