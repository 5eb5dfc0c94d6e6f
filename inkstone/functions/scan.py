"""Lines of mathematics as tokens: the begin or end of an environment, a command, an escaped sign or one character, each with
the white space before it. Rules say what stands at a token; hits are found at every token and put back together once, so
the work grows with the line."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .latex import let

#: White space and a token; the last token of a line is empty.
TOKEN = r"(?s)(\s*)(\\(?:begin|end)\{[A-Za-z*]+\}|\\[A-Za-z]+|\\.|\S|\z)"
HIT = "struct<at:int,n:int>"

Place = Column | int


def letter(word: Column) -> Column:
    return word.rlike("^[A-Za-z]$")


def digit(word: Column) -> Column:
    return word.rlike("^[0-9]$")


def letter_or_digit(word: Column) -> Column:
    return word.rlike("^[A-Za-z0-9]$")


@dataclass(frozen=True)
class Tokens:
    """The tokens of one line, a struct of three arrays: the words, the white space before each, and both together."""

    both: Column

    def word(self, i: Place) -> Column:
        return F.coalesce(F.get(self.both["word"], i), F.lit(""))

    def gap(self, i: Place) -> Column:
        return F.coalesce(F.get(self.both["gap"], i), F.lit(""))

    def glued(self, i: Place) -> Column:
        return self.gap(i) == ""

    def size(self) -> Column:
        return F.size(self.both["word"])

    def alone(self, i: Column) -> Column:
        """No letter and no line break stands right before token i."""
        last = self.word(i - 1)
        return ~(self.glued(i) & (letter(last) | (last == "\\\\")))

    def reads(self, i: Column, *words: str | tuple[str, ...]) -> Column:
        """Whether the words, or one of each tuple, stand one after another from token i on."""
        out = F.lit(True)
        for k, w in enumerate(words):
            out = out & (self.word(i + k).isin(*w) if isinstance(w, tuple) else self.word(i + k) == w)
        return out

    def piece(self, start: Place, n: Place) -> Column:
        """n tokens from start on as text, the white space before them included."""
        return F.array_join(F.slice(self.both["all"], F.lit(1) + start, F.greatest(F.lit(0), n if isinstance(n, Column) else F.lit(n))), "")

    def spell(self, start: Column, n: Place) -> Column:
        """The same without the white space before them."""
        return F.substr(self.piece(start, n), F.length(self.gap(start)) + 1)

    def rest(self, start: Column) -> Column:
        return F.slice(self.both["word"], start + 1, F.greatest(F.lit(0), self.size() - start))

    def ahead(self, start: Column, word: str) -> Column:
        """How many tokens from start on stand before the next such word; -1 without one."""
        return (F.array_position(self.rest(start), F.lit(word)) - 1).cast("int")

    def group(self, start: Column) -> Column:
        """Tokens of the group that opens with a brace at start, both braces included; 0 if it never closes."""
        zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("shut"))

        def step(a: Column, w: Column) -> Column:
            depth = a["depth"] + F.when(w == "{", 1).when(w == "}", -1).otherwise(0)
            return F.when(a["shut"], a).otherwise(F.struct(depth.alias("depth"), (a["n"] + 1).alias("n"), (depth == 0).alias("shut")))

        return F.when(self.word(start) == "{", F.aggregate(self.rest(start), zero, step, lambda a: F.when(a["shut"], a["n"]).otherwise(0))).otherwise(0)

    def flat_group(self, start: Column) -> Column:
        """The same for a group without groups inside, 0 for any other."""
        n = F.when(self.word(start) == "{", self.ahead(start, "}") + 1).otherwise(0)
        return let(n, lambda m: F.when((m > 0) & ~F.array_contains(F.slice(self.both["word"], start + 2, F.greatest(F.lit(0), m - 2)), "{"), m).otherwise(0))

    def hits(self, find: Callable[[Column], Column], overlap: bool = False) -> Column:
        """array<struct<at, n>>: where find gives a number of tokens; with `overlap` none that begins inside an earlier one."""
        all_ = F.filter(F.transform(self.both["word"], lambda w, i: F.struct(i.alias("at"), F.coalesce(find(i), F.lit(0)).cast("int").alias("n"))), lambda h: h["n"] > 0)
        if not overlap:
            return all_
        zero = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{HIT}>").alias("hits"))
        keep = lambda a, h: F.when(h["at"] >= a["end"], F.struct((h["at"] + h["n"]).alias("end"), F.concat(a["hits"], F.array(h)).alias("hits"))).otherwise(a)
        return let(all_, lambda found: F.when(F.size(found) < 2, found).otherwise(F.aggregate(found, zero, keep, lambda a: a["hits"])))

    def rebuilt(self, done: Column, lead: bool = True, eat: bool = False) -> Column:
        """The line with the text `new` of each hit in its place, null for none. Without `lead` the white space before a
        replaced hit goes, with `eat` that behind it."""

        def between(last: Column, stop: Column) -> Column:
            start = F.coalesce(last["at"] + last["n"], F.lit(0))
            text = self.piece(start, stop - start)
            return F.when(last["new"].isNotNull(), F.regexp_replace(text, r"^\s+", "")).otherwise(text) if eat else text

        def one(d: Column, k: Column) -> Column:
            as_it_is = self.piece(d["at"], d["n"])
            new = F.concat(self.gap(d["at"]), d["new"]) if lead else d["new"]
            return F.concat(between(F.get(done, k - 1), d["at"]), F.coalesce(new, as_it_is))

        return F.concat(F.array_join(F.transform(done, one), ""), between(F.get(done, F.size(done) - 1), self.size()))


def read(text: Column, body: Callable[[Tokens], Column]) -> Column:
    """body(tokens of the text), the text being taken apart once."""
    both = F.struct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)).alias("gap"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(2)).alias("word"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("all"))
    return let(both, lambda c: body(Tokens(c)))
