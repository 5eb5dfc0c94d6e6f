"""Operator 10: secret scans through a trigram inverted index, on DataFrame functions alone.

From each rule's regular expression a Boolean trigram query is derived: a text that matches must hold all trigrams of one
of its alternatives. The index lists, for blocks of documents, the documents with each trigram that some query asks for;
postings are intersected and united as the query says, and only candidates are verified. Rules without a mandatory trigram
(the hex rule) scan every text.

Index keys are hashes of id and text. Two rows with one key are both candidates, and candidates are verified on their text, so
a collision costs time and no result. The candidates are few, but grow with the input: they are counted, and up to
`BROADCAST_ROWS` are sent to the documents where these stand, so that no text is shuffled; beyond that both are dealt by key.

Defined cases: null and empty texts hold nothing. Repeated rows are scanned alike; rows without an id keep their null id.
Matches are leftmost and do not overlap within a kind; kinds may overlap each other, spans of one start stand in the order
of the rules. Very long texts are scanned whole. Extra columns, whatever their names, are kept by `redact` and ignored by
`scan`. An empty table gives an empty result. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, row_key
from .exprs import count_of, let


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of the pattern whose group has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    # The header; behind it the fields of an encrypted key, lines of base64 (line ends may be written as \\n; a line has 32
    # signs or more, but for the last one, which ends in =, stands before the END line or is cut off by the end of the text),
    # and the END line. Prose behind a mere mention of the header is none of these.
    Rule(
        "private_key",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:@(?:Proc-Type|DEK-Info):[A-Za-z0-9,\x20-]*){0,2}(?:(?:@[A-Za-z0-9+/]{32,}={0,2})+(?:@[A-Za-z0-9+/]{0,31}={0,2}@END|@[A-Za-z0-9+/]{1,31}(?:={1,2}|$))?|@[A-Za-z0-9+/]{0,31}={0,2}@END)?".replace(
            "@END", "@-----END [A-Z ]*PRIVATE KEY-----"
        ).replace("@", r"(?:[\x20\x09-\x0D]|\\[nr])*"),
    ),
)
BASE = ("assign", "access", "hex")
#: Documents in a block of the index.
BLOCK_ROWS = 20_000
#: Candidates up to which they are broadcast.
BROADCAST_ROWS = 500_000


def trigram_query(pattern: str) -> list[list[str]] | None:
    """Alternatives of lower-case trigrams, or None if some text can match without any."""

    def join(left: list[list[str]], right: list[list[str]]) -> list[list[str]]:
        """Concatenate: each alternative is a list of literal runs; the last run is still open."""
        return [a[:-1] + [a[-1] + b[0]] + b[1:] for a in left for b in right]

    def walk(tree: list) -> list[list[str]]:
        out = [[""]]
        for op, arg in tree:
            if op is C.LITERAL:
                part = [[chr(arg).lower()]]
            elif op is C.SUBPATTERN:
                part = walk(arg[-1])
            elif op is C.BRANCH:
                part = [x for branch in arg[1] for x in walk(branch)]
            elif op is C.IN and len(arg) <= 8 and all(k is C.LITERAL for k, _ in arg):
                part = [[chr(x).lower()] for _, x in arg]
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1 and arg[0] <= 8:
                part = [[""]]
                for _ in range(arg[0]):
                    part = join(part, walk(arg[2]))
                if arg[1] != arg[0]:
                    part = [x + [""] for x in part]
            else:  # any character, an optional part, an anchor: the run ends
                part = [["", ""]]
            out = join(out, part)
            if len(out) > 64:
                return [["", ""]]
        return out

    found = [sorted({run[i : i + 3] for run in runs for i in range(len(run) - 2)}) for runs in walk(list(_parser.parse(pattern)))]
    return None if any(not x for x in found) else found


def trigram_index(documents: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text", n_blocks: int = 1) -> DataFrame:
    """Postings: block, trigram, keys of the block's documents that hold it."""
    low = F.lower(F.col(text_col))
    have = let(low, lambda t: F.filter(F.array(*[F.lit(x) for x in trigrams]), lambda x: F.contains(t, x)))
    rows = documents.where(F.col(text_col).isNotNull()).select(row_key(id_col, text_col).alias("key"), have.alias("have"))
    return rows.select("key", F.explode("have").alias("trigram")).groupBy(F.pmod(F.col("key.a"), F.lit(n_blocks)).alias("block"), "trigram").agg(F.collect_set("key").alias("keys"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, kinds): the documents that a rule's trigram query leaves, by intersecting and uniting postings."""
    postings = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("p"))
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")

    def evaluate(query: list[list[str]]) -> Column:
        alternatives = []
        for trigrams in query:
            both = None
            for t in trigrams:
                keys = F.coalesce(F.element_at("p", F.lit(t)), none)
                both = keys if both is None else F.array_intersect(both, keys)
            alternatives.append(both)
        out = alternatives[0]
        for x in alternatives[1:]:
            out = F.array_union(out, x)
        return out

    asked = [(r.kind, q) for r in rules if (q := trigram_query(r.pattern)) is not None]
    per_rule = F.array(*[F.struct(F.lit(kind).alias("kind"), evaluate(q).alias("keys")) for kind, q in asked])
    pairs = postings.select(F.explode(per_rule).alias("x")).select(F.col("x.kind").alias("kind"), F.explode("x.keys").alias("key"))
    return pairs.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end, kind) of a rule's matches. The pieces between matches give the positions."""
    kind = "array<struct<start:int,order:int,end:int,kind:string>>"

    def place(m: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))

        def step(a: Column, x: Column) -> Column:
            start = a["at"] + F.length(x["piece"])
            end = start + F.length(x["whole"])
            hit = F.array(F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind")))
            return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= rule.least, F.concat(a["found"], hit)).otherwise(a["found"]).alias("found"))

        return F.aggregate(F.slice(m, 1, F.size(m) - 1), zero, step, lambda a: a["found"])

    pieces = F.split(text, rule.pattern)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    zipped = F.arrays_zip(pieces.alias("piece"), whole.alias("whole"), part.alias("part"))
    return F.when(text.rlike(rule.pattern), let(zipped, place)).otherwise(F.array().cast(kind))


def with_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, spans_col: str = "spans") -> DataFrame:
    """documents with a further column of spans: all matches by start, then by the rules' order."""
    key, kinds = free_name(documents, "key"), free_name(documents, "kinds")
    trigrams = sorted({t for r in rules for a in trigram_query(r.pattern) or [] for t in a})
    n_blocks = max(1, -(-documents.count() // BLOCK_ROWS))
    index = trigram_index(documents, trigrams, id_col, text_col, n_blocks)
    found = cut(candidates(index, rules).select(F.col("key").alias(key), F.col("kinds").alias(kinds)))
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = documents.withColumn(key, row_key(id_col, text_col)).join(F.broadcast(found) if few else found, key, "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    empty = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    parts = []
    for order, rule in enumerate(rules):
        spans = spans_of(text, rule, order)
        if trigram_query(rule.pattern) is not None:
            spans = F.when(F.array_contains(F.coalesce(kinds, F.array().cast("array<string>")), rule.kind), spans).otherwise(empty)
        parts.append(spans)
    return rows.withColumn(spans_col, F.sort_array(F.concat(*parts))).drop(key, kinds)


def _is_kind(kind: str, span: Column) -> Column:
    return span["kind"] == kind


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, and all spans as kind:start:end."""
    df = with_spans(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rules=rules)
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return df.select(
        "doc_id",
        *[count_of(F.col("spans"), partial(_is_kind, kind)).alias(f"n_{kind}") for kind in BASE],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def redact(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """documents with every secret replaced by a mark (overlapping ones by one); other columns stay."""
    spans = free_name(documents, "spans")
    df = with_spans(documents, id_col, text_col, rules, spans)
    text = F.col(text_col)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        between = F.when(x["start"] >= a["at"], F.concat(text.substr(a["at"] + 1, x["start"] - a["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.concat(a["out"], between).alias("out"))

    done = F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text))))
    return df.withColumn(text_col, F.when(F.size(spans) > 0, done).otherwise(text)).drop(spans)
