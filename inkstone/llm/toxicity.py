"""Operator 12: toxicity, a factorization machine over hashed terms.

A document's terms are its different words, lower case, and the starts of these words (`STARTS` characters), each by a 64-bit
hash. A term has a weight and a vector; a document's margin is the sum of its terms' weights and of the products of the
vectors of every two of its terms, so a pair of terms can say what neither says alone.

Terms are counted, by label, over all rows that may be learnt from; of those that stand in enough documents, the `FEATURES`
that tell most about the label are kept. The machine is fitted on the driver from at most some `SAMPLE` of these rows, chosen by
a hash of the id, of which only the kept terms are collected. Executors score all documents with the kept terms alone.

Labels are learnt only from rows whose crc32(doc_id as text) mod 3 is not 1. Labels, lang, source and doc_id are never inputs
of a score.

Defined cases: null and empty texts have no terms; their score follows from the machine's constant. Very long texts are read
whole, a word that repeats counts once. Repeated rows get the same score; of two labels of an id the larger counts, and every
row of a labelled id is learnt from. Unlabelled rows are scored. Terms that tell equally much are kept by their hash. Without
labels, or with labels of one kind, every score is that share (0.5 without any). Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SAMPLE, FEATURES, STARTS, LEAST_DOCS, SURPRISE, THRESHOLD = 20_000, 1 << 13, (4, 5, 6), 3, 12.0, 0.7
#: Factors of a term, steps, rows of a step, rate, ridge, and the share of the rate at which vectors are learnt: what a term
#: says alone is learnt first.
FACTORS, STEPS, STEP_ROWS, RATE, RIDGE, PAIRS = 8, 5000, 128, 0.1, 2e-6, 0.1
WORD = re.compile(r"[^\W\d_]+")


def hashed_terms(text: str | None) -> np.ndarray:
    """The hashes of a text's different terms, as signed longs in order."""
    words = set(WORD.findall((text or "").lower()))
    digest = xxhash.xxh64_intdigest
    found = [digest(w, 0) for w in words]
    for n in STARTS:  # a start and a word of the same letters are different terms
        found += [digest(w, n) for w in {w[:n] for w in words if len(w) >= n}]
    return np.unique(np.array(found, np.uint64).view(np.int64))


@dataclass
class Machine:
    """A factorization machine: its terms' hashes in order, a weight and a vector for each, and the constant."""

    terms: np.ndarray
    weight: np.ndarray
    factors: np.ndarray
    start: float

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where the known ones among some hashes stand."""
        if not len(self.terms):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return at[self.terms[at] == hashes]

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        """Margins of documents, each given by the places of its terms."""
        counts = np.array([len(x) for x in rows], np.int64)
        out = np.full(len(rows), self.start)
        if counts.sum():
            at, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), counts)
            v = self.factors[at]
            total = np.zeros((len(rows), v.shape[1]))
            np.add.at(total, row, v)
            out += np.bincount(row, self.weight[at] - 0.5 * (v * v).sum(1), len(rows)) + 0.5 * (total * total).sum(1)
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -30, 30)))


def fit(terms: np.ndarray, rows: list[np.ndarray], y: np.ndarray, factors: int = FACTORS, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE, seed: int = 12) -> Machine:
    """A machine for a binary target by AdaGrad steps of the logistic loss, in which both labels weigh alike; rows hold places
    of terms."""
    share = float(y.mean()) if len(y) else 0.5
    machine = Machine(terms, np.zeros(len(terms)), np.zeros((len(terms), factors)), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if share in (0.0, 1.0) or not len(y) or not len(terms):
        return machine
    rng = np.random.default_rng(seed)
    # A term's ridge is dealt over its rows, so that a rare term can't learn a row by heart.
    ridge = ridge * len(y) / np.maximum(1, np.bincount(np.concatenate(rows).astype(np.int64), minlength=len(terms)))
    machine.factors = rng.normal(0, 0.01, (len(terms), factors))
    seen_w, seen_v, seen_0 = np.full(len(terms), 1e-3), np.full((len(terms), factors), 1e-3), 1e-3
    weigh = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    for _ in range(-(-steps * STEP_ROWS // len(y))):
        order = rng.permutation(len(y))
        for a in range(0, len(y), STEP_ROWS):
            own = order[a : a + STEP_ROWS]
            counts = np.array([len(rows[i]) for i in own])
            at = np.concatenate([rows[i] for i in own]).astype(np.int64)
            row = np.repeat(np.arange(len(own)), counts)
            v = machine.factors[at]
            total = np.zeros((len(own), factors))
            np.add.at(total, row, v)
            margin = machine.start + np.bincount(row, machine.weight[at] - 0.5 * (v * v).sum(1), len(own)) + 0.5 * (total * total).sum(1)
            error = weigh[own] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[own])
            slope_0 = float(error.mean())
            seen_0 += slope_0 * slope_0
            machine.start -= rate * slope_0 / np.sqrt(seen_0)
            touched, place = np.unique(at, return_inverse=True)
            slope_w = np.bincount(place, error[row], len(touched)) / len(own) + ridge[touched] * machine.weight[touched]
            slope_v = np.zeros((len(touched), factors))
            np.add.at(slope_v, place, error[row, None] * (total[row] - v))
            slope_v = slope_v / len(own) + ridge[touched, None] * machine.factors[touched]
            seen_w[touched] += slope_w * slope_w
            seen_v[touched] += slope_v * slope_v
            machine.weight[touched] -= rate * slope_w / np.sqrt(seen_w[touched])
            machine.factors[touched] -= PAIRS * rate * slope_v / np.sqrt(seen_v[touched])
    return machine


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [hashed_terms(x) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(found, pa.list_(pa.int64()))], names=["id", "y", "terms"])


def chosen_terms(rows: DataFrame, features: int = FEATURES, least: int = LEAST_DOCS) -> np.ndarray:
    """The terms that tell most about y: by the square of the difference between their rows of label 1 and those that chance would
    give them, over its variance (`SURPRISE` at least). rows: y, terms. Counts are of all rows, combined before they are shuffled."""
    n, ones = rows.agg(F.count("*"), F.sum("y")).first()
    share = float(ones or 0) / max(1, n)
    counted = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).where(F.col("n") >= least)
    surprise = F.pow(F.col("ones") - F.col("n") * share, 2) / (F.col("n") * max(share * (1 - share), 1e-9))
    best = counted.select("term", surprise.alias("s")).where(F.col("s") >= SURPRISE).orderBy(F.col("s").desc(), "term").limit(features).select("term").collect()
    return np.sort(np.array([r["term"] for r in best], np.int64))


def _places(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [machine.places(np.array(x, np.int64)) for x in batch.column("terms").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(found, pa.list_(pa.int64()))], names=["id", "y", "places"])


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, features: int = FEATURES) -> Machine:
    """A machine from the labelled rows outside the held-out part."""
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < F.lit(int((1 << 20) * sample / n)))
    # Some 20,000 ids and labels at most: bounded by `sample`, so they may be broadcast.
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id").select("id", "y", "text")
    kind = dict(rows.dtypes)["id"]
    made = cut(rows.mapInArrow(_term_rows, f"id {kind}, y double, terms array<bigint>"))
    terms = chosen_terms(made, features)
    empty = Machine(terms, np.zeros(0), np.zeros((0, 0)), 0.0)
    # Rows that repeat an id bring one row, that of the smallest terms, so that the sample stays bounded.
    local = made.mapInArrow(lambda b: _places(b, empty), f"id {kind}, y double, places array<bigint>").groupBy("id", "y").agg(F.min("places").alias("places")).toPandas()
    local = local.assign(key=[xxhash.xxh64_intdigest(str(i)) for i in local["id"]]).sort_values("key", kind="stable")
    return fit(terms, [np.array(x, np.int64) for x in local["places"]], local["y"].to_numpy(np.float64))


def _score(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = [machine.places(hashed_terms(x.as_py())) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(machine.scores(places))], names=["doc_id", "held_out", "score"])


def score(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score (likelihood of label 1) and predicted."""
    machine = documents.sparkSession.sparkContext.broadcast(train(documents, labels, id_col, text_col, label_col, sample))
    rows = documents.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(lambda b: _score(b, machine.value), f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
