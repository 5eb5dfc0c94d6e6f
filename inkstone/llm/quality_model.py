"""Operator 4: a quality classifier, histogram gradient-boosted trees over document statistics.

Statistics come from built-in functions. The trees grow on the driver from a bounded sample of labelled rows (`SAMPLE`
rows at most, chosen by a hash of the id), level by level over binned features, and are flattened into arrays: feature,
threshold and left child of each node. Executors walk all trees of a batch through these arrays at once.

Labels are learnt only from rows whose crc32(doc_id as text) mod 5 is not 0. Labels, lang, source and doc_id are never
inputs of a score.

Defined cases: null and empty texts are scored like any other (all statistics 0), very long ones as a whole. Repeated rows
get the same score; of rows that repeat a labelled id with other texts the trees see one, and of two labels of an id the
larger. Ties between splits go to the first feature and the smallest threshold.
Unlabelled rows are scored. Without labels, or with labels of one kind, every score is that share (0.5 without any).
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import let, words
from .quality_rules import figures

SAMPLE, TREES, DEPTH, RATE, BINS, THRESHOLD = 20_000, 80, 4, 0.15, 64, 0.3


def statistics(text: Column) -> Column:
    """The inputs of the classifier, one array of doubles."""
    text = F.coalesce(text, F.lit(""))
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    letters = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("double")

    def more(f: Column) -> Column:
        n, chars = f["n_words"], F.length(text)
        return let(
            words(text),
            lambda w: F.array(
                F.log1p(n.cast("double")), F.log1p(chars.cast("double")), f["mean_word_chars"], f["symbol_ratio"], f["stop_word_ratio"], f["alpha_word_ratio"], f["capital_word_ratio"], f["dup_line_ratio"], f["bullet_line_ratio"],
                f["ellipsis_line_ratio"], share(f["n_repeat_words"], n), share(F.size(F.array_distinct(w)), n), share(letters(r"[^\p{Lu}]+"), chars), share(letters(r"[^0-9]+"), chars), share(letters(r"[^\p{P}]+"), chars),
                share(letters(r"[^\p{L}]+"), chars), share(letters(r"[^!?]+"), n), share(letters(r"[^|]+"), n), share(letters(r"[^\n]+"), n),
            ),
        )

    return F.transform(let(figures(text), more), lambda x: x.cast("double"))


@dataclass
class Trees:
    """All trees in flat arrays. Nodes of a tree follow one another; a leaf has feature -1 and its value in `value`."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray  # the right child stands behind it
    value: np.ndarray
    start: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row reaches: rows and trees advance together, a level at a time."""
        out = np.full(len(x), self.start)
        if not len(self.root):
            return out
        at = np.repeat(self.root[None, :], len(x), axis=0)
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return out + self.value[at].sum(1)
            goes_right = np.take_along_axis(x, np.maximum(feature, 0), 1) > self.threshold[at]
            at = np.where(inner, self.left[at] + goes_right, at)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, least: int = 20, ridge: float = 1.0) -> Trees:
    """Boosted trees for a binary target. Splits are sought in histograms of gradients; ties take the first feature and bin."""
    n, width = x.shape if x.size else (0, 0)
    share = float(y.mean()) if len(y) else 0.5
    start = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    flat: dict[str, list] = {"feature": [], "threshold": [], "left": [], "value": []}
    roots: list[int] = []
    if n < 2 * least or share in (0.0, 1.0):
        return Trees(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), start)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    margin = np.full(n, start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = y - p, p * (1 - p)
        node, base = np.zeros(n, np.int64), len(flat["feature"])
        roots.append(base)
        for values, empty in zip(flat.values(), (-1, 0.0, -1, 0.0), strict=True):
            values.append(empty)
        level = {0: base}  # node of the level -> place
        for step in range(depth + 1):
            size = max(level) + 1
            live = node >= 0
            total = [np.bincount(node[live], w[live], size) for w in (gradient, curve)]
            for k, place in level.items():
                flat["value"][place] = rate * total[0][k] / (total[1][k] + ridge)
            if step == depth:
                break
            gains = []
            for j in range(width):
                cell = node[live] * bins + binned[live, j]
                g, h, c = (np.bincount(cell, w, size * bins).reshape(size, bins).cumsum(1)[:, : len(edges[j])] for w in (gradient[live], curve[live], np.ones(int(live.sum()))))
                g2, h2, c2 = total[0][:, None] - g, total[1][:, None] - h, np.bincount(node[live], minlength=size)[:, None] - c
                gain = g * g / (h + ridge) + g2 * g2 / (h2 + ridge) - (total[0] ** 2 / (total[1] + ridge))[:, None]
                gains.append(np.pad(np.where((c >= least) & (c2 >= least), gain, -1.0), ((0, 0), (0, bins - gain.shape[1])), constant_values=-1.0))
            gains = np.stack(gains, 1).reshape(size, -1)
            best = gains.argmax(1)
            following, place_of = {}, np.full(size, -1, np.int64)
            for k, place in level.items():
                if gains[k, best[k]] > 1e-6:
                    j, cut = divmod(int(best[k]), bins)
                    flat["feature"][place], flat["threshold"][place], flat["left"][place] = j, float(edges[j][cut]), len(flat["feature"])
                    place_of[k] = len(following)
                    for _side in (0, 1):
                        following[len(following)] = len(flat["feature"])
                        for values, empty in zip(flat.values(), (-1, 0.0, -1, 0.0), strict=True):
                            values.append(empty)
            moved = np.full(n, -1, np.int64)
            own = np.flatnonzero(live)
            own = own[place_of[node[own]] >= 0]
            j, cut = np.divmod(best[node[own]], bins)
            moved[own] = place_of[node[own]] + (binned[own, j] > cut)
            node, level = moved, following
            if not level:
                break
        tree = Trees(np.array([base]), *(np.array(flat[k]) for k in ("feature", "threshold", "left", "value")), 0.0)
        margin = margin + tree.margins(x)
    return Trees(np.array(roots), np.array(flat["feature"]), np.array(flat["threshold"]), np.array(flat["left"]), np.array(flat["value"]), start)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees from at most about `sample` labelled rows outside the held-out fold."""
    rows = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < F.lit(int((1 << 20) * sample / n)))
    # The sample is bounded by its parameter: some 20,000 ids and labels are broadcast, as many rows of statistics return.
    # Of the rows that repeat an id one counts, that of the smallest statistics, so no id brings more than one row.
    picked = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(rows), "id").select("id", "y", statistics(F.col("text")).alias("x"))
    local = picked.groupBy("id", "y").agg(F.min("x").alias("x")).toPandas().sort_values("id", kind="stable")
    x = np.array(local["x"].tolist(), np.float64).reshape(len(local), -1 if len(local) else 1)
    order = np.lexsort(x.T[::-1]) if len(local) else []
    return grow(x[order], local["y"].to_numpy(np.float64)[order])


def _score(batches: Iterator[pa.RecordBatch], trees: Trees) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("x")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        out = np.concatenate([trees.scores(x[a : a + 4096]) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out)], names=["doc_id", "held_out", "score"])


def score(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score (likelihood of label 1) and predicted."""
    trees = documents.sparkSession.sparkContext.broadcast(train(documents, labels, id_col, text_col, label_col, sample))
    rows = documents.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), statistics(F.col(text_col)).alias("x"))
    kind = dict(rows.dtypes)["doc_id"]
    scored = rows.mapInArrow(lambda b: _score(b, trees.value), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
