"""Model calls over rows: a call that fails costs its own row alone, a call answered before is not repeated.

A reader is a function from a batch of rows to answers. What it raises for a batch is found again row by row, so that the other
rows of the batch keep their answers and the failing ones get an error."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import latex as L
from .components import checkpointed
from .pages import data_url

Reader = Callable[[pd.DataFrame], pd.Series]
ANSWER = "key string, answer string, error string"


def isolated(reader: Reader, batch: pd.DataFrame) -> pd.DataFrame:
    """answer and error of each row of a batch."""
    try:
        answers = list(reader(batch))
        if len(answers) != len(batch):
            raise ValueError(f"{len(answers)} answers to {len(batch)} calls")
        return pd.DataFrame({"answer": [None if a is None or a != a else str(a) for a in answers], "error": None}, index=batch.index, dtype=object)
    except Exception as failure:  # whatever a model's client raises
        if len(batch) == 1:
            return pd.DataFrame({"answer": [None], "error": [f"{type(failure).__name__}: {failure}"]}, index=batch.index, dtype=object)
        return pd.concat([isolated(reader, batch.iloc[i : i + 1]) for i in range(len(batch))])


def _asked(calls: DataFrame, readers: dict[str, Reader], kind: str | None) -> DataFrame:
    """(key, answer, error) of calls; kind is the column that names a row's reader, or None where there is one reader."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [(next(iter(readers)), batch)] if kind is None else list(batch.groupby(kind, sort=False))
            for name, part in parts:
                made = isolated(readers[name], part) if name in readers else pd.DataFrame({"answer": None, "error": f"no reader for {name}"}, index=part.index, dtype=object)
                yield pd.DataFrame({"key": part["key"], "answer": made["answer"], "error": made["error"]})

    return calls.mapInPandas(run, ANSWER)


def answered(calls: DataFrame, cache: DataFrame | None, readers: Reader | dict[str, Reader], kind: str | None = None) -> DataFrame:
    """(key, answer, error) of each distinct call: known ones from the cache (key, answer), the others asked once each."""
    wanted = calls.dropDuplicates(["key"])
    readers = readers if isinstance(readers, dict) else {"": readers}
    if cache is None:
        return _asked(wanted, readers, kind)
    known = cache.groupBy("key").agg(F.min(F.col("answer").cast("string")).alias("answer"))
    found = wanted.select("key").join(known, "key").withColumn("error", F.lit(None).cast("string"))
    return found.unionByName(_asked(wanted.join(known, "key", "left_anti"), readers, kind))


def transcribe_regions(regions: DataFrame, readers: dict[str, Reader], cache: DataFrame | None = None) -> DataFrame:
    """page_id, idx, kind, latex, error, image_url of regions(page_id, idx, kind, mime, image): each is read by its kind.

    Tables whose reading runs in a loop are read again as a line. Diagrams are described: a placeholder with the description
    (without one where the call fails) and the image itself. Unknown kinds are read as lines. Answers are written before they
    are used, so that a lost executor asks nothing twice."""
    kind = F.when(F.col("kind").isin(*readers), F.col("kind")).otherwise("line")
    key = lambda reader: F.concat_ws(":", reader, F.sha1("image"))
    rows = regions.withColumns({"reader": kind, "key": key(kind)})
    first = checkpointed(answered(rows.select("key", "reader", "mime", "image"), cache, readers, "reader"))
    read = rows.join(first, "key", "left")
    loops = (F.col("reader") == "table") & F.col("answer").isNotNull() & L.is_degenerate(F.coalesce("answer", F.lit("")))
    anew = read.where(loops).select(key(F.lit("line")).alias("key"), F.lit("line").alias("reader"), "mime", "image")
    second = checkpointed(answered(anew, cache, readers, "reader")).select(F.col("key").alias("second"), F.col("answer").alias("again"), F.col("error").alias("failure"))
    both = read.withColumn("second", F.when(loops, key(F.lit("line")))).join(second, "second", "left")
    diagram = F.col("reader") == "diagram"
    text = F.when(F.col("second").isNotNull(), F.col("again")).otherwise(F.col("answer"))
    error = F.when(F.col("second").isNotNull(), F.col("failure")).otherwise(F.col("error"))
    return both.select(
        "page_id", "idx", "kind", F.when(diagram, L.figure_placeholder(F.col("answer"))).otherwise(F.coalesce(text, F.lit(""))).alias("latex"),
        F.when(~diagram, error).alias("error"), F.when(diagram, data_url(F.col("mime"), F.col("image"))).alias("image_url"),
    )
