"""Page-level results: the merged document, counts, uploads, overlays and the response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import latex as L
from .rules import blocking

MIME = ("image/png", "image/jpeg", "image/webp", "image/gif")


def upload_error(mime: Column, size: Column, max_mb: int = 10) -> Column:
    """The first check that an upload fails: kind, then emptiness, then size; null if none."""
    return F.when(~F.coalesce(mime.isin(*MIME), F.lit(False)), 415).when(size == 0, 400).when(size > max_mb * (1 << 20), 413).cast("int")


def error_row(code: Column, detail: Column) -> Column:
    return F.when(code.isNotNull(), F.struct(F.lit("error").alias("status"), detail.alias("detail")))


def data_url(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s+", ""))


def _document(text: Column) -> Column:
    """The aggregate that joins a page's lines in order, a blank line between; blank rows and empty lines go."""
    rows = F.filter(F.split(L.strip_fences(F.trim(text)), r"\r\n|\n|\r"), lambda r: ~r.rlike(r"(?U)^\s*$"))
    clean = F.array_join(F.transform(rows, lambda r: F.regexp_replace(r, r"(?U)\s+$", "")), "\n")
    listed = F.array_sort(F.collect_list(F.struct("idx", clean.alias("t"))))
    return F.array_join(F.transform(F.filter(listed, lambda x: x["t"] != ""), lambda x: x["t"]), "\n\n")


def _counts() -> dict[str, Column]:
    """The aggregates of a page's verified lines, by name."""
    corrections = F.size(F.filter("issues", lambda i: i["fixed"] & i["content"]))
    by_status = {s: F.count_if(F.col("status") == s) for s in ("green", "yellow", "grey")}
    failed = F.col("error").isNotNull()
    return {"lines": F.count("*"), **by_status, "failed": F.count_if(failed), "corrections": F.sum(corrections), "open_issues": F.sum(F.size(blocking(F.col("issues")))), "all_failed": F.bool_and(failed)}


def merge_lines(lines: DataFrame, text: str = "latex") -> DataFrame:
    """(page_id, document): a page's lines in order, a blank line between; blank rows and empty lines go."""
    return lines.groupBy("page_id").agg(_document(F.col(text)).alias("document"))


def page_counts(verified: DataFrame) -> DataFrame:
    """Counts a page: lines by status, failed lines, corrections; all_failed says whether no line succeeded."""
    return verified.groupBy("page_id").agg(*[c.alias(name) for name, c in _counts().items()])


def response(verified: DataFrame) -> DataFrame:
    """(page_id, json): the nested result of each page, lines in order; partial if a line has an error. One aggregation, so
    the lines are verified once."""
    line = F.struct("idx", "kind", "latex", "raw", "status", "error", "issues")
    ordered = F.array_sort(F.collect_list(line), lambda a, b: (a["idx"] - b["idx"]).cast("int"))
    counts = {name: c for name, c in _counts().items() if name in ("green", "yellow", "grey", "corrections", "failed")}
    pages = verified.groupBy("page_id").agg(_document(F.col("latex")).alias("document"), ordered.alias("lines"), *[c.alias(name) for name, c in counts.items()])
    verification = F.struct("green", "yellow", "grey", "corrections").alias("verification")
    body = F.struct(F.when(F.col("failed") > 0, "partial").otherwise("success").alias("status"), F.col("document").alias("latex"), verification, "lines")
    return pages.select("page_id", F.to_json(body).alias("json"))


def overlay(regions: DataFrame) -> DataFrame:
    """What a preview draws: a rectangle, a label and a colour for each region (page_id, idx, kind, bbox)."""
    colour = F.when(F.col("kind") == "table", "orange").when(F.col("kind") == "diagram", "purple").when(F.col("idx") % 3 == 0, "red").when(F.col("idx") % 3 == 1, "green").otherwise("blue")
    tag = F.when(F.col("kind") == "table", " T").when(F.col("kind") == "diagram", " D").otherwise("")
    return regions.select("page_id", "idx", "bbox.x", "bbox.y", "bbox.w", "bbox.h", F.concat((F.col("idx") + 1).cast("string"), tag).alias("label"), colour.alias("colour"))


def append_cache(rows: DataFrame, path: str, by: str) -> None:
    rows.write.mode("append").partitionBy(by).parquet(path)


def fresh_cache(current: DataFrame, cached: DataFrame) -> DataFrame:
    """Cached pages that still hold: today's boxes are none or equal the cached ones, in order.
    Both: page_id, boxes (an ordered array); cached also has payload."""
    both = cached.alias("c").join(current.alias("n"), "page_id", "left")
    valid = F.col("n.boxes").isNull() | (F.size("n.boxes") == 0) | (F.col("n.boxes") == F.col("c.boxes"))
    return both.where(valid).select("page_id", "c.payload")
