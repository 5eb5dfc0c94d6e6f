"""Error rates of predicted against gold lines, at several grains, and what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import latex as L
from .components import checkpointed
from .reask import rank


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt anew by all that they hold: the work on a line grows faster than its length, long lines stand together in their
    document, and a line that many documents have is not one task's. A given number of partitions is not lowered by Spark."""
    hashable = [name for name, kind in rows.dtypes if "map<" not in kind]
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*hashable))


def distances(rows: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """rows with character and token distances of the normal forms and the gold's lengths.

    Without a command every token is one character and the two distances are one."""
    df = dealt(rows).withColumn("__g", L.normalise(F.col(gold)))
    df = df.withColumn("__p", F.when(F.col(pred) == F.col(gold), F.col("__g")).otherwise(L.normalise(F.col(pred))))
    p, g, command = F.col("__p"), F.col("__g"), F.lit("\\")
    spelt, listed = F.contains(p, command) | F.contains(g, command), F.contains(g, command)
    df = df.withColumns({"__c": L.edit_distance(p, g), "__t": L.token_distance(*[F.when(spelt & (p != g), L.tokens(x)) for x in (p, g)])})
    tokens = F.when(spelt & (p != g), F.col("__t")).otherwise(F.col("__c"))
    gold_tokens = F.when(listed, F.size(L.tokens(g))).otherwise(F.length(g))
    return df.withColumns({"char_errors": F.col("__c").cast("long"), "gold_chars": F.length(g).cast("long"), "token_errors": tokens.cast("long"), "gold_tokens": gold_tokens.cast("long"), "exact": p == g}).drop("__p", "__g", "__c", "__t")


def totals(scored: DataFrame, *grains: str) -> DataFrame:
    """Micro-averaged rates overall and for each value of each grain, in one pass over grouping sets."""
    sets = [[], *[[F.col(g)] for g in grains]]
    out = scored.groupingSets(sets, *grains).agg(
        F.count("*").alias("regions"), F.sum("char_errors").alias("char_errors"), F.sum("gold_chars").alias("gold_chars"), F.sum("token_errors").alias("token_errors"), F.sum("gold_tokens").alias("gold_tokens"), F.count_if("exact").alias("exact"),
        (F.sum("char_errors") / F.greatest(F.lit(1), F.sum("gold_chars"))).alias("cer"), (F.sum("token_errors") / F.greatest(F.lit(1), F.sum("gold_tokens"))).alias("ter"), F.grouping_id(*grains).cast("long").alias("grain"),
    )
    return out


def worst_status(regions: DataFrame, matched: DataFrame) -> DataFrame:
    """A region's status is the worst of its lines', `unmatched` without any. regions: page_id, region_id; matched adds status."""
    names = F.array(*[F.lit(x) for x in ("green", "yellow", "grey")])
    worst = matched.groupBy("page_id", "region_id").agg(F.max(rank(F.col("status"))).alias("r"))
    return regions.join(worst, ["page_id", "region_id"], "left").select("page_id", "region_id", F.when(F.col("r").isNull(), "unmatched").otherwise(F.coalesce(F.get(names, F.col("r")), F.lit("none"))).alias("status"))


def most_changed(rows: DataFrame, n: int, before: str, after: str, *seq: str) -> DataFrame:
    """The n rows that lost most errors; equal ones in their own order."""
    return rows.withColumn("gain", F.col(before) - F.col(after)).where("gain <> 0").orderBy(F.col("gain").desc(), *seq).limit(n)


SUMS = ("char_errors", "gold_chars", "token_errors", "gold_tokens")


def by_variant(rows: DataFrame, variants: dict[str, tuple[str, str | None]], *keep: str) -> DataFrame:
    """One scored row a region and variant: the kept columns, gold, variant, pred, status and what `distances` adds. variants:
    name -> (column of the reading, column of its status or None). A null reading counts as an empty one; a region without a
    status is `unmatched` in a variant that has statuses. A reading that several variants of a region share is scored once."""

    def one(name: str, pred: str, status: str | None) -> Column:
        known = F.coalesce(F.col(status), F.lit("unmatched")) if status else F.lit(None).cast("string")
        return F.struct(F.lit(name).alias("variant"), F.coalesce(F.col(pred), F.lit("")).alias("pred"), known.alias("status"))

    each = rows.select(*keep, F.coalesce("gold", F.lit("")).alias("gold"), F.array(*[one(name, *columns) for name, columns in variants.items()]).alias("__vs"))
    read = each.select("*", F.explode(F.array_distinct(F.col("__vs.pred"))).alias("pred"))
    held = F.transform(F.filter("__vs", lambda v: v["pred"] == F.col("pred")), lambda v: F.struct(v["variant"].alias("variant"), v["status"].alias("status")))
    scored = distances(read.select(*keep, "gold", "pred", held.alias("__held"))).withColumn("__v", F.explode("__held"))
    return scored.select(*keep, "gold", "__v.variant", "pred", "__v.status", *SUMS, "exact")


def variant_totals(scored: DataFrame, by: str) -> DataFrame:
    """(grain, variant, status, by, regions, sums, exact, cer, ter): totals of each variant (grain `all`), of its statuses
    (`status`) and of each value of `by` (`by`), from one aggregation over grouping sets."""
    v, s, b = F.col("variant"), F.col("status"), F.col(by)
    grain = F.when(F.grouping("status") == 0, "status").when(F.grouping(by) == 0, "by").otherwise("all")
    out = scored.groupingSets([[v], [v, s], [v, b]], v, s, b).agg(
        grain.alias("grain"), F.count("*").alias("regions"), *[F.sum(c).alias(c) for c in SUMS], F.count_if("exact").alias("exact"),
        (F.sum("char_errors") / F.greatest(F.lit(1), F.sum("gold_chars"))).alias("cer"), (F.sum("token_errors") / F.greatest(F.lit(1), F.sum("gold_tokens"))).alias("ter"),
    )
    return out.where("grain <> 'status' or status is not null")


def nested_totals(totals: DataFrame) -> DataFrame:
    """One row a variant: its totals, and by_status, a map from a status to its totals (four at most)."""
    fields = ("regions", *SUMS, "exact", "cer", "ter")
    by_status = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("grain") == "status", F.struct("status", F.struct(*fields))))))
    whole = [F.max(F.when(F.col("grain") == "all", F.col(c))).alias(c) for c in fields]
    return totals.where("grain <> 'by'").groupBy("variant").agg(*whole, by_status.alias("by_status"))


def crop_rows(totals: DataFrame, by: str, variants: list[str], counts: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """One row for each value of `by`: regions, <variant>_cer of each variant; with counts (by, and what `pages.page_counts`
    gives) these too; with events (by, accepted) the calls of the second pass and how many were taken."""
    cer = [F.max(F.when(F.col("variant") == v, F.col("cer"))).alias(f"{v}_cer") for v in variants]
    out = totals.where("grain = 'by'").groupBy(by).agg(F.max("regions").alias("regions"), *cer)
    if counts is not None:
        out = out.join(counts, by, "left")
    if events is not None:
        calls = events.groupBy(by).agg(F.count("*").alias("reask_calls"), F.count_if("accepted").alias("reask_accepted"))
        zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("reask_calls", "reask_accepted")}
        out = out.join(calls, by, "left").withColumns(zero)
    return out


def changed_regions(rows: DataFrame, before: str, after: str, *keep: str) -> DataFrame:
    """The regions of which two readings differ in their normal form: kept columns, gold, both readings, before_errors,
    after_errors and gain. Distances are taken of these regions alone."""
    names = ("gold", before, after)
    rows = rows.select(*keep, *[F.coalesce(c, F.lit("")).alias(c) for c in names])
    # Exploded, the normal forms are worked out once a row; the filter would repeat them as plain columns.
    forms = F.explode(F.array(F.struct(*[L.normalise(F.col(c)).alias(n) for n, c in zip("gba", names)])))
    differ = dealt(rows.where(F.col(before) != F.col(after))).select("*", forms.alias("__n")).where("__n.b <> __n.a")
    errors = {f"{n}_errors": L.edit_distance(F.col(f"__n.{n[0]}"), F.col("__n.g")).cast("long") for n in ("before", "after")}
    return differ.withColumns(errors).drop("__n").withColumn("gain", F.col("before_errors") - F.col("after_errors"))


def movement(changed: DataFrame) -> DataFrame:
    """(direction, regions, gain): how many changed regions improved, got worse or kept their number of errors."""
    direction = F.when(F.col("gain") > 0, "improved").when(F.col("gain") < 0, "worse").otherwise("same")
    return changed.groupBy(direction.alias("direction")).agg(F.count("*").alias("regions"), F.sum("gain").alias("gain"))


def write_report(path: str, rows: DataFrame, variants: dict[str, tuple[str, str | None]], by: str, counts: DataFrame | None = None, events: DataFrame | None = None) -> None:
    """The report as folders of JSON lines under `path`, written by the executors: `totals` (a row a variant, statuses nested),
    `crops` (a row for each value of `by`), `changed_<after>` (regions that each variant changed against the one before it, most
    gained first within a file) and, with events, `events`. Regions are scored once for totals and crops. Existing folders are
    replaced."""
    totals = checkpointed(variant_totals(by_variant(rows, variants, by), by))
    nested_totals(totals).coalesce(1).write.mode("overwrite").json(f"{path}/totals")
    crop_rows(totals, by, list(variants), counts, events).write.mode("overwrite").json(f"{path}/crops")
    names = list(variants)
    for before, after in zip(names, names[1:]):
        changed = changed_regions(rows, variants[before][0], variants[after][0], by)
        changed.sortWithinPartitions(F.col("gain").desc(), by).write.mode("overwrite").json(f"{path}/changed_{after}")
    if events is not None:
        events.write.mode("overwrite").json(f"{path}/events")


def manifest_crops(manifest: DataFrame) -> DataFrame:
    """Verified regions with text of the crops that have any: crop_id, region_idx, latex. manifest: id, regions[latex, verified]."""
    usable = lambda r: r["verified"] & (F.trim(F.coalesce(r["latex"], F.lit(""))) != "")
    crops = manifest.where(F.exists("regions", usable)).select(F.col("id").alias("crop_id"), F.posexplode("regions").alias("region_idx", "r"))
    return crops.where(usable(F.col("r"))).select("crop_id", "region_idx", "r.latex")
