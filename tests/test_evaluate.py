"""Variants of readings, what changed between them and the report, against plain Python on a few regions."""

import json
import random

from pyspark.sql import functions as F

from inkstone.functions import latex as L
from inkstone.operators import evaluate

SCHEMA = "crop_id string, region_idx int, gold string, raw string, verified string, status string, reasked string, status_after string"
VARIANTS = {"raw": ("raw", None), "verified": ("verified", "status"), "reask": ("reasked", "status_after")}
ROWS = [
    ("a", 0, "$x + 1$", "$x + l$", "$x + 1$", "green", "$x + 1$", "green"),
    ("a", 1, "$y = 23$", "$y = 2$", "$y = 2$", "yellow", "$y = 23$", "green"),
    ("a", 2, "abc", None, None, None, "", None),
    ("b", 0, "same", "same", "same", "green", "lame", "grey"),
    ("b", 0, "same", "same", "same", "green", "lame", "grey"),
    ("c", 0, "", "", "", "green", "", "green"),
]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def solid(text):
    return "".join((text or "").replace("$", "").split())


def want(rows, column):
    pairs = [(solid(r[column]), solid(r[2])) for r in rows]
    return len(pairs), sum(distance(p, g) for p, g in pairs), sum(len(g) for _, g in pairs), sum(p == g for p, g in pairs)


def test_variants_by_status_and_crop(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {(r.grain, r.variant, r.status, r.crop_id): (r.regions, r.char_errors, r.gold_chars, r.exact) for r in evaluate.variant_totals(evaluate.by_variant(df, VARIANTS, "crop_id"), "crop_id").collect()}
    expected = {}
    for name, at, state in (("raw", 3, None), ("verified", 4, 5), ("reask", 6, 7)):
        expected["all", name, None, None] = want(ROWS, at)
        for crop in "abc":
            expected["by", name, None, crop] = want([r for r in ROWS if r[0] == crop], at)
        if state:
            for s in {r[state] or "unmatched" for r in ROWS}:
                expected["status", name, s, None] = want([r for r in ROWS if (r[state] or "unmatched") == s], at)
    assert got == expected


def test_variants_are_scored_in_one_aggregation(spark):
    df = evaluate.variant_totals(evaluate.by_variant(spark.createDataFrame(ROWS, SCHEMA), VARIANTS, "crop_id"), "crop_id")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and plan.count("Join") == 0


def test_changed_regions_and_movement(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    changed = evaluate.changed_regions(df, "verified", "reasked", "crop_id", "region_idx")
    got = sorted((r.crop_id, r.region_idx, r.before_errors, r.after_errors, r.gain) for r in changed.collect())
    assert got == [("a", 1, 1, 0, 1), ("b", 0, 0, 1, -1), ("b", 0, 0, 1, -1)]  # repeated rows stay as many
    assert sorted(tuple(r) for r in evaluate.movement(changed).collect()) == [("improved", 1, 1), ("worse", 2, -2)]


def test_report_of_folders(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    counts = spark.createDataFrame([("a", 3, 2), ("b", 2, 2)], "crop_id string, lines long, green long")
    events = spark.createDataFrame([("a", "retranscribe", True), ("b", "en_vs_ln:x", False), ("b", "en_vs_ln:y", True)], "crop_id string, key string, accepted boolean")
    evaluate.write_report(str(tmp_path), df, VARIANTS, "crop_id", counts, events)

    def lines(name):
        return [json.loads(x) for f in sorted((tmp_path / name).glob("part-*")) for x in f.read_text().splitlines()]

    totals = {r["variant"]: r for r in lines("totals")}
    assert set(totals) == {"raw", "verified", "reask"} and totals["raw"]["by_status"] == {}
    assert {s: t["regions"] for s, t in totals["verified"]["by_status"].items()} == {"green": 4, "yellow": 1, "unmatched": 1}
    crops = {r["crop_id"]: r for r in lines("crops")}
    assert (crops["a"]["lines"], crops["a"]["reask_calls"], crops["b"]["reask_calls"], crops["b"]["reask_accepted"], crops["c"]["reask_calls"]) == (3, 1, 2, 1, 0)
    assert crops["b"]["verified_cer"] == 0 and crops["b"]["reask_cer"] == 0.25
    assert [(r["crop_id"], r["gain"]) for r in lines("changed_verified")] == [("a", 1)]
    assert len(lines("changed_reask")) == 3 and len(lines("events")) == 3


def test_nothing_to_score(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert evaluate.variant_totals(evaluate.by_variant(df, VARIANTS, "crop_id"), "crop_id").count() == 0
    assert evaluate.movement(evaluate.changed_regions(df, "raw", "verified", "crop_id")).count() == 0


def test_a_reading_of_several_variants_is_scored_once(spark, monkeypatch):
    df, plain, scored = spark.createDataFrame(ROWS, SCHEMA), evaluate.distances, []
    monkeypatch.setattr(evaluate, "distances", lambda rows: scored.append(rows.count()) or plain(rows))
    assert evaluate.by_variant(df, VARIANTS, "crop_id").count() == 3 * len(ROWS)
    assert scored == [sum(len({r[i] or "" for i in (3, 4, 6)}) for r in ROWS)] == [10]


def test_changed_regions_are_scored_in_their_row(spark):
    """No grouping brings a region's two readings together again, and its normal forms are worked out once."""
    plan = evaluate.changed_regions(spark.createDataFrame(ROWS, SCHEMA), "verified", "reasked", "crop_id", "region_idx")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("RepartitionByExpression") == 1 and plan.count("Figura geometrica") == 3


def test_a_common_line_is_dealt_over_tasks(spark):
    rows = spark.range(800).selectExpr("id as doc_id", "'same' as gold", "'lame' as pred", "map('k', id) as m")
    sizes = evaluate.distances(rows).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 200


def test_distance_in_bands_is_that_of_the_whole_table(monkeypatch):
    """Bands of every width, windows that move along both sequences, items instead of characters."""
    from inkstone.functions import distance as bits

    rng = random.Random(3)
    for band in (1, 2, 3, 8, 512):
        monkeypatch.setattr(bits, "BAND", band)
        for _ in range(300):
            a = rng.choices("abcd"[: rng.randint(1, 4)], k=rng.randint(0, 40))
            b = rng.choices("abcd", k=rng.randint(0, 50)) if rng.random() < 0.2 else [c for c in a if rng.random() > 0.1]
            for _ in range(rng.randint(0, 6)):
                b.insert(rng.randint(0, len(b)), rng.choice("abz"))
            assert bits.levenshtein("".join(a), "".join(b)) == bits.levenshtein(a, b) == distance(a, b)


def test_a_long_line_far_from_its_reading(spark):
    """24,000 characters, every fifth another."""
    gold = "".join(random.Random(5).choices("bcdfghijklmnopqrstuvwxyz", k=24000))
    df = spark.createDataFrame([("".join("¤" if i % 5 == 0 else c for i, c in enumerate(gold)), gold)], "pred string, gold string")
    r = evaluate.distances(df).first()
    assert (r.char_errors, r.token_errors, r.gold_chars, r.gold_tokens, r.exact) == (4800, 4800, 24000, 24000, False)


def test_commands_count_as_one_token(spark):
    rows = [(r"\frac{a}{b}", r"\frac{a}{c}"), (r"\frac{a}{b}", "frac{a}{b}"), ("x", r"\sin x"), (None, r"\sin x"), (r"\sin x", r"\sin x"), ("xy", "x z")]
    got = [(r.char_errors, r.token_errors, r.gold_chars, r.gold_tokens, r.exact) for r in evaluate.distances(spark.createDataFrame(rows, "pred string, gold string")).orderBy("gold", "pred").collect()]
    # Without its space \\sin x is one command.
    assert got == [(1, 1, 11, 7, False), (None, None, 5, 1, None), (0, 0, 5, 1, True), (4, 1, 5, 1, False), (1, 4, 10, 10, False), (1, 1, 2, 2, False)]


def test_the_short_way_to_a_normal_form(spark):
    """A command that sets only space makes every text go the long way, and changes nothing."""
    rng = random.Random(8)
    parts = ["a", "A", "b", " ", "$", "\n", "\u00a0", "\u2003", "≥", "²", "ℝ", "→", "=", ")", "(", "=>", "<=>", "^", "_", "{", "}", '"', "'", "„", "”", "“", ",,", "|", "é", "𝒳"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(2000)] + ["„ A ”", '"$A$"', ",,A' '", "x ≥ 2", "( = )", "a  b\t$c$"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    bad = df.where(L.normalise(F.col("t")) != L.normalise(F.concat("t", F.lit(r"\;")))).collect()
    assert not bad
