"""Operators 11, 12 and 13: brute force, held-out accuracy, pairs of terms and defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from inkstone.llm import centroids, queries, source_audit, toxicity
from tests.conftest import DATA

# ------------------------------------------------------------------- divergence of sources

DOCS = "doc_id long, text string, lang string, source string, idx string, term string, vector string, rank string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, la, s, "x", "t", "v", "r") for i, t, la, s in rows], DOCS)


def plain_audit(rows, least=3, top=200):
    low = str.maketrans(source_audit.CAPITALS, source_audit.SMALL)
    found = defaultdict(Counter)
    seen = defaultdict(Counter)
    groups = defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        found[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]

        def share(counter):
            size = sum(counter[t] for t in kept)
            return {t: 1 + 10**9 * (counter[t] + 1) // (size + len(kept)) for t in kept}

        every = share(sum((found[lang, s] for s in sources), Counter()))
        p = {s: share(found[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - every[t]) ** 2 // every[t]) for t in kept if found[lang, s][t] and p[s][t] > every[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, r + 1) for r, (item, value) in enumerate(items[:most])]
    return sorted(out)


def audit_rows(spark, rows, **more):
    return sorted(tuple(r) for r in source_audit.audit(documents(spark, rows), **more).collect())


def test_audit_against_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    words = ["Éa", "éa", "ab", "AB", "aB", "x1y", "ß", "日本", "zz", "qq", "foo-bar", "the"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", None])) for i in range(60)]
    rows += [(None, None, "en", "only nulls"), (1, "", "en", "empty"), (2, "solo solo", "xx", "one"), (3, "...", "yy", "a"), (4, "rare", "yy", "b"), (5, "the " * 30000, "en", "a"), (5, "the " * 30000, "en", "a")]
    want = plain_audit(rows)
    assert audit_rows(spark, rows) == want
    assert audit_rows(spark, rows, top=3) == [r for r in want if r[2] == "pair" or r[5] <= 3]
    assert {(r[0], r[4]) for r in want if r[0] == "yy"} == {("yy", 0)} and not [r for r in want if r[0] == "xx"]
    monkeypatch.setattr(source_audit, "BROADCAST_GROUPS", 1)  # the way beyond broadcasts
    assert audit_rows(spark, rows) == want


def test_sources_whose_shares_round_to_those_of_none(spark, monkeypatch):
    """A source may have a term and yet the share of one that lacks it."""
    rows = [(i, text, "en", s) for i, (text, s) in enumerate([("a b " * 300, "x"), ("a b b", "y"), ("a c", "z"), ("c a", "z"), ("c", "y")])]
    monkeypatch.setattr(source_audit, "share", lambda count, total: (count + 1) * 7 % 3 + 1 + total * 0)
    got = {(r[1], r[3]): r[4] for r in audit_rows(spark, rows) if r[2] == "pair"}
    n = {"x": (300, 0), "y": (1, 1), "z": (2, 2)}  # of a and c; b has two documents only
    f = lambda c: (c + 1) * 7 % 3 + 1
    assert got == {(s, t): sum((f(a) - f(b)) ** 2 // f(b) for a, b in zip(n[s], n[t])) for s in n for t in n if s != t}


def test_audit_of_nothing(spark):
    assert audit_rows(spark, []) == []
    assert audit_rows(spark, [(1, None, None, None)]) == []
    assert audit_rows(spark, [(1, None, None, None), (2, "a", None, "s")]) == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]


def test_shares_are_exact_for_large_counts(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    cases = [(rng.randrange(total), total) for total in (1, 2, 7, 10**9, 10**12, 9 * 10**15 // 1000) for _ in range(20)]
    df = spark.createDataFrame(cases, "c long, t long").select("c", "t", source_audit.share(F.col("c"), F.col("t")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.c + 1) // r.t for r in df.collect())


# ------------------------------------------------------------------- toxicity

LABELS = "doc_id long, quality int, toxic int"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "p", 1) for i, t in rows], "doc_id long, text string, lang string, y string, places string, held_out int")


def test_pairs_of_terms_decide(spark):
    """A document is toxic if it names a group and has an insult; either alone says nothing."""
    rng = random.Random(12)
    filler = [f"word{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(2400):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = rng.choices(filler, k=8) + ["blockhead"] * insult + ["martians"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(insult and group)))
    scored = {r.doc_id: r for r in toxicity.score(texts(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    held = [(scored[i].score, y) for i, _, y in labels if scored[i].held_out]
    assert len(held) > 500 and np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.98


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = queries.op12_toxicity(spark, f"{DATA}/sf0.1").join(labels, "doc_id").collect()
    assert toxicity.score(docs.limit(0), labels).columns == ["doc_id", "held_out", "score", "predicted"]
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    pos, neg = (np.array([r.score for r in held if r.toxic == y]) for y in (1, 0))
    assert (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean() > 0.95
    assert (pos >= 0.7).mean() > 0.8 and (neg >= 0.7).mean() < 0.01


def test_toxicity_defined_cases(spark):
    labels = [(i, 1, i % 2) for i in range(60)]
    rows = [(i, "awful word" if i % 2 else "kind word") for i in range(60)] + [(100, None), (100, None), (None, ""), (101, "awful " * 200_000), (3, "awful word")]
    got = toxicity.score(texts(spark, rows), spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1)], LABELS)).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.score, r.held_out, r.predicted))
    assert by[100] == {(next(iter(by[100]))[0], zlib.crc32(b"100") % 3 == 1, 0)} and next(iter(by[None]))[:2] == (next(iter(by[100]))[0], False)
    assert next(iter(by[101]))[2] == 1 and len(by[3]) == 1
    docs = texts(spark, rows)
    assert {r.score for r in toxicity.score(docs, spark.createDataFrame([], LABELS)).collect()} == {0.5}
    assert {round(r.score, 4) for r in toxicity.score(docs, spark.createDataFrame([(i, 1, 0) for i in range(9)], LABELS)).collect()} == {0.0}
    assert toxicity.score(texts(spark, []), spark.createDataFrame(labels, LABELS)).collect() == []


def test_margins_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    m = toxicity.Machine(np.arange(9), rng.normal(size=9), rng.normal(size=(9, 4)), 0.3)
    rows = [np.array([], np.int64), np.array([4]), np.array([0, 3, 8]), np.arange(9)]
    want = [m.start + sum(m.weight[i] for i in r) + sum(m.factors[i] @ m.factors[j] for n, i in enumerate(r) for j in r[n + 1 :]) for r in rows]
    assert np.allclose(m.margins(rows), want)


# ------------------------------------------------------------------- centroid clustering

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, v string, total string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", "v", "t") for i, v in rows], VECTORS)


def plain_clusters(rows, width, k, rounds, scale):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(float(np.float32(x)) * scale) for x in v]))
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in seeds]
    away = lambda v: [sum((x - y) ** 2 for x, y in zip(v, m)) for m in c]
    for _ in range(rounds):
        near = [min(range(len(c)), key=lambda n, d=away(v): (d[n], n)) for _, v in kept]
        for n in range(len(c)):
            own = [v for (_, v), m in zip(kept, near) if m == n]
            if own:
                c[n] = [sum(col) // len(own) for col in zip(*own)]
    rows = [(i, *min((d, n) for n, d in enumerate(away(v)))) for i, v in kept]
    inertia = Counter()
    for _, d, n in rows:
        inertia[n] += d
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, d, n in rows), key=str)


def clusters(spark, rows, **more):
    return sorted((tuple(r) for r in centroids.cluster(vectors(spark, rows), **more).collect()), key=str)


def test_clusters_against_brute_force(spark):
    rng = random.Random(13)
    blob = lambda n: [rng.gauss(n % 5, 0.02) for _ in range(6)]
    rows = [(i, blob(i)) for i in range(400)] + [(i % 7, blob(1)) for i in range(20)] + [(900 + i, [1.0] * 6) for i in range(120)] + [(None, blob(2)), (None, blob(3))]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [float("nan")] * 6), (2004, [float("inf")] + [0.0] * 5), (2005, [None] + [0.0] * 5), (5, rows[5][1]), (5, rows[5][1])]
    for rows_of_tree in (16_384, 50):
        assert clusters(spark, rows, width=6, k=4, rounds=5, tree_rows=rows_of_tree) == plain_clusters(rows, 6, 4, 5, 1024)


def test_ties_go_to_the_smaller_centroid(spark):
    grid = [(i, [float(x), float(y)]) for i, (x, y) in enumerate((x, y) for x in range(-6, 7) for y in range(-6, 7))]
    for rounds in (0, 1, 4):
        assert clusters(spark, grid * 3, width=2, k=5, rounds=rounds, scale=1) == plain_clusters(grid * 3, 2, 5, rounds, 1)


def test_few_or_no_vectors(spark):
    assert clusters(spark, []) == [] and clusters(spark, [(1, None)]) == []
    two = [(1, [0.5] * 64), (2, [-0.5] * 64)]
    assert clusters(spark, two) == plain_clusters(two, 64, 8, 10, 1024)
    assert clusters(spark, [(None, [0.5] * 64)]) == [(None, None, None, None, None, None)]


def test_whole_balls_are_taken_and_right():
    rng = np.random.default_rng(1)
    c = rng.integers(-4000, 4000, (6, 8))
    x = np.concatenate([m + rng.integers(-300, 300, (500, 8)) for m in c])
    tree, order = centroids.Tree.of(x)
    back = centroids.Tree.unpack(tree.pack(), 8)
    nearest, balls = back.assign(c)
    assert (tree.vectors == x[order]).all() and (nearest < 0).mean() > 0.9
    for n, nodes in balls:
        for node in nodes:
            part = slice(back.low[node], back.high[node])
            assert (nearest[part] == -1).all() and (back.total[node] == back.vectors[part].sum(0)).all()
            nearest[part] = n
    assert (nearest == centroids.distances(back.vectors, c).argmin(1)).all()


def test_distances_are_exact_beyond_doubles():
    big = np.array([[centroids.LARGEST - 1] * 64, [1 - centroids.LARGEST] * 64])
    assert centroids.distances(big, big)[0, 1] == 64 * (2 * (centroids.LARGEST - 1)) ** 2
