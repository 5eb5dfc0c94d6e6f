"""Operators 1, 2 and 7 against brute force, on planted repeats and on the odd cases."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkstone.llm import simhash
from inkstone.llm.substring_dedup import dedup_words
from inkstone.llm.suffix_dedup import Suffixes, dedup_bytes
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits string, row string, anchors int"


def planted(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(400)]
    passages = [" ".join(rng.choices(vocabulary, k=n)) for n in (12, 13, 14, 30, 80)]
    rows = []
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            words.insert(rng.randint(0, len(words)), rng.choice(passages))
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(200, None), (201, ""), (202, "  \n "), (203, rows[5][1]), (5, rows[5][1]), (204, "la " * 3000), (205, "la " * 2500 + "end"), (206, passages[4] + " " + "ü" * 200), (None, passages[4]), (None, passages[3]), (207, " ".join(rng.choices(vocabulary, k=30_000)) + " " + passages[3]), (208, "wide blank kept " * 20)]
    rng.shuffle(rows)
    return [(*r, "en", "s", 0, "x", "y", 7) for r in rows]


def brute(rows: list[tuple], tokens, width: int) -> list[tuple]:
    """Per row the mask of removed tokens."""
    first: dict = {}
    key = lambda i: float("inf") if i is None else i
    for doc, text, *_ in rows:
        t = tokens(text)
        for p in range(len(t) - width + 1):
            w = tuple(t[p : p + width])
            first[w] = min(first.get(w, float("inf")), key(doc))
    out = []
    for doc, text, *_ in rows:
        t = tokens(text)
        gone = [False] * len(t)
        for p in range(len(t) - width + 1):
            if first[tuple(t[p : p + width])] < key(doc):
                gone[p : p + width] = [True] * width
        out.append((doc, t, gone))
    return out


def expect_words(rows):
    for doc, t, gone in brute(rows, lambda x: (x or "").encode().split(), 13):
        kept = b" ".join(w for w, g in zip(t, gone, strict=True) if not g)
        yield doc, len(t), sum(gone), hashlib.sha256(kept).hexdigest()


def expect_bytes(rows):
    for doc, t, gone in brute(rows, lambda x: (x or "").encode(), 50):
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k, _ in itertools.groupby(gone) if k)
        yield doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


def test_words_against_brute_force(spark):
    rows = planted()
    got = dedup_words(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    want = list(expect_words(rows))
    assert order(r[:4] for r in got) == order(want)
    assert sum(r[2] for r in want) > 1000
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_bytes_against_brute_force(spark):
    rows = planted(4)
    got = dedup_bytes(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert order(r[:5] for r in got) == order(expect_bytes(rows))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize(("operator", "expect", "n"), [(dedup_words, expect_words, 4), (dedup_bytes, expect_bytes, 5)])
def test_hot_anchors_are_dealt_by_window(spark, monkeypatch, operator, expect, n):
    from inkstone.llm import windows

    monkeypatch.setattr(windows, "LEAST_HOT", 2)
    rows = planted(6)
    got = operator(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert order(r[:n] for r in got) == order(expect(rows))


def test_small_pieces(spark, monkeypatch):
    from inkstone.llm import windows

    rows = planted(7)[:60]
    data = "\n".join(r[1] or "" for r in rows).encode()
    buffer, offsets = np.frombuffer(data, np.uint8), np.array([0, len(data)])
    monkeypatch.setattr(windows, "PIECE", 64)
    small = [np.concatenate(x) for x in zip(*windows.batch_anchors(*windows.word_tokens(buffer, offsets), 13, 6), strict=True)]
    monkeypatch.setattr(windows, "PIECE", 1 << 20)
    large = [np.concatenate(x) for x in zip(*windows.batch_anchors(*windows.word_tokens(buffer, offsets), 13, 6), strict=True)]
    assert all(np.array_equal(a, b) for a, b in zip(small, large, strict=True))


@pytest.mark.parametrize("operator", [dedup_words, dedup_bytes, simhash.simhash_groups])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []


def test_real_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert order(r[:4] for r in dedup_words(docs).collect()) == order(expect_words(rows))
    assert order(r[:5] for r in dedup_bytes(docs).collect()) == order(expect_bytes(rows))


def test_suffix_sort_orders_like_python():
    rng = random.Random(1)
    data = bytes(rng.choices(b"ab", k=3000))
    suffixes = Suffixes(np.frombuffer(data, np.uint8))
    at, length = np.array([rng.randrange(2900) for _ in range(500)]), np.array([rng.randint(1, 90) for _ in range(500)])
    group = np.sort(np.array([rng.randrange(7) for _ in range(500)]))
    key = [(int(g), data[a : a + n]) for g, a, n in zip(group, at, length, strict=True)]
    parent = np.arange(500)
    left, deal = suffixes.merge(np.arange(500), group, at, length, parent)
    assert [key[i] for i in left] == sorted(set(key)) and deal.tolist() == group[left].tolist()
    for most in (1 << 19, 64):  # whole, and a piece at a time
        number = suffixes.classes(group, at, length, most)
        same = {}
        for i in range(500):
            same.setdefault(key[i], set()).add(int(number[i]))
        assert all(len(x) == 1 for x in same.values()) and len(same) == len(set(number.tolist()))


@pytest.mark.parametrize(("operator", "expect", "n"), [(dedup_words, expect_words, 4), (dedup_bytes, expect_bytes, 5)])
def test_many_rows_without_id_and_periodic_texts(spark, operator, expect, n):
    rng = random.Random(8)
    passage = " ".join("".join(rng.choices("abc", k=4)) for _ in range(40))
    rows = [(None, f"x{i} {passage} y{i}") for i in range(60)] + [(None, "same text " * 9)] * 40 + [(7, passage), (3, "ab " * 5000), (4, "b ab " + "ab " * 4000), (5, "same text " * 5), (6, "abcdefg " * 900), (9, "efg abcdefg " + "abcdefg " * 700)]
    got = operator(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert order(r[:n] for r in got) == order(expect(rows))


def test_colliding_hashes_do_not_join_texts():
    suffixes = Suffixes(np.frombuffer(b"abcd" * 10 + b"abce" * 10, np.uint8))
    suffixes.prefix = np.zeros_like(suffixes.prefix)  # every hash collides
    for size in (8, 3, 15):
        a, n = np.array([0]), np.array([size])
        assert suffixes.order(a, n, np.array([40]), n)[0] == (-1 if size > 3 else 0)
        assert suffixes.order(a, n, np.array([4]), n)[0] == 0


def brute_fingerprint(text) -> int:
    t = (text or "").encode().lower().split()
    shingles = [b" ".join(t[i : i + 4]) for i in range(max(1, len(t) - 3))] if t else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows) -> list[tuple]:
    prints = [brute_fingerprint(r[1]) for r in rows]
    distinct = sorted(set(prints))
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    low: dict = {}
    for r, x in zip(rows, prints, strict=True):
        if r[0] is not None:
            low[find(x)] = min(low.get(find(x), r[0]), r[0])
    return [(r[0], f"{x:016x}", low.get(find(x))) for r, x in zip(rows, prints, strict=True)]


def near_rows() -> list[tuple]:
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, number = [], 0
    for _ in range(25):
        words = rng.choices(vocabulary, k=rng.randint(60, 200))
        for _ in range(rng.randint(1, 9)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((number, " ".join(copy)))
            number += 1
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE Two"), (905, "É one"), (None, rows[0][1]), (3, rows[3][1]), (906, "w1 " * 70_000)]
    rng.shuffle(rows)
    return [(*r, "en", "s", 0, "x", "y", 7) for r in rows]


def test_simhash_against_brute_force(spark):
    rows = near_rows()
    assert order(simhash.simhash_groups(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()) == order(brute_groups(rows))


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(2)
    for bits in itertools.chain(itertools.combinations(range(0, 64, 5), 4), (rng.sample(range(64), 4) for _ in range(3000))):
        flip = sum(1 << b for b in bits)
        assert any(not m & flip for m in simhash.MASKS)
    for table, mask in enumerate(simhash.MASKS):
        free = [b for b in range(64) if not mask >> b & 1]
        for _ in range(50):
            flip = sum(1 << b for b in rng.sample(free, 4))
            assert any(not m & flip for m in simhash.INNER[table])


def test_large_buckets_are_dealt_again(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(signed(x),) for x in fps], "fp long").repartition(4)
    got = {(r.src, r.dst) for r in simhash.links(rows, limit=4).collect()}
    root = {signed(x): signed(x) for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
        root[find(a)] = find(b)
    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            assert find(signed(a)) == find(signed(b))


def test_keep_one_keeps_the_smallest(spark):
    rows = near_rows()
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {c for _, _, c in brute_groups(rows)}
    assert {r.doc_id for r in kept if r.doc_id is not None} == {x for x in want if x is not None}
    assert kept[0].__fields__ == [x.split()[0] for x in SCHEMA.split(", ")]


def test_keep_one_with_repeated_and_null_ids(spark):
    texts = [" ".join(f"{x}{i}" for i in range(80)) for x in ("alpha", "beta", "gamma")]
    rows = [(5, texts[0]), (5, texts[0]), (None, texts[0]), (9, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (4, texts[2]), (4, texts[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit("x"))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, texts[0]), (None, texts[1]), (4, texts[2])], key=str)
