"""Operators 3, 4, 6 and 8: brute force, held-out accuracy, planted pages and round trips."""

import random
import struct

import numpy as np
import pytest

from inkstone.llm import html_text, quality_model, sentencepiece_codec, sharding
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, lang string, source string, x string, ids string, prefix string, bits string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", "x", "i", "p", "b") for r in rows], SCHEMA)


# ------------------------------------------------------------------- sharding


def test_shards_against_brute_force(spark):
    import hashlib

    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(700)] + [(9000, "y" * 900), (9001, None), (None, "né"), (3, "again")]
    limit = 2000
    bits = lambda i: f"{int(hashlib.md5(('' if i is None else str(i)).encode()).hexdigest()[:15], 16):060b}"
    size = lambda t: len((t or "").encode())
    want = []
    for i, t in rows:
        for depth in range(61):
            inside = [size(x) for j, x in rows if bits(j)[:depth] == bits(i)[:depth]]
            if sum(inside) <= limit:
                break
        want.append((i, size(t), bits(i)[:depth], depth, sum(inside), len(inside), True))
    got = [tuple(r) for r in sharding.shard(table(spark, rows), limit=limit).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_one_id_cannot_be_parted(spark):
    rows = [(7, "z" * 60)] * 4 + [(8, "a")]
    got = {r.doc_id: r for r in sharding.shard(table(spark, rows), limit=100).collect()}
    assert got[8].fits and not got[7].fits and got[7].depth == 60 and got[7].shard_docs == 4
    assert sharding.shard(table(spark, []), limit=100).collect() == []


def test_write_shards(spark, tmp_path):
    rows = [(i, "x" * 50) for i in range(64)]
    sharding.write_shards(table(spark, rows), str(tmp_path / "out"), limit=500)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 64 and back.groupBy("shard").count().agg({"count": "max"}).first()[0] <= 10


def test_write_shards_with_clashing_columns(spark, tmp_path):
    rows = table(spark, [(1, "a" * 90), (2, "b" * 90), (None, None)]).withColumnRenamed("x", "shard").withColumnRenamed("prefix", "KEY")
    sharding.write_shards(rows, str(tmp_path / "out"), limit=100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == [*rows.columns, "shard_"] and back.count() == 3
    assert {r.shard for r in back.collect()} == {"x"} and {r.KEY for r in back.collect()} == {"p"}


def test_a_very_long_text_fills_a_shard_of_its_own(spark):
    got = {r.doc_id: r for r in sharding.shard(table(spark, [(1, "long " * 400_000), (2, "a"), (3, "b")]), limit=1000).collect()}
    assert got[1].n_bytes == 2_000_000 and not got[1].fits and got[1].shard_docs == 1 and got[2].fits and got[3].fits


# ------------------------------------------------------------------ classifier


def test_held_out_accuracy(spark):
    sf = f"{DATA}/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality_model.score(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    pairs = [(r.score, r.quality) for r in rows]
    good, bad = [s for s, q in pairs if q == 1], [s for s, q in pairs if q == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.93, auc
    assert np.mean([(s >= 0.3) == q for s, q in pairs]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_flat_trees_agree_with_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < 0)).astype(float)
    trees = quality_model.grow(x, y, trees=20, depth=3)

    def walk(row, node):
        while trees.feature[node] >= 0:
            node = trees.left[node] + (row[trees.feature[node]] > trees.threshold[node])
        return trees.value[node]

    assert np.allclose(trees.margins(x[:50]), [trees.start + sum(walk(r, n) for n in trees.root) for r in x[:50]])
    assert ((trees.scores(x) > 0.5) == y).mean() > 0.95


def test_classifier_odd_cases(spark):
    rows = [(i, "the words of this text are fine and many " * 3) for i in range(60)] + [(100 + i, "### $$$ ") for i in range(60)] + [(500, None), (501, ""), (None, "x"), (1, "again")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)] + [(7, None, 0), (100, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.score(table(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(r.score is not None for r in got)
    first = {r.doc_id: r.score for r in got}
    assert first[2] > 0.9 and first[102] < 0.1
    none = quality_model.score(table(spark, rows[:3]), labels.where("false")).collect()
    assert [r.score for r in none] == [0.5] * 3
    assert quality_model.score(table(spark, []), labels).collect() == []


def test_repeated_rows_of_a_labelled_id_and_very_long_texts(spark):
    rows = [(i % 40, "the words of this text are fine and many " * 3) for i in range(400)] + [(100 + i, "### $$$ ") for i in range(40)] + [(3, "other"), (9, "fine words " * 100_000)]
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)], "doc_id long, quality int")
    got = quality_model.score(table(spark, rows), labels).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 2}) == 1
    assert all(0 <= r.score <= 1 for r in got)


# ------------------------------------------------------------------------ html


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; bare", "plain & bare"),
        ("<body><nav>menu</nav><div class='ad'>buy</div><article><h1>T &amp U</h1><p>One  two\n three<p><b>Bold<br>more<p>s</article><footer>f</footer>", "T & U\nOne two three\nBold more\ns"),
        ("<main><header><h1>Head</h1></header><p>Body text</p><section class='comments'><p>first!</p></section><aside>x</aside><form>mail <input></form></main>", "Head\nBody text"),
        ("<article><p>a<script>var t='</p>';</script>b</p><!-- no --><style>p{}</style><ul><li>x<li>y</ul></article>", "ab\nx\ny"),
        ("<div id=cookie-notice>We use cookies</div><div><p>" + "Long words of the content here. " * 8 + "</p><p>short</p></div><div><a>l1</a><a>l2</a><a>l3</a></div>", "Long words of the content here. " * 7 + "Long words of the content here.\nshort"),
        ("<article><p>&lt;tag&gt; &#233;&#x4e2d; &nbsp;x</p></article>", "<tag> é中 x"),
        ("<article><p>one</p><div class='comment'><p>no</p></div><div hidden>no</div><p>two</article>", "one\ntwo"),
    ],
)
def test_main_text(html, text):
    assert (html_text.main_text(html) if html else "") == text


def test_pages(spark):
    pages = spark.read.parquet(f"{DATA}/sf0.001/pages.parquet")
    got = html_text.extract(pages.withColumnRenamed("page_id", "id").withColumn("text", pages.url), id_col="id").collect()
    assert len(got) == pages.count()
    for r in got:
        assert r.n_chars == len(r.text) and "track(" not in r.text and "©" not in r.text and r.text
        assert all(line == " ".join(line.split()) and line for line in r.text.split("\n"))
    assert html_text.extract(pages.where("false")).collect() == []


def test_very_long_page():
    html = "<article>" + "<p>" + "word " * 20 + "</p>" * 1 + "<p>x</p>" * 20_000 + "</article>"
    assert html_text.main_text(html).count("\n") == 20_000


def plain_select(lines, sigma=1.0, share=0.5):
    import math

    named = [x[3] >= 2 for x in lines]
    ratio = [math.log(max(1.0, len(x[0]) / (1 + x[1]))) for x in lines]
    reach = int(3 * sigma)
    weight = {d: math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)}
    smooth = []
    for i in range(len(lines)):
        low = high = i  # the stretch in or outside an article around the line
        while low and named[low - 1] == named[i]:
            low -= 1
        while high + 1 < len(lines) and named[high + 1] == named[i]:
            high += 1
        smooth.append(sum(w * ratio[min(max(i + d, low), high)] for d, w in weight.items()) / sum(weight.values()))
    centres = [min(smooth), max(smooth)]
    for _ in range(50):
        groups = [[x for x in smooth if (x >= sum(centres) / 2) == upper] for upper in (False, True)]
        if not groups[0]:
            break
        centres = [sum(g) / len(g) for g in groups]
    limit = sum(centres) / 2 if centres[1] - centres[0] >= math.log(4) else min(smooth)
    content = [x >= min(limit, math.log(15)) for x in smooth]
    chars = lambda keep: sum(len(x[0]) for i, x in enumerate(lines) if keep(i, x))
    mass = lambda s: chars(lambda i, x: x[2] == s and content[i])
    whole = lambda s: chars(lambda i, x: x[2] == s)
    alone = any(named) and chars(lambda i, x: named[i] and content[i]) >= chars(lambda i, x: not named[i] and content[i])
    region = [n or not alone for n in named]
    good = {x[2] for i, x in enumerate(lines) if region[i] and mass(x[2]) >= share * whole(x[2])}
    if not good:
        good = {max(sorted({x[2] for i, x in enumerate(lines) if region[i]}), key=lambda s: (mass(s), whole(s)))}
    return [r and x[2] in good for r, x in zip(region, lines, strict=True)]


def test_selection_against_brute_force():
    rng = random.Random(6)
    for _ in range(400):
        kinds = {s: rng.choice([1, 1, 2, 3]) for s in range(5)}
        lines = [("x" * rng.choice([1, 3, 9, 40, 200]), rng.choice([0, 1, 2, 6]), s, kinds[s]) for s in (rng.randrange(5) for _ in range(rng.randint(1, 25)))]
        assert html_text.select(lines) == plain_select(lines)


LINKS = "<ul>" + "".join(f"<li><a href='/{i}'>Another story {i}</a></li>" for i in range(7)) + "</ul>"
TEASERS = "".join(f"<div><a href='/{i}'><img src=x></a><a href='/{i}'>Ten things {i}</a> <a href='/c'>News</a></div>" for i in range(4))
PROSE = "".join(f"<p>Paragraph {i} says a good deal about the matter at hand, and then some more of it.</p><p>Short.</p>" for i in range(6))
TEXT = "\n".join(f"Paragraph {i} says a good deal about the matter at hand, and then some more of it.\nShort." for i in range(6))


@pytest.mark.parametrize(
    "html",
    [
        f"<body><div>{LINKS}</div><article>{PROSE}</article><div>{LINKS}</div></body>",
        f"<body><article>{PROSE}<div>{LINKS}</div></article></body>",
        f"<body><article><div>{LINKS}</div>{PROSE}<section>{TEASERS}</section></article></body>",
        f"<body><div class=x1>{LINKS}</div><div class=x2>{PROSE}</div><div class=x3>{TEASERS}</div><div class=x4>{LINKS}</div></body>",
        f"<body><main><div>{PROSE}</div><div>{LINKS}{TEASERS}</div></main></body>",
    ],
)
def test_the_ratio_decides_where_no_name_does(html, monkeypatch):
    """Lists of links and teasers without a telling name go by their ratio; with the ratio switched off they stay."""
    assert html_text.main_text(html) == TEXT
    monkeypatch.setattr(html_text, "content_lines", lambda lines, sigma=1.0: np.ones(len(lines), bool))
    assert html.startswith("<body><div>") or html_text.main_text(html) != TEXT


def test_lists_and_short_lines_of_an_article_stay():
    html = f"<article><h1>Title</h1>{PROSE}<div><ul><li>first point</li><li>second point of a list</li><li>see <a href=x>the note on it</a> for more of this</li></ul></div><div><p>A note.</p></div></article>"
    assert html_text.main_text(html) == f"Title\n{TEXT}\nfirst point\nsecond point of a list\nsee the note on it for more of this\nA note."


LONG = "Long words of the content here, a good many of them. " * 6


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<![ if !IE ]><p>a</p><![endif]><![name[<p>b</p><!><!x><!DOCTYPE html><p>c</p>", "a\nb\nc"),
        ("<article><p>teaser</p></article><div><p>" + LONG + "</p><p>" + LONG + "</p></div>", LONG.strip() + "\n" + LONG.strip()),
        ("<div class='content side-by-side'><p>" + LONG + "</p></div><div class=sidebar><p>" + LONG + "</p></div>", LONG.strip()),
        ("<article class='post comments-open'><p>" + LONG + "</p><div class='reader-comments'>no</div></article>", LONG.strip()),
        ("<html><head><title>t</title><meta name=a><p>first</p>", "first"),
        ("<html><head><title>t</title><body><div>first</div>", "first"),
    ],
)
def test_pages_of_the_wild(html, text):
    assert html_text.main_text(html) == text


def test_no_markup_crashes():
    rng = random.Random(9)
    bits = ["<", ">", "!", "[", "]", "--", "<![", "<!", "<?", "</", "p", "div", " class='ad'", "=", '"', "&", "#x", ";", "text ", "<p>", "</div>", "<article>", "<script>", "<td>", "\n", "é"]
    for _ in range(3000):
        assert isinstance(html_text.main_text("".join(rng.choices(bits, k=rng.randint(1, 30)))), str)


def test_deep_pages_take_linear_time():
    import time

    begun = time.monotonic()
    assert html_text.main_text("<div>" * 100_000 + "deep") == "deep" and html_text.main_text("<b>" * 100_000 + "x" + "</i>" * 100_000) == "x"
    assert time.monotonic() - begun < 30


def test_repeated_and_null_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "t"), (1, "u", "<p>a</p>", "t"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted(map(str, html_text.extract(pages).collect())) == sorted(["Row(page_id=1, url='u', text='a', n_chars=1)"] * 2 + ["Row(page_id=None, url=None, text='', n_chars=0)"])


# --------------------------------------------------------------- sentencepiece

TEXTS = [None, "", " ", "  hello  world \n x\ty", "Is and retitioning ouen the of, nterti", "é▁中文 日本 ✓   \x00", "▁", "▁▁ ▁", "日本語" * 400, "a" * 3000, "word " * 30_000, "\n\n \n", "ünïcödé 🎉🎉 ok", "tail "]


def test_round_trip(spark):
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (4, TEXTS[4])]
    encoded = sentencepiece_codec.encode(table(spark, rows))
    assert encoded.columns.count("ids") == 1 and dict(encoded.dtypes)["ids"] == "array<int>"
    kept = sentencepiece_codec.encode(table(spark, rows), name="pieces")
    assert {r.ids for r in kept.collect()} == {"i"} and "pieces" in kept.columns
    back = sentencepiece_codec.decode(encoded.withColumn("decoded", encoded.text)).collect()
    assert len(back) == len(rows) and all(r.decoded == (r.text or "") for r in back)
    digest = sentencepiece_codec.codec_digest(table(spark, rows)).collect()
    assert all(r.round_trip for r in digest)
    assert {r.doc_id: r.n_pieces for r in digest if r.doc_id in (0, 1)} == {0: 0, 1: 0}
    assert sentencepiece_codec.codec_digest(table(spark, [])).collect() == []


def test_units_of_one_hash_are_told_apart():
    data = np.frombuffer(b"abcabdabc", np.uint8)
    start, stop = np.array([0, 3, 6, 6]), np.array([3, 6, 9, 8])
    assert sentencepiece_codec._unlike(data, start, stop, np.array([0, 0, 0, 0])).tolist() == [False, True, False, True]


def _fields(data: bytes):
    """(number, wire type, value) of a protocol buffer's fields."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, 0, varint()
        else:
            n = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, key & 7, data[at : at + n]
            at += n


def _put(number: int, kind: int, value) -> bytes:
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    return varint(number << 3 | kind) + (varint(value) if kind == 0 else varint(len(value)) + value if kind == 2 else value)


def test_against_the_library_on_a_unigram_model():
    """The same pieces as a unigram model of the library: no segmentation of ours scores lower than its."""
    import sentencepiece

    with open(sentencepiece_codec.MODEL, "rb") as f:
        model = f.read()
    plain = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    vocabulary = sentencepiece_codec.Vocabulary.load()
    out, number = b"", 0
    for field, kind, value in _fields(model):
        if field == 1:
            parts = list(_fields(value))
            score = vocabulary.score[number]
            if np.isfinite(score):
                parts = [(n, k, struct.pack("<f", score) if n == 2 else v) for n, k, v in parts]
            value, number = b"".join(_put(*p) for p in parts), number + 1
        elif field == 2:
            value = b"".join(_put(*p) for p in _fields(value) if p[0] != 3) + _put(3, 0, 1)
        out += _put(field, kind, value)
    library = sentencepiece.SentencePieceProcessor(model_proto=out)
    rng = random.Random(6)
    letters = ["the", "ing", " ", "é", "tion", "x", "\n", "中", "Q", "  "]
    texts = [t for t in TEXTS if t and "▁" not in t and len(t) < 5000 and "\x00" not in t] + ["".join(rng.choices(letters, k=60)) for _ in range(60)]
    raw = [t.encode() for t in texts]
    ids, at = vocabulary.encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    score = lambda x: sum(vocabulary.score[i] for i in x if np.isfinite(vocabulary.score[i]))
    equal = 0
    for i, t in enumerate(texts):
        ours, theirs = ids[at[i] : at[i + 1]].tolist(), library.encode(t)
        assert sum(plain.is_byte(x) for x in ours) == sum(plain.is_byte(x) for x in theirs)
        assert abs(score(ours) - score(theirs)) < 1e-3 * (1 + abs(score(theirs))), t
        equal += ours == theirs
    assert equal >= 0.9 * len(texts)


def test_refuses_a_vocabulary_that_crosses_units():
    pieces = [f"<0x{b:02X}>" for b in range(256)] + ["a▁b"]
    with pytest.raises(ValueError):
        sentencepiece_codec.Vocabulary.build(pieces, np.zeros(257), [], list(range(256)))
    with pytest.raises(ValueError):
        sentencepiece_codec.Vocabulary.build(["a"], np.zeros(1), [], [])


def test_ranks_become_log_probabilities():
    scores = sentencepiece_codec.log_scores(-np.arange(100.0))
    assert np.isclose(np.exp(scores).sum(), 1) and (np.diff(scores) < 0).all()
    own = np.array([-1.5, -2.25, -3.0])
    assert (sentencepiece_codec.log_scores(own) == own).all()
