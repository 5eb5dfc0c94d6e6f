"""Operator 6: main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams a page's events into lines (blocks of text), each with its number of tags and the
section it stands in. Menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles and reader
comments are left out by their elements and by what their class, id and role call them. What they are is not always said: over
the lines of every page the logarithm of the text-to-tag ratio is smoothed by a Gaussian (in and outside an article apart) and split by a threshold between its
two clusters. A section, which is a part of the page or of its article, is kept whole or not at all, by the share of its text
that stands in lines above the threshold: short paragraphs and lists stay with the text around them, lists of links and
teasers go wherever they stand, in the article too. Tags that part blocks or format words are not counted, since short lines of
prose have them as well. An element's name, article or main, decides between regions of prose: it wins if it holds at least as
much content as the rest of the page.

Defined cases: a null or empty page gives an empty text. Broken markup is read as the parser reads it; unclosed elements
end with their section. Character references are decoded, with or without semicolon. Inside a block white space becomes
one space. Marked sections and broken declarations are comments. Repeated pages give repeated rows. Lines at the threshold
are content, and so are all lines where the clusters are not apart or all ratios tie. Very long and very deep pages are read whole, in time that grows with their length. Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of elements.
DROPPED = frozenset("script style noscript template svg math canvas iframe object embed audio video map form button select textarea input label fieldset datalist nav aside footer dialog menu head title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SECTIONS = frozenset("article main section div body html".split())
CLOSES_P = BLOCKS - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: What a part of a page is called that is never content (outside an article also the second list), and words that say
#: only that something is a part. A class or id names such a part if that is its last word but for these.
NEVER = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsors sponsored promo promotion cookie cookies consent gdpr popup modal newsletter subscribe subscription sidebar feedback teaser teasers related recommended trending nav navbar navigation breadcrumb breadcrumbs comment comments commentlist disqus replies respond share sharing social pagination pager".split())
OUTSIDE = frozenset("notice notices overlay menu footer masthead header discussion skiplink login signup search popular".split())
PARTS = frozenset("area bar block body box buttons card cell col column container content form group holder icons inner item items left link links list main module outer panel right row section slot text top unit widget wrap wrapper".split())
WORD = re.compile(r"[a-z]+", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
SPACE = re.compile(r"\s+")
#: Tags that format words. They and those of blocks say nothing about what a line is.
FORMATS = frozenset("b i em strong u s small sub sup br wbr span code kbd samp var mark q cite abbr time del ins dfn bdi bdo ruby rt rp font big tt center".split())
#: The threshold lies between the clusters if one's ratio is at least APART times the other's; it is never above CEILING
#: characters a tag: a line with as much text as that for each of its tags is no link of a list.
APART, CEILING = 4.0, 15.0


def named_for(names: str, kinds: frozenset[str]) -> bool:
    """Whether a class or id among the names is called after one of the kinds: comments, reader-comments, comment_list."""
    for name in names.lower().split():
        words = WORD.findall(name)
        while len(words) > 1 and words[-1] in PARTS:
            words.pop()
        if words and words[-1] in kinds:
            return True
    return False


class Lines(HTMLParser):
    """Turns events into lines: text, number of tags, number of the section, whether that is named article or main.

    Open elements are found through the places of each kind, so a page's work grows with its length, however deep it is."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.open: list[tuple[str, bool, int, int]] = []  # tag, dropped, section, rank of the section
        self.places: dict[str, list[int]] = {}  # of each tag, and of all blocks and all sections
        self.dropped = 0
        self.sections = 0
        self.text: list[str] = []
        self.tags = 0

    def kinds(self, tag: str) -> list[str]:
        return [tag] + ["#block"] * (tag in BLOCKS) + ["#section"] * (tag in SECTIONS)

    def last(self, kind: str) -> int:
        """Place of the innermost open element of a kind, or -1."""
        places = self.places.get(kind)
        return places[-1] if places else -1

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            section, rank = (self.open[-1][2], self.open[-1][3]) if self.open else (0, 0)
            self.lines.append((text, self.tags, section, rank))
        self.tags = 0
        self.text.clear()

    def count(self, tag: str) -> None:
        self.tags += not self.dropped and tag not in BLOCKS and tag not in FORMATS

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            if tag in CLOSES_P and self.last("p") > self.last("#section"):
                self.close_from(self.last("p"))
            if tag != "html" and self.last("head") >= 0:  # its end may be left out; no block stands in it
                self.close_from(self.last("head"))
        self.count(tag)
        if tag in VOID:
            self.text.append(" " if tag == "br" and not self.dropped else "")
            return
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and self.open and self.open[-1][0] == tag:
            self.close_from(len(self.open) - 1)
        named = {k: v or "" for k, v in attrs}
        section, rank = (self.open[-1][2], self.open[-1][3]) if self.open else (0, 0)
        out = tag in DROPPED or "hidden" in named or named.get("aria-hidden") == "true" or named.get("role", "").lower() in ROLES
        out = out or tag == "header" and rank < 2
        if tag not in ("html", "body", "article", "main"):
            own = " ".join(named[k] for k in ("class", "id") if k in named)
            out = out or bool(own) and (named_for(own, NEVER) or rank < 2 and named_for(own, OUTSIDE))
        if tag in SECTIONS and not self.dropped and not out:
            self.sections += 1
            section = self.sections
            rank = max(rank, 3 if tag == "article" else 2 if tag == "main" or named.get("role", "").lower() == "main" else 1)
        for kind in self.kinds(tag):
            self.places.setdefault(kind, []).append(len(self.open))
        self.open.append((tag, out, section, rank))
        self.dropped += out

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close_from(self, at: int) -> None:
        """Close the element at a place, with all that is open inside it."""
        if self.last("#block") >= at:
            self.flush()
        while len(self.open) > at:
            tag, out, _, _ = self.open.pop()
            self.dropped -= out
            for kind in self.kinds(tag):
                self.places[kind].pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.count(tag)
        at = self.last(tag)
        # An inline element has ended before if a block is open inside it.
        if at >= 0 and (tag in BLOCKS or tag in DROPPED or at > self.last("#block")):
            self.close_from(at)

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.text.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Marked sections (<![if ...]>, <![CDATA[...]]>) are comments up to the next >, whatever their name."""
        return self.parse_bogus_comment(i)


def threshold(values: np.ndarray) -> float:
    """Where the two clusters of some values part: the mean of their means, from two-means that starts at the extremes. If the
    clusters are not apart, the least value."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        upper = values >= (low + high) / 2
        if upper.all():
            break
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2 if high - low >= np.log(APART) else float(values.min())


def content_lines(lines: list[tuple[str, int, int, int]], sigma: float = 1.0) -> np.ndarray:
    """Which lines lie above the threshold of the smoothed ratio. What stands in an article and what does not are smoothed
    apart."""
    ratio = np.log([max(1.0, len(x[0]) / (1 + x[1])) for x in lines])
    named = np.array([x[3] >= 2 for x in lines])
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    parts = np.split(ratio, np.flatnonzero(named[1:] != named[:-1]) + 1)
    smooth = np.concatenate([np.convolve(np.pad(x, reach, mode="edge"), kernel / kernel.sum(), mode="valid") for x in parts])
    return smooth >= min(threshold(smooth), np.log(CEILING))


def select(lines: list[tuple[str, int, int, int]], sigma: float = 1.0, share: float = 0.5) -> list[bool]:
    """Which lines belong to the content: those of the sections in which at least `share` of the text stands in content lines.
    Where named sections (article, main) hold at least as much content as all others together, of the others none; where they
    hold less, a page's text stands elsewhere, and sections count alike. If no section is left, the one with most content."""
    if not lines:
        return []
    size, content = np.array([len(x[0]) for x in lines], float), content_lines(lines, sigma)
    section, named = np.array([x[2] for x in lines]), np.array([x[3] for x in lines]) >= 2
    _, which = np.unique(section, return_inverse=True)
    mass = np.bincount(which, size * content)
    kept = (mass >= share * np.bincount(which, size))[which]
    inside, outside = (float(size[content & x].sum()) for x in (named, ~named))
    region = named if named.any() and inside >= outside else np.ones(len(lines), bool)
    if not (kept & region).any():
        whole = np.bincount(which, size)
        kept = which == which[region][(mass[which[region]] + whole[which[region]] * 1e-9).argmax()]
    return (kept & region).tolist()


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return "\n".join(x[0] for x, keep in zip(parser.lines, select(parser.lines), strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) if x else "" for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points)."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
