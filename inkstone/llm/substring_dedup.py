"""Operator 1: substring dedup over words with repeated-phrase automata.

Stretches of all documents that may hold a recurring passage meet in shards (`windows`). A shard confirms which 13-word
phrases recur, compiles them into one Aho-Corasick automaton over word numbers and streams its stretches through it, which
locates every occurrence. A word goes if a window that covers it also starts in a document with a smaller id; windows are
judged on the input.

Defined cases: null, empty and short texts (fewer words than a window) keep every word. Repeated rows of one id do not
count as another document. Documents without an id come last and are nobody's source. Extra columns are ignored. An empty
table gives an empty result. Ties cannot arise: the owner of a window is its smallest id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import covered, runs, text_buffer
from .windows import Shard, hits_of, mix, prefix_hash, repeated_windows, smaller_owners, span_hash, with_hits, with_keys, word_tokens

WIDTH, ANCHOR = 13, 6
#: Numbers that a character can stand for: those beyond the first plane.
MOST_CHARACTERS = 0x100000
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def _bodies(data: np.ndarray, offsets: np.ndarray, bounds: np.ndarray, docs: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[bytes]:
    """The words start:stop of documents, joined by single spaces."""
    split = {d: data[offsets[d] : offsets[d + 1]].tobytes().split() for d in np.unique(docs).tolist()}
    return [b" ".join(split[d][a:b]) for d, a, b in zip(docs.tolist(), start.tolist(), stop.tolist(), strict=True)]


def recurring_phrases(numbers: np.ndarray, at: np.ndarray, owner: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Confirm: of the phrases that start at some places in a row of word numbers, those that recur, each by one of its
    places and with its smallest owner. `owner` and `last` are the smallest document with an id and the largest key that
    hold the text of a place; a phrase recurs if they differ over all its places."""
    one, two = prefix_hash(mix(numbers)), prefix_hash(mix(numbers ^ np.uint64(0x5851F42D4C957F2D)))
    a, b = span_hash(one, at, at + width), span_hash(two, at, at + width)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    if not len(first):
        return first, first
    low, high = np.minimum.reduceat(owner[order], first), np.maximum.reduceat(last[order], first)
    recurs = low < high
    return at[order[first[recurs]]], low[recurs]


def locate(shard: Shard, top: int, width: int = WIDTH) -> list[np.ndarray]:
    """Confirm a shard's recurring phrases, compile them into an automaton and stream all its stretches through it.

    Returns the runs of windows that a smaller document owns. Equal stretches stream once. Words are numbered, and a number
    is a character to the automaton, while characters last."""
    which, texts = pd.factorize(pd.Series(shard.texts, dtype=object))
    which, texts = which.astype(np.int64), list(texts)
    body = which[shard.body]
    none = np.iinfo(np.int64).max
    owner, last = np.full(len(texts), none), np.full(len(texts), -none)
    real = shard.did <= top
    np.minimum.at(owner, body[real], shard.did[real])
    np.maximum.at(last, body, shard.did)
    n = np.zeros(len(texts), np.int64)
    n[which] = shard.n
    held = np.cumsum(n) - n
    lowest = np.full(int(n.sum()), none)
    if len(texts):
        numbers: dict[bytes, int] = {}
        flat = np.fromiter((numbers.setdefault(w, len(numbers)) for w in b" ".join(texts).split(b" ")), np.int64)
        begin = held + np.arange(len(texts)) * (width - 1)  # a text has width - 1 words more than windows
        window = np.arange(len(lowest)) + np.repeat(begin - held, n)
        own = np.repeat(np.arange(len(texts)), n)
        places, owners = recurring_phrases(flat.astype(np.uint64), window, owner[own], last[own], width)
        few = len(numbers) <= MOST_CHARACTERS
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_STRING if few else ahocorasick.KEY_SEQUENCE)
        stream = (flat + 0x10000).astype("<u4").tobytes().decode("utf-32-le") if few else tuple(flat.tolist())
        for a, phrase_owner in zip(places.tolist(), owners.tolist(), strict=True):
            automaton.add_word(stream[a : a + width], phrase_owner)
        if len(places):
            automaton.make_automaton()
            end, found = [], []
            for a, size, low in zip(begin.tolist(), n.tolist(), held.tolist(), strict=True):
                for stop, phrase_owner in automaton.iter(stream[a : a + size + width - 1]):
                    end.append(low + stop)
                    found.append(phrase_owner)
            lowest[np.array(end, np.int64) - (width - 1)] = found
    return smaller_owners(held[which], shard, lowest)


def _remove(batches: Iterator[pa.RecordBatch], width: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {name: [] for name in _OUT.names}
        data, offsets = text_buffer(batch.column("text"))
        at = offsets.tolist()
        for i, (doc_id, (starts, counts)) in enumerate(zip(batch.column("doc_id").to_pylist(), hits_of(batch), strict=True)):
            words = data[at[i] : at[i + 1]].tobytes().split()
            if len(starts):
                gone = covered(starts, counts, width, len(words)).tolist()
                kept = [w for w, g in zip(words, gone, strict=True) if not g]
            else:
                kept = words
            body = b" ".join(kept)
            for name, value in zip(out, (doc_id, len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest(), body.decode() if keep_text else None), strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=_OUT)


def dedup_words(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, anchor: int = ANCHOR, keep_text: bool = True) -> DataFrame:
    """Documents without the words of repeated passages: doc_id, n_words, n_removed, kept_sha256 and (if asked) kept."""
    keyed = with_keys(documents, id_col, text_col)
    hits = repeated_windows(keyed, word_tokens, _bodies, lambda shard, top: locate(shard, top, width), width, anchor)
    return with_hits(keyed, hits).mapInArrow(lambda b: _remove(b, width, keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
