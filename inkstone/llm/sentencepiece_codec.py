"""Operator 8: SentencePiece encoding and decoding, unigram Viterbi over a double-array trie.

The vocabulary's pieces go into a double-array trie over bytes. A text becomes a leading space and its own characters,
with spaces shown as U+2581. No piece of a vocabulary that marks word starts crosses from a character into a marker, so a
text falls apart into units (a run of markers and the characters up to the next marker or line end) whose best
segmentations are independent. Each different unit of a batch is segmented once; all units advance together, one byte
position at a time, through arrays. Characters without a piece are spelled in byte pieces. A vocabulary with pieces that
cross units is refused.

Scores are natural-log probabilities. A BPE model states merge ranks instead; `log_scores` turns these into log
probabilities by Zipf's law. Ties keep the segmentation found first, with the longer last piece.

Defined cases: null and empty texts have no pieces and decode to the empty string. U+2581 in a text is spelled in byte
pieces, so decoding returns it (a plain decoder would show a space). Repeated rows are encoded alike. Extra columns are
kept by `encode` and `decode`. Very long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_buffer
from .windows import _BYTES, prefix_hash, span_hash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
UNKNOWN_PENALTY = 10.0
#: Bytes of text encoded at a time.
PIECE_BYTES = 4 << 20


def log_scores(scores: np.ndarray) -> np.ndarray:
    """Merge ranks 0, -1, -2 ... as Zipf log probabilities; other scores as they are."""
    if len(scores) < 2 or (scores != np.round(scores)).any() or scores.max() > 0 or scores.min() > -len(scores) / 2:
        return scores.astype(np.float64)
    rank = -scores.astype(np.float64) + 1
    return -np.log(rank) - np.log((1 / np.unique(rank)).sum())


@dataclass
class Vocabulary:
    """A trie in two arrays (state s moves on byte b to base[s] + b if check says so), the pieces and their scores."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray  # piece that ends in a state, or -1
    score: np.ndarray
    byte_piece: np.ndarray  # piece of each byte
    out: bytes  # what pieces decode to, one after the other
    out_at: np.ndarray
    deepest: int
    pairs: np.ndarray  # bytes that stand side by side in some piece

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        return cls.build([sp.id_to_piece(i) for i in range(n)], np.array([sp.get_score(i) for i in range(n)]), [i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)], [i for i in range(n) if sp.is_byte(i)])

    @classmethod
    def build(cls, pieces: list[str], scores: np.ndarray, special: list[int], byte_ids: list[int]) -> Vocabulary:
        byte_piece = np.full(256, -1, np.int64)
        for i in byte_ids:
            byte_piece[int(pieces[i][1:-1], 16)] = i
        if (byte_piece < 0).any():
            raise ValueError("the vocabulary has no byte pieces to fall back on")
        apart = {*special, *byte_ids}
        plain = {i: p.encode() for i, p in enumerate(pieces) if i not in apart and p}
        mark = MARK.decode()
        if any("\n" in pieces[i] or mark in pieces[i].lstrip(mark) for i in plain):
            raise ValueError("a piece crosses from a character into a word's start or a line's end")
        usable = np.array(sorted(plain))
        score = np.full(len(pieces), -np.inf)
        score[usable] = log_scores(np.asarray(scores, np.float64)[usable])
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for i, body in plain.items():
            node = 0
            for byte in body:
                node = children[node].setdefault(byte, len(children))
                if node == len(children):
                    children.append({})
            if node not in ends or score[i] > score[ends[node]]:
                ends[node] = i
        # Double array: nodes with one child fill the holes; the search for others' cells moves on after long searches.
        size = 2 * len(children) + 4096
        base, check, piece = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        taken = bytearray(size)
        taken[0] = 1
        state, todo, hole, front = {0: 0}, [0], 1, 1
        while todo:
            node = todo.pop()
            keys = sorted(children[node])
            if not keys:
                continue
            if len(keys) == 1:
                hole = max(hole, keys[0])
                while taken[hole]:
                    hole += 1
                at = hole - keys[0]
            else:
                at = first = max(0, front - keys[0])
                while any(taken[at + key] for key in keys):
                    at += 1
                front = at if at - first > 64 else front
            base[state[node]] = at
            for key in keys:
                child = children[node][key]
                taken[at + key] = 1
                check[at + key] = state[node]
                state[child] = at + key
                piece[at + key] = ends.get(child, -1)
                todo.append(child)
        used = int(np.flatnonzero(np.frombuffer(taken, np.uint8))[-1]) + 257
        pairs = np.zeros((256, 256), bool)
        for body in plain.values():
            both = np.frombuffer(body, np.uint8)
            pairs[both[:-1], both[1:]] = True
        out = [b"" if i in apart else p.encode().replace(MARK, b" ") for i, p in enumerate(pieces)]
        for i in byte_ids:
            out[i] = bytes([int(pieces[i][1:-1], 16)])
        return cls(*(np.r_[x[:used], np.full(max(0, used - size), empty)] for x, empty in ((base, 0), (check, -1), (piece, -1))), score, byte_piece, b"".join(out), np.r_[0, np.cumsum([len(x) for x in out])], max(map(len, plain.values())), pairs)

    def segment(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, offsets) of the best segmentations of the units data[start:stop]."""
        length = stop - start
        at = np.r_[0, np.cumsum(length + 1)]
        best, back, via = np.full(at[-1], -np.inf), np.zeros(at[-1], np.int64), np.full(at[-1], -1, np.int64)
        best[at[:-1]] = 0
        unknown = self.score[np.isfinite(self.score)].min() - UNKNOWN_PENALTY
        order = np.argsort(-length, kind="stable")
        descending = length[order]
        for position in range(int(length.max(initial=0))):
            rows = order[: int(np.searchsorted(-descending, -position, side="left"))]
            here = at[rows] + position
            live = np.isfinite(best[here])
            rows, here = rows[live], here[live]
            state, spelled = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
            first = data[start[rows] + position]
            width = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
            width = np.minimum(width, length[rows] - position)
            alive = np.arange(len(rows))
            for step in range(self.deepest):
                alive = alive[position + step < length[rows[alive]]]
                if not len(alive):
                    break
                target = self.base[state[alive]] + data[start[rows[alive]] + position + step]
                fits = self.check[target] == state[alive]
                alive = alive[fits]
                state[alive] = target[fits]
                piece = self.piece[state[alive]]
                ended = alive[piece >= 0]
                piece = piece[piece >= 0]
                goal = here[ended] + step + 1
                value = best[here[ended]] + self.score[piece]
                better = value >= best[goal]
                better &= (value > best[goal]) | (via[goal] < 0)
                best[goal[better]], back[goal[better]], via[goal[better]] = value[better], here[ended[better]], piece[better]
                spelled[ended[step + 1 == width[ended]]] = True
            lone = np.flatnonzero(~spelled)
            goal, value = here[lone] + width[lone], best[here[lone]] + unknown
            better = value > best[goal]
            best[goal[better]], back[goal[better]], via[goal[better]] = value[better], here[lone[better]], -2
        # Walk back from the ends, all units together; a step is a piece, or the bytes of a character.
        cursor, owner = at[1:] - 1, np.arange(len(length))
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(moving := np.flatnonzero(cursor > at[owner])):
            cursor, owner = cursor[moving], owner[moving]
            steps.append((owner, back[cursor] - at[owner], cursor - back[cursor]))
            cursor = back[cursor]
        if not steps:
            return np.zeros(0, np.int32), np.zeros(len(length) + 1, np.int64)
        unit, place, width = (np.concatenate(x) for x in zip(*steps, strict=True))
        piece = via[at[unit] + place + width]
        # Spelled characters become one entry a byte.
        times = np.where(piece == -2, width, 1)
        unit, place, piece = (np.repeat(x, times) for x in (unit, place, piece))
        inner = np.arange(len(unit)) - np.repeat(np.cumsum(times) - times, times)
        spelled = piece == -2
        place = place + np.where(spelled, inner, 0)
        piece[spelled] = self.byte_piece[data[start[unit[spelled]] + place[spelled]]]
        order = np.lexsort((place, unit))
        return piece[order].astype(np.int32), np.searchsorted(unit[order], np.arange(len(length) + 1))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, offsets by document) of a buffer of documents."""
        marked, bounds, literal = _mark(data, offsets)
        if not len(marked):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        start, stop = _units(marked, bounds, literal, self.pairs)
        key = span_hash(prefix_hash(_BYTES[marked]), start, stop) * np.uint64(2) + literal[start]
        _, sample, which = np.unique(key, return_index=True, return_inverse=True)
        alone = np.flatnonzero(_unlike(marked, start, stop, sample[which]))
        which[alone] = len(sample) + np.arange(len(alone))
        sample = np.r_[sample, alone]
        pieces, at = self.segment(marked, start[sample], stop[sample])
        spelled = literal[start[sample]]
        if spelled.any():  # U+2581 of the text itself
            own = np.flatnonzero(spelled)
            for i in own.tolist():
                pieces[at[i] : at[i + 1]] = -1
            flat = [self.byte_piece[list(MARK)] if s else pieces[at[i] : at[i + 1]] for i, s in enumerate(spelled.tolist())]
            pieces, at = np.concatenate(flat).astype(np.int32), np.r_[0, np.cumsum([len(x) for x in flat])]
        ids, ends = _gather(pieces, at, which)
        return ids, ends[np.searchsorted(start, bounds)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts of encoded documents: the pieces' bytes without the leading space."""
        body, ends = _gather(np.frombuffer(self.out, np.uint8), self.out_at, ids)
        bounds = ends[offsets]
        full = np.flatnonzero(bounds[1:] > bounds[:-1])
        lead = bounds[full][body[bounds[full]] == 32]
        keep = np.ones(len(body), bool)
        keep[lead] = False
        return body[keep], np.r_[0, np.cumsum(keep)][bounds]


def _unlike(data: np.ndarray, start: np.ndarray, stop: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Which units hold other bytes than the unit that `like` names for them, though their hashes are equal."""
    size, other = stop - start, start[like]
    differ = size != stop[like] - other
    size = np.where(differ | (start == other), 0, size)
    unit = np.repeat(np.arange(len(size)), size)
    inner = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)
    differ[unit[data[start[unit] + inner] != data[other[unit] + inner]]] = True
    return differ


def _gather(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate flat[at[i]:at[i + 1]] for each i of `which`; also where each ends."""
    first, size = at[which], at[which + 1] - at[which]
    ends = np.r_[0, np.cumsum(size)]
    index = np.arange(int(ends[-1])) + np.repeat(first - ends[:-1], size)
    return flat[index], ends


def _mark(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with a leading marker and markers for spaces, bounds, where a U+2581 of the text itself stands)."""
    lengths = np.diff(offsets)
    part = data[offsets[0] : offsets[-1]]
    space = part == 32
    grown = np.ones(len(part), np.int64) + 2 * space
    lead = np.zeros(len(part) + 1, np.int64)
    full = lengths > 0
    np.add.at(lead, (offsets[:-1] - offsets[0])[full], 3)
    ends = np.cumsum(grown + lead[:-1])
    total = int(ends[-1]) if len(ends) else 0
    out = np.empty(total, np.uint8)
    first = ends - grown
    out[first] = np.where(space, MARK[0], part)
    for extra in (1, 2):
        out[first[space] + extra] = MARK[extra]
    heads = first[(offsets[:-1] - offsets[0])[full]] - 3
    for extra in range(3):
        out[heads + extra] = MARK[extra]
    bounds = np.r_[0, np.cumsum(_per_document(grown, offsets - offsets[0]) + 3 * full)]
    literal = np.zeros(total + 1, bool)
    own = np.flatnonzero((part[:-2] == MARK[0]) & (part[1:-1] == MARK[1]) & (part[2:] == MARK[2])) if len(part) > 2 else np.zeros(0, np.int64)
    literal[first[own]] = True
    return out, bounds, literal


def _per_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(values)][bounds])


def _units(marked: np.ndarray, bounds: np.ndarray, literal: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the units: a marker after another character starts one, so does a line's end and a character whose first
    byte follows the byte before it in no piece; a U+2581 of the text itself stands alone."""
    n = len(marked)
    head = np.zeros(n, bool)
    if n > 2:
        head[:-2] = (marked[:-2] == MARK[0]) & (marked[1:-1] == MARK[1]) & (marked[2:] == MARK[2])
    head &= ~literal[:n]
    after_mark = np.zeros(n, bool)
    after_mark[3:] = head[:-3]
    new = head & ~after_mark
    line = marked == 10
    new |= line
    new[1:] |= line[:-1]
    new[1:] |= ~pairs[marked[:-1], marked[1:]] & ((marked[1:] & 0xC0) != 0x80)
    own = np.flatnonzero(literal[:n])
    new[own] = True
    new[np.minimum(own + 3, n - 1)[own + 3 < n]] = True
    starts = bounds[:-1][bounds[1:] > bounds[:-1]]
    new[starts] = True
    start = np.flatnonzero(new)
    return start, np.r_[start[1:], n]


_vocabularies: dict[int, Vocabulary] = {}


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + PIECE_BYTES, side="right")) - 1)
        yield low, high
        low = high


def _digests(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    bytes_of = np.zeros(len(vocabulary.out_at) - 1, bool)
    bytes_of[vocabulary.byte_piece] = True
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        for low, high in _slices(offsets):
            ids, at = vocabulary.encode(data, offsets[low : high + 1])
            body, ends = vocabulary.decode(ids, at)
            rows = {"doc_id": batch.column("doc_id").slice(low, high - low), "n_pieces": pa.array(np.diff(at)), "n_byte_pieces": pa.array(_per_document(bytes_of[ids].astype(np.int64), at))}
            wide = ids.astype("<i4")
            rows["ids_sha256"] = pa.array([hashlib.sha256(wide[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())
            rows["decoded_sha256"] = pa.array([hashlib.sha256(body[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())
            rows["round_trip"] = pa.array([bool(np.array_equal(data[a:b], body[c:d])) for a, b, c, d in zip(*(x.tolist() for x in (offsets[low:high], offsets[low + 1 : high + 1], ends[:-1], ends[1:])), strict=True)])
            if keep_ids:
                rows["ids"] = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_pydict(rows)


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, text: str, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(text))
        for low, high in _slices(offsets):
            ids, at = vocabulary.encode(data, offsets[low : high + 1])
            part = batch.slice(low, high - low)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*batch.schema.names, name])


def _decode(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, ids: str, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(ids)
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        body, ends = vocabulary.decode(flat, np.r_[0, np.cumsum(size)])
        texts = pa.array([body[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, name])


def _sent(df: DataFrame, model: str) -> Vocabulary:
    """The vocabulary as a broadcast: its size is fixed, some megabytes, whatever the input."""
    return df.sparkSession.sparkContext.broadcast(Vocabulary.load(model))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encode(documents: DataFrame, text_col: str = "text", model: str = MODEL, name: str = "ids") -> DataFrame:
    """documents with a column `name`: the pieces of each text. A column of that name is replaced, as withColumn does."""
    sent, rows = _sent(documents, model), documents.drop(name)
    return rows.mapInArrow(lambda b: _encode(b, sent.value, text_col, name), f"{_ddl(rows)}, `{name}` array<int>")


def decode(encoded: DataFrame, ids_col: str = "ids", model: str = MODEL, name: str = "decoded") -> DataFrame:
    """encoded with a column `name`: the text that the pieces stand for. A column of that name is replaced."""
    sent, rows = _sent(encoded, model), encoded.drop(name)
    return rows.mapInArrow(lambda b: _decode(b, sent.value, ids_col, name), f"{_ddl(rows)}, `{name}` string")


def codec_digest(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, keep_ids: bool = False) -> DataFrame:
    """Per document: number of pieces and of byte pieces, digests of the ids (int32, little end first) and of the decoded
    text, whether decoding gives the text back, and if wanted the ids."""
    sent = _sent(documents, model)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    fields = "doc_id long, n_pieces long, n_byte_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(lambda b: _digests(b, sent.value, keep_ids), fields)
