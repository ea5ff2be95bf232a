"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search keeps a boundary's backpointer and the piece that ends there. Only boundaries within the longest piece of the
current one can still be extended; whenever the backpointer paths of all of them meet in one boundary, the ids up to it
are final and leave the window.

Unigram models: a path's score is the sum of its pieces' scores. BPE models: a piece may follow another only if merging
the two alone gives the two again; that leaves exactly one path to each boundary, the one that merging the whole text
gives, so that ids equal those of rank-ordered merging.

All texts are searched that way, words too; a word's ids are remembered. Between words, and between characters that no piece has
side by side, all paths meet, so that a text may be cut there before it is searched.

Nulls stay null, an empty text has no ids, very long texts take a window of bounded size, repeated rows are encoded each for
itself. Ties of unigram scores go to the longer last piece. An empty table gives an empty one. Other columns aren't read.
"""

from __future__ import annotations

import codecs
import math
import re
import struct
import zlib
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SPACE = "▁"
# fixed values: piece types and model types of the model file
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
_NONE: dict = {}
#: Pairs of pieces of which a worker remembers whether one may follow the other.
PAIRS = 1_000_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Vocabulary:
    """Pieces of a model file and how its texts are prepared."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model: int = UNIGRAM
    byte_fallback: bool = False
    dummy_prefix: bool = True
    squeeze: bool = True
    charsmap: bytes = b""

    @classmethod
    def parse(cls, data: bytes) -> Vocabulary:
        out = cls()
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode("utf-8")
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                out.pieces.append(piece)
                out.scores.append(score)
                out.kinds.append(kind)
            elif number == 2:
                known = dict(_fields(value))
                out.model, out.byte_fallback = known.get(3, UNIGRAM), bool(known.get(35, 0))
            elif number == 3:
                known = dict(_fields(value))
                out.charsmap = known.get(2, b"")
                out.dummy_prefix, out.squeeze = bool(known.get(3, 1)), bool(known.get(4, 1))
        if out.model not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be searched")
        if out.charsmap:
            raise ValueError("models with a compiled character map are not supported; normalise the text before")
        return out


class Codec:
    """Encodes and decodes; one per worker, as it remembers what it has found."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        usable = [i for i, k in enumerate(v.kinds) if k in (NORMAL, USER_DEFINED)]
        self.ids = {v.pieces[i]: i for i in reversed(usable)}
        self.score = {v.pieces[i]: v.scores[i] for i in usable}
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = {int(v.pieces[i][3:5], 16): i for i, k in enumerate(v.kinds) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(v.kinds) if k == UNKNOWN), 0)
        self.unknown_score = min((v.scores[i] for i in usable), default=0.0) - UNKNOWN_PENALTY
        self.follows: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.whole: dict[str, bool] = {}
        self.edges: dict[str, tuple[list, list] | None] = {}
        #: No piece goes on over these places, so all paths meet there.
        self.cuts_at_space = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.cuts_at_line = not any("\n" in p for p in self.ids)
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.words, self.starts = common.Memo(lambda w: self._parts(SPACE + w)), common.Memo(self._parts)
        self.parts = common.Memo(self._ids)
        self.surface = [self._surface(i) for i in range(len(v.pieces))]

    def _surface(self, i: int) -> bytes:
        kind = self.v.kinds[i]
        if kind == BYTE:
            return bytes([int(self.v.pieces[i][3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else self.v.pieces[i].replace(SPACE, " ").encode()

    def merged(self, text: str, edges: tuple[list, list] | None = None) -> list[str]:
        """Pieces of a short text by merging the best pair again and again: the definition of BPE that follows() rests on.

        edges: gets what stands at the first and at the last place over time, each with the score of the merge that ends it.
        """
        parts, alive, score = list(text), [True] * len(text), self.score
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-score[w], i, w) for i in range(n - 1) if (w := text[i : i + 2]) in score]
        heapify(heap)
        while heap:
            _, i, whole = heappop(heap)
            if not alive[i] or (j := after[i]) >= n or parts[i] + parts[j] != whole:
                continue
            if edges:
                if i == 0:
                    edges[0].append((parts[0], score[whole]))
                if after[j] == n:
                    edges[1].append((parts[j], score[whole]))
            parts[i], alive[j], after[i] = whole, False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (w := whole + parts[after[j]]) in score:
                    heappush(heap, (-score[w], i, w))
            if (h := before[i]) >= 0 and (w := parts[h] + whole) in score:
                heappush(heap, (-score[w], h, w))
        return [p for p, a in zip(parts, alive) if a]

    def _edges(self, piece: str) -> tuple[list, list] | None:
        """What stands at a piece's first and last place while it is merged; None if its merges don't come in the order of their scores."""
        found = self.edges.get(piece, _NONE)
        if found is _NONE:
            first, last = [], []
            found = None
            if self.merged(piece, (first, last)) == [piece] and all(x == sorted(x, key=lambda e: -e[1]) for x in (first, last)):
                found = ([*first, (piece, -math.inf)], [*last, (piece, -math.inf)])
            self.edges[piece] = found
        return found

    def _apart(self, left: str, right: str) -> bool:
        """Would merging the two leave them as they are?"""
        a, b = self._edges(left), self._edges(right)
        if a is None or b is None:
            return self.merged(left + right) == [left, right]
        lasts, firsts, i, j, score = a[1], b[0], 0, 0, self.score
        while True:
            (x, ends_x), (y, ends_y) = lasts[i], firsts[j]
            both = score.get(x + y)
            # a merge over the border comes first; of equal scores the one further left does
            if both is not None and both > ends_x and both >= ends_y:
                return False
            if ends_x == ends_y == -math.inf:
                return True
            if ends_x >= ends_y:
                i += 1
            else:
                j += 1

    def _may_follow(self, left: str, right: str) -> bool:
        known = self.follows.get(left)
        if known is None:
            known = self.follows[left] = {}
        may = known.get(right)
        if may is None:
            self.pairs += 1
            if self.pairs > PAIRS:
                self.follows.clear()
                self.pairs = 0
            may = known[right] = self._apart(left, right)
        return may

    def pieces(self, text: str):
        """The pieces of a prepared text, each as soon as it is certain.

        Of the boundaries from base on, the window, it is known where the piece that ends there begins, which it is, and the
        path's score. Once the window is twice as long as the longest piece, the paths from all boundaries that a piece can
        still begin at are followed back; what lies before the place where they meet is given out and leaves the window. A text
        of any length needs a window of three times the longest piece, unless its paths don't meet.
        """
        bpe, longest, vocabulary, follows, unknown = self.v.model == BPE, self.longest, self.score, self.follows, self.unknown_score
        base, came, last, best, known = 0, [0], [""], [0.0], [_NONE]
        n, check = len(text), 2 * self.longest
        for end in range(1, n + 1):
            found, top, whence = None, 0.0, -1
            for start in range(end - longest if end - longest > base else base, end):
                at = start - base
                if came[at] < 0:  # no piece ends there
                    continue
                piece = text[start:end]
                if piece in vocabulary:
                    gain = vocabulary[piece]
                elif start == end - 1:
                    gain = unknown
                else:
                    continue
                if bpe:
                    if last[at]:
                        may = known[at].get(piece)
                        if not (self._may_follow(last[at], piece) if may is None else may):
                            continue
                    elif len(piece) > 1 and not self._whole(piece):
                        continue
                    found, whence = piece, start
                    break
                if found is None or best[at] + gain > top:
                    found, top, whence = piece, best[at] + gain, start
            came.append(whence)
            last.append(found)
            best.append(top)
            known.append(follows.get(found, _NONE) if bpe else _NONE)
            if end - base == check:
                alive = {b for b in range(end - longest + 1, end + 1) if came[b - base] >= 0}
                while len(alive) > 1 and base not in alive:
                    latest = max(alive)
                    alive.remove(latest)
                    alive.add(came[latest - base])
                meet = min(alive)
                if meet > base:
                    yield from self._path(came, last, base, meet)
                    for window in (came, last, best, known):
                        del window[: meet - base]
                    base = meet
                check = max(2 * longest, end - base + longest)
        yield from self._path(came, last, base, n)

    def _whole(self, piece: str) -> bool:
        """Does merging a piece's own characters give the piece?"""
        known = self.whole.get(piece)
        if known is None:
            known = self.whole[piece] = self.merged(piece) == [piece]
        return known

    @staticmethod
    def _path(came: list, last: list, base: int, end: int) -> list[str]:
        out = []
        while end > base:
            out.append(last[end - base])
            end = came[end - base]
        return out[::-1]

    def _parts(self, text: str) -> bytes:
        """Ids of a text that is first cut between characters that no piece has side by side: all paths meet there."""
        inside = self.inside
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in inside]
        if not cuts:
            return self._ids(text)
        return b"".join([self.parts[text[a:b]] for a, b in zip([0, *cuts], [*cuts, len(text)])])

    def _ids(self, text: str) -> bytes:
        out: list[int] = []
        fresh_unknown = True
        for piece in self.pieces(text):
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
                fresh_unknown = True
            elif self.v.byte_fallback:
                out.extend(self.bytes[b] for b in piece.encode())
            elif fresh_unknown:  # a run of unknown characters is one id
                out.append(self.unknown)
                fresh_unknown = False
        return np.array(out, "<i4").tobytes()

    def prepared(self, text: str) -> str:
        if self.v.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        text = text.replace(" ", SPACE)
        return SPACE + text if text and self.v.dummy_prefix else text

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        self.words.fresh(), self.starts.fresh(), self.parts.fresh()
        plain = self.cuts_at_space and self.v.dummy_prefix and not self.v.squeeze and self.v.byte_fallback
        if plain and "  " not in text and text[0] != " " and SPACE not in text and (self.cuts_at_line or "\n" not in text) and "\n " not in text:
            lines = text.split("\n")
            newline = self.starts["\n"]
            parts = [b"".join(map(self.words.__getitem__, lines[0].split(" ")))]
            for line in lines[1:]:
                first, *rest = line.split(" ")
                parts.append(b"".join([self.starts[first], *map(self.words.__getitem__, rest)]))
            return newline.join(parts)
        text = self.prepared(text)
        if self.cuts_at_space and self.v.byte_fallback:
            return b"".join(map(self.starts.__getitem__, re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", text)))
        return self._ids(text)

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        if self.v.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "each_byte")


#: A byte that is no part of a character becomes one U+FFFD.
codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def load(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary.parse(f.read())


def _start(vocabulary, work):
    token = common.token()

    def start():
        codec = common.per_worker("sentencepiece", token, lambda: Codec(vocabulary.value))
        return lambda batch: work(codec, batch)

    return start


def encode(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int; null for a null text)."""
    known = df.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary file, a few MB at most
    kind = df.schema[key].dataType.simpleString()

    def work(codec, batch):
        ids = [None if t is None else np.frombuffer(codec.encode(t), "<i4") for t in batch.column(1).to_pylist()]
        return {"key": batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))}

    return common.arrow_map(df.select(df[key].alias("key"), df[text].alias("text")), f"key {kind}, ids array<int>", _start(known, work)).withColumnRenamed("key", key)


def decode(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text (null for null ids). Bytes that form no character become U+FFFD each."""
    known = df.sparkSession.sparkContext.broadcast(vocabulary)
    kind = df.schema[key].dataType.simpleString()

    def work(codec, batch):
        texts = [None if x is None else codec.decode(np.array(x, "<i4").tobytes()) for x in batch.column(1).to_pylist()]
        return {"key": batch.column(0), "text": pa.array(texts, pa.string())}

    return common.arrow_map(df.select(df[key].alias("key"), df[ids].alias("ids")), f"key {kind}, text string", _start(known, work)).withColumnRenamed("key", key)


def digest(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """encode() and decode() of each text: key, n_ids, ids_crc32 (unsigned, of little-endian 32-bit ids), round_trip.

    One pass, so that ids needn't travel between two workers. Null texts give nulls.
    """
    known = df.sparkSession.sparkContext.broadcast(vocabulary)
    kind = df.schema[key].dataType.simpleString()

    def work(codec, batch):
        n, crc, same = [], [], []
        for t in batch.column(1).to_pylist():
            ids = None if t is None else codec.encode(t)
            n.append(None if t is None else len(ids) // 4)
            crc.append(None if t is None else zlib.crc32(ids))
            same.append(None if t is None else codec.decode(ids) == t)
        return {"key": batch.column(0), "n_ids": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "round_trip": pa.array(same, pa.bool_())}

    return common.arrow_map(df.select(df[key].alias("key"), df[text].alias("text")), f"key {kind}, n_ids long, ids_crc32 long, round_trip boolean", _start(known, work)).withColumnRenamed("key", key)
