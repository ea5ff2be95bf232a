"""Hierarchical packing of documents into sequences of several context sizes.

Each document's ids go to tiers: whole windows of the largest size first, the rest to the smallest tier that holds it. A
tier's windows are filled from its own documents, the longest first; what is left of a window is filled from shorter tiers
with the longest that fits, and at last with a piece cut to measure. So windows are full but for the last of a task, whose
pieces are cut into windows of ever smaller powers of two.

Windows of one size stand in step groups of STEP_TOKENS tokens each, and so of equal work, over all tasks: the windows of a
task and size are numbered on from those of the tasks before. Only the last group of each size may hold fewer.

Packing happens where a partition's documents are read, batch by batch: no text or id is shuffled, and only documents that
wait for a window are kept. Sequence ids hold the partition's number, so a task that is run again gives the same ids.

Null and empty texts have the end id only, very long ones are cut over as many windows as it takes. Repeated rows are packed
each for itself; of pieces of one length the earlier goes first. An empty table gives an empty one. Other columns of the table
aren't read.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from . import common

TIERS = (2048, 1024, 512, 256)
END = 1
#: Tokens of a step group.
STEP_TOKENS = 64 * 2048

# a document's piece that waits: length, running number (ties go to the earlier), ids, start, id, ids of the document
Piece = tuple[int, int, bytes, int, object, int]


# fixed value: the division into words, of letters, single digits and marks, that the fast way below knows
_DIVISION = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A run of these behind letters is one word of its own.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of texts that are looked up together.
TOGETHER = 8_000_000
#: Pairs of tasks and sizes up to which their first numbers are broadcast.
FEW = 100_000


class Tokens:
    """Ids by the tokenizer file; a word's ids are looked up once.

    Words between white space can be encoded apart if the file divides texts as _DIVISION does. Then a batch's texts are split
    and made distinct in Arrow, new words are encoded, and the batch's ids are gathered from those of its words. Where the
    file lowers letters, texts in Latin-1 are lowered before. Letters with marks behind them are encoded as two words by the
    file's model itself. Any other file, or a text with separators that only Python takes for white space, is encoded whole.
    """

    def __init__(self, file: bytes, end: int = END, limit: int = common.MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(file)
        self.limit, self.end = limit, end
        config = json.loads(file)
        self.apart, self.lowers = self._reads(config)
        self.added = {t["content"][:2].lower() for t in config.get("added_tokens") or []}
        from tokenizers.pre_tokenizers import ByteLevel

        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xAA, 0x100)}  # Latin-1 letters in the model's alphabet
        self.model = self.tokenizer.model
        self.stems: dict[str, bytes] = {}
        self._clear()

    @staticmethod
    def _reads(config: dict) -> tuple[bool, bool]:
        """Can words be encoded apart, and are letters lowered?"""

        def flat(part, name):
            return [] if part is None else part[name] if part["type"] == "Sequence" else [part]

        model, normal, division = config["model"], flat(config["normalizer"], "normalizers"), flat(config["pre_tokenizer"], "pretokenizers")
        lowers = any(n["type"] == "Lowercase" for n in normal)
        plain = all(n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " ") for n in normal)
        split = (
            len(division) == 2 and division[0]["type"] == "Split" and division[0]["pattern"] == {"Regex": _DIVISION} and division[0]["behavior"] == "Removed" and division[0]["invert"]
            and division[1]["type"] == "ByteLevel" and not division[1]["add_prefix_space"] and not division[1].get("use_regex", True)
        )
        bpe = model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("ignore_merges")
        added = all(
            not t["content"][0].isalnum() and len(t["content"]) > 1 and any(c.isalpha() for c in t["content"]) and not any(c.isspace() for c in t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])
            for t in config.get("added_tokens") or []
        )
        return plain and split and bpe and added, lowers

    def _clear(self) -> None:
        # entries: none, the end id, then words; each a stretch of one array
        self.numbers: dict[str, int] = {"": 0}
        self.ids = np.array([self.end], np.uint32)
        self.starts, self.sizes = np.array([0, 0], np.int64), np.array([0, 1], np.int64)

    def _stem(self, letters: str) -> bytes:
        found = self.stems.get(letters)
        if found is None:
            own = letters if letters.isascii() else letters.translate(self.letters)
            found = self.stems[letters] = np.array([t.id for t in self.model.tokenize(own)], np.uint32).tobytes()
        return found

    def _learn(self, words: list[str]) -> None:
        """Entries for new words."""
        found, odd = [], []
        for word in words:
            letters = word.rstrip(MARKS)
            if letters.isalpha() and (letters.isascii() or max(letters) < "\u0100"):
                low = letters.lower() if self.lowers else letters
                found.append(self._stem(low) if len(letters) == len(word) else self._stem(low) + self._stem(word[len(letters) :]))
            else:
                odd.append(len(found))
                found.append(b"")
        for at in range(0, len(odd), 2048):
            part = odd[at : at + 2048]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([words[i] for i in part], add_special_tokens=False)):
                found[i] = np.array(e.ids, np.uint32).tobytes()
        first = len(self.starts)
        self.numbers.update(zip(words, range(first, first + len(words))))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), np.uint32)])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array([*e.ids, self.end], np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _looked_up(self, texts: pa.Array) -> list[bytes]:
        if len(self.numbers) > self.limit:
            self._clear()
        if len(self.stems) > self.limit:
            self.stems.clear()
        odd = pc.match_substring_regex(texts, "[\x1c-\x1f]").to_numpy(zero_copy_only=False)  # no white space to the file
        if self.lowers:
            keep = pc.match_substring_regex(texts, "[^\\x{0}-\\x{ff}]")
            for name in self.added:  # case counts in the names of added tokens
                keep = pc.or_(keep, pc.match_substring(texts, name, ignore_case=True))
            texts = pc.if_else(keep, texts, pc.utf8_lower(texts))
        split = pc.utf8_split_whitespace(texts)
        ends = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn([w for w in words if w not in self.numbers])
        numbers = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        # this batch's entries side by side, the end id first; positions in a batch fit in 32 bits
        numbers = np.concatenate(([1], numbers))
        sizes, starts = self.sizes[numbers], self.starts[numbers]
        first = np.cumsum(sizes) - sizes
        own = self.ids[np.repeat(starts - first, sizes) + np.arange(int(sizes.sum()))]
        sizes, first = sizes.astype(np.int32), first.astype(np.int32)
        entries = np.insert(coded.indices.to_numpy() + np.int32(1), ends[1:] - ends[0], 0)
        lengths = sizes[entries]
        after = np.cumsum(lengths, dtype=np.int64 if lengths.sum(dtype=np.int64) >> 31 else np.int32)
        data = own[np.repeat(first[entries] - (after - lengths), lengths) + np.arange(len(after) and after[-1], dtype=after.dtype)].tobytes()
        bounds = [0, *(4 * after[ends[1:] - ends[0] + np.arange(len(ends) - 1)].astype(np.int64)).tolist()]
        out = [data[a:b] for a, b in zip(bounds, bounds[1:])]
        if odd.any():
            at = np.flatnonzero(odd).tolist()
            for i, ids in zip(at, self._whole([texts[i].as_py() for i in at])):
                out[i] = ids
        return out

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text as bytes, the end id last; null texts are empty."""
        texts = pc.fill_null(texts, "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TOGETHER, "right")))
            part = texts.slice(at, to - at)
            yield from self._looked_up(part) if self.apart else self._whole(part.to_pylist())
            at = to


class Packer:
    """Takes documents, gives windows: (tier, [(piece, length, offset)])."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.waiting: list[Piece] = []  # sorted by length
        self.number = 0

    def add(self, ids: bytes, key) -> Iterator[tuple[int, list]]:
        total, top, start = len(ids) // 4, self.tiers[0], 0
        while total - start >= top:
            piece = (top, self.number, ids, start, key, total)
            yield top, [(piece, top, 0)]
            start += top
        if start < total:
            insort(self.waiting, (total - start, self.number, ids, start, key, total), key=lambda p: p[:2])
        self.number += 1

    def _tier(self, length: int) -> int:
        return next(t for t in reversed(self.tiers) if t >= length)

    def windows(self, last: bool) -> Iterator[tuple[int, list]]:
        """Full windows of what waits; at the end, all of it."""
        waiting = self.waiting
        stock = sum(p[0] for p in waiting)
        while waiting:
            size = self._tier(waiting[-1][0])
            if stock < size:
                if not last:
                    return
                size = 1 << (stock.bit_length() - 1)  # the rest: ever smaller powers of two
            parts, room = [], size
            while room:
                at = bisect_right(waiting, room, key=lambda p: p[0]) - 1
                if at >= 0:
                    piece = waiting.pop(at)
                    take = piece[0]
                else:  # none fits: cut the shortest
                    piece = waiting.pop(0)
                    take = room
                    insort(waiting, (piece[0] - take, piece[1], piece[2], piece[3] + take, piece[4], piece[5]), key=lambda p: p[:2])
                parts.append((piece, take, size - room))
                room -= take
            stock -= size
            yield size, parts


def pack(df: DataFrame, file: bytes, key: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, words: int = common.MEMO_WORDS) -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the window's size), step_group."""
    spark = df.sparkSession
    known = spark.sparkContext.broadcast(file)  # the tokenizer file, a few MB
    field = df.schema[key].dataType
    token = common.token()
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer, base = common.per_worker("packing", token, lambda: Tokens(known.value, limit=words)), Packer(tiers), TaskContext.get().partitionId() << 33
        made: dict[int, int] = {}
        count = 0
        kind = pa.int64()

        def rows(windows) -> pa.RecordBatch:
            nonlocal count
            keys, columns, sizes, numbers = [], [[] for _ in names], [], []
            for size, parts in windows:
                n = made[size] = made.get(size, -1) + 1
                for piece, take, offset in parts:
                    _, _, ids, start, name, total = piece
                    keys.append(name)
                    for column, value in zip(columns, (start, take, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + take)]), total, base + count, offset)):
                        column.append(value)
                    sizes.append(size)
                    numbers.append(n)
                count += 1
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), *(pa.array(c, pa.int64()) for c in columns), pa.array(sizes, pa.int32()), pa.array([base >> 33] * len(keys), pa.int32()), pa.array(numbers, pa.int64())], ["key", *names, "tier", "part", "number"])

        for batch in batches:
            kind = batch.schema.field(0).type
            keys = batch.column(0).to_pylist()

            def windows():
                for k, ids in zip(keys, tokens(batch.column(1))):
                    yield from packer.add(ids, k)
                yield from packer.windows(last=False)

            yield rows(windows())
        yield rows(packer.windows(last=True))

    schema = f"key {field.simpleString()}, " + ", ".join(f"{n} long" for n in names) + ", tier int, part int, number long"
    made = common.cut(df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, schema))
    # how many windows of a size the tasks before have: a row for each task and size
    before = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = made.groupBy("part", "tier").agg((F.max("number") + 1).alias("n")).select("part", "tier", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    first = common.cut(first)
    first = F.broadcast(first) if first.count() <= FEW else first
    group = F.concat_ws("-", "tier", F.floor((F.col("first") + F.col("number")) * F.col("tier") / step_tokens))
    return made.join(first, ["part", "tier"]).select(F.col("key").alias(key), *names, "tier", group.alias("step_group"))
