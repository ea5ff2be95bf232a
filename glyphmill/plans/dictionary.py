"""Encoding of a corpus by a dictionary of its words: texts are cut in the JVM, and the model sees words, not texts.

words() counts the pieces of a corpus (partial counts before the shuffle) and runs the model once for each of the most frequent
ones. encode() cuts texts into pieces with an expression, one row each, and joins these with the dictionary, which has at most WORDS rows
of at most LONGEST characters and is broadcast: pieces stay where they are and in their order, however frequent one is, and nothing is
shuffled or sorted. So Python gets a text's ids piece by piece and hands them on as one array; a piece that the dictionary lacks comes as a
word. By Zipf's law these are few; each worker runs the model once for those that it remembers.

Any dictionary fits any corpus: words that it doesn't hold cost more, they don't change what comes out. Null texts have null ids,
empty ones none. Repeated keys and rows are encoded each for itself, as many rows come out as went in. Of a text only its ids are held
at a time. Ties in frequency go by the word. Empty tables give empty ones.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import expr, pipeline
from ..operators import stages
from ..operators.tokenizer import Spec, Tokenizer

#: Words of a dictionary and characters of a word, at most: what is broadcast.
WORDS, LONGEST = 1 << 16, 64
#: Words that a worker remembers, of at most LONGEST characters.
REMEMBERED = 1 << 16
_IDS = pa.list_(pa.int32())
#: What a Python worker keeps from task to task: the latest spec's ids of words.
_KEPT: dict[str, "_Words"] = {}


class _Words(dict):
    """word -> ids, by the model, once."""

    def __init__(self, spec: Spec, mapped: bool):
        super().__init__()
        self.model, self.mapped = Tokenizer(spec).model, mapped

    def __missing__(self, word: str) -> list[int]:
        found = [t[0] for t in self.model.tokenize(stages.byte_level(word) if self.mapped else word)]
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


class _Model:
    """A spec's model, for tasks; known by a token, so that a worker builds it once."""

    def __init__(self, df: DataFrame, spec: Spec):
        if spec.added:
            raise pipeline.Unsupported("added tokens are found before words")
        self.cut, self.mapped = pipeline.pieces(spec.normalizer, spec.pre_tokenizer)
        self.spec, self.token = df.sparkSession.sparkContext.broadcast(spec), uuid.uuid4().hex

    def __getstate__(self):
        return {"spec": self.spec, "mapped": self.mapped, "token": self.token}

    def words(self) -> _Words:
        if self.token not in _KEPT:
            _KEPT.clear()
            _KEPT[self.token] = _Words(self.spec.value, self.mapped)
        return _KEPT[self.token]


def words(df: DataFrame, spec: Spec, text: str = "text", most: int = WORDS) -> DataFrame:
    """word, n, ids of the most frequent pieces of a column of texts."""
    model = _Model(df, spec)
    counts = df.select(F.explode(model.cut(F.col(text))).alias("word")).where(F.char_length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.words()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([known[w] for w in batch.column("word").to_pylist()], _IDS)], ["word", "n", "ids"])

    # the few rows that are left are dealt out again, for as many models at once
    return top.repartition(df.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "word string, n long, ids array<int>")


def _encoded(df: DataFrame, spec: Spec, key: Sequence[str], text: str, dictionary: DataFrame | None, of: Column, out: str, kind: str) -> DataFrame:
    """A row for each row of df: its key, and as out the ids of all its pieces, or their number. of: what a piece has of the dictionary."""
    model = _Model(df, spec)
    known = F.broadcast((words(df, spec, text) if dictionary is None else dictionary).select(F.col("word").alias("__word"), of.alias("__has")))
    keys = [f"__key{k}" for k in range(len(key))]
    rows = df.select(*(F.col(k).alias(a) for k, a in zip(key, keys)), F.col(text).isNull().alias("__none"), F.col(text).alias("__text"))
    pieces = rows.select(*keys, "__none", F.posexplode_outer(model.cut(F.col("__text"))).alias("__at", "__word")).join(known, "__word", "left")
    # the pieces of a row follow one another: its key goes with the first, and words only where the dictionary lacks them
    first = F.coalesce(F.col("__at") == 0, F.lit(True))
    sent = pieces.select(*(F.when(first, F.col(k)).alias(k) for k in keys), first.alias("__first"), "__none", "__has", F.when(F.col("__has").isNull(), F.col("__word")).alias("__word"))
    fields = [T.StructField(k, sent.schema[a].dataType) for k, a in zip(key, keys)]
    n, counted = len(keys), kind == "int"

    def values(batch: pa.RecordBatch) -> tuple[pa.Array | None, np.ndarray]:
        """The ids of all pieces one after another (not if they are only counted), and where each piece's end."""
        has, word = batch.column(n + 2), batch.column(n + 3)
        lacking = np.flatnonzero(word.is_valid().to_numpy(zero_copy_only=False))
        if len(lacking):
            remembered, coded = model.words(), word.take(pa.array(lacking)).dictionary_encode()
            made = [remembered[w] for w in coded.dictionary.to_pylist()]
            own = pa.array([len(ids) for ids in made], pa.int32()) if counted else pa.array(made, _IDS)
            at = np.arange(len(has))
            at[lacking] = len(has) + coded.indices.to_numpy()
            has = pa.concat_arrays([has.cast(own.type), own]).take(pa.array(at))
        sizes = (has if counted else has.value_lengths()).fill_null(0).to_numpy()
        return None if counted else has.flatten(), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] | None = None  # keys, and whether it is null, of a row that may go on in the next batch
        parts: list = []

        def rows_of(head: list[pa.Array], ids: pa.Array | None, ends: np.ndarray) -> pa.RecordBatch:
            none = head[n].to_numpy(zero_copy_only=False)
            found = pa.array(np.diff(ends), pa.int32(), mask=none) if counted else pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), ids, mask=pa.array(none))
            return pa.RecordBatch.from_arrays([*head[:n], found], [*key, out])

        def finished() -> pa.RecordBatch:
            ids = None if counted else pa.concat_arrays(parts)
            return rows_of(held, ids, np.array([0, sum(parts) if counted else len(ids)]))

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, ends = values(batch)
            span = lambda a, b: int(b - a) if counted else ids.slice(a, b - a)  # noqa: B023, E731
            starts = np.flatnonzero(batch.column(n).to_numpy(zero_copy_only=False))
            cuts = ends[starts]
            if held is not None:
                parts.append(span(0, cuts[0] if len(starts) else ends[-1]))
            if not len(starts):
                continue
            if held is not None:
                yield finished()
            heads = batch.take(pa.array(starts))
            heads = [heads.column(i) for i in (*range(n), n + 1)]
            if len(starts) > 1:
                yield rows_of([c.slice(0, len(starts) - 1) for c in heads], None if counted else span(cuts[0], cuts[-1]), cuts)
            held, parts = [c.slice(len(starts) - 1) for c in heads], [span(cuts[-1], ends[-1])]
        if held is not None:
            yield finished()

    return sent.mapInArrow(run, T.StructType([*fields, T.StructField(out, T._parse_datatype_string(kind))]))


def encode(df: DataFrame, spec: Spec, key: Sequence[str], text: str = "text", dictionary: DataFrame | None = None, out: str = "ids") -> DataFrame:
    """The key columns and the ids of each text, by a dictionary (that of df, if none is given)."""
    return _encoded(df, spec, key, text, dictionary, F.col("ids"), out, "array<int>")


def count(df: DataFrame, spec: Spec, key: Sequence[str], text: str = "text", dictionary: DataFrame | None = None, out: str = "n_tokens") -> DataFrame:
    """The key columns and the number of tokens of each text; only numbers travel with the pieces."""
    return _encoded(df, spec, key, text, dictionary, F.size("ids"), out, "int")


def tokens(spec: Spec, ids: Column) -> Column:
    """The tokens of ids, those of the model and added ones; null for what is no id."""
    t = Tokenizer(spec)
    known = {**t.model.tokens, **t.back}
    table = F.from_json(F.lit(json.dumps([known.get(i) for i in range(max(known, default=-1) + 1)], ensure_ascii=False)), "array<string>")
    return F.transform(ids, lambda i: F.get(table, i))


def decode(spec: Spec, ids: Column, skip_special: bool = True) -> Column:
    """The text of ids, by expressions: tokens from a constant table by position, then the decoder.

    Unknown ids are left out. Byte-level tokens must be of the byte alphabet throughout.
    """
    special = [a.content for a in spec.added if a.special] if skip_special else []
    found = F.filter(tokens(spec, ids), lambda t: t.isNotNull() & ~t.isin(special) if special else t.isNotNull())
    kind = spec.decoder["type"] if spec.decoder else None
    if kind is None:
        return F.array_join(found, " ")
    if kind == "ByteLevel":
        t = Tokenizer(spec)
        if any(c not in stages.CHAR_BYTES for token in {**t.model.ids, **t.added} for c in token):
            raise pipeline.Unsupported("a byte-level decoder with tokens outside the byte alphabet")
        return expr.byte_level_back(F.array_join(found, ""))
    simple = {
        "WordPiece": lambda: expr.decode_wordpiece(found, spec.decoder.get("prefix", "##")), "BPEDecoder": lambda: expr.decode_bpe(found, spec.decoder.get("suffix", "</w>")), "Fuse": lambda: F.array_join(found, ""),
        "Metaspace": lambda: expr.decode_metaspace(found, spec.decoder.get("replacement", "▁")), "CTC": lambda: expr.decode_ctc(found, spec.decoder.get("pad_token", "<pad>"), spec.decoder.get("word_delimiter_token", "|")),
        "ByteFallback": lambda: expr.decode_byte_fallback(found),
    }
    if kind not in simple:
        raise pipeline.Unsupported(f"no expression for the decoder {kind}")
    return simple[kind]()
