"""Pipelines over DataFrames: text columns to encodings and back, in one pass without a shuffle.

Kernels run in Arrow batches with the spec broadcast, over portions of bounded bytes. Workers keep a query's tokenizer, with the words that it
remembers, from task to task. Where only token frequencies or
counts are asked for, token_frequencies() runs the model once for each distinct word (plans.words).
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from ..functions import templates
from . import places, stages
from .tokenizer import Encoding, Spec, Tokenizer

if TYPE_CHECKING:
    from ..sources.spec import Config

_SPAN = "struct<start:int,end:int>"
ENCODING = f"struct<ids:array<int>,type_ids:array<int>,tokens:array<string>,words:array<int>,offsets:array<{_SPAN}>,special_tokens_mask:array<int>,attention_mask:array<int>,sequence_ranges:map<int,{_SPAN}>>"
_ARROW_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def _row(e: Encoding) -> dict:
    span = lambda s: {"start": s[0], "end": s[1]}
    return {"ids": e.ids, "type_ids": e.type_ids, "tokens": e.tokens, "words": e.words, "offsets": [span(s) for s in e.offsets], "special_tokens_mask": e.special_tokens_mask, "attention_mask": e.attention_mask, "sequence_ranges": [(k, span(s)) for k, s in e.sequence_ranges.items()]}


_INTS = pa.list_(pa.int32())
_ARROW = pa.struct([("ids", _INTS), ("type_ids", _INTS), ("tokens", pa.list_(pa.string())), ("words", _INTS), ("offsets", pa.list_(_ARROW_SPAN)), ("special_tokens_mask", _INTS), ("attention_mask", _INTS), ("sequence_ranges", pa.map_(pa.int32(), _ARROW_SPAN))])


#: Bytes of texts and the rows that are worked on, and handed on, at a time.
PORTION = 4 << 20
#: Rows at most, as what is made of short texts is many times as large.
ROWS = 1 << 11
#: Workers keep what they have built for the latest query.
_KEPT: dict[str, Callable] = {}
#: The column of an error message beside a permissive result, and the name under which errors are counted.
ERRORS = "errors"


def _portions(batch: pa.RecordBatch, at: list[int]) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about PORTION bytes in the columns read, so that rows of long texts don't pile up."""
    if not batch.num_rows:
        return
    rows = min(ROWS, max(1, batch.num_rows * PORTION // max(PORTION, sum(batch.column(i).nbytes for i in at))))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _added_column(df: DataFrame, name: str, kind: str, arrow: pa.DataType, inputs: list[str], make: Callable[[], Callable], permissive: bool = False, array: Callable[[list], pa.Array] | None = None) -> DataFrame:
    """df with one more column, made of the inputs row by row; null if an input is null.

    Errors of a row end the task, or, if permissive, make its value struct<value, error>: null and the message. A bad value is then one row's
    affair; how many there are can be observed while the query runs (observed()). array makes a column of values other than Arrow's own.
    """
    df = df.drop(name)
    at = [df.columns.index(i) for i in inputs]
    if permissive:
        kind, arrow = f"struct<value:{kind},error:string>", pa.struct([("value", arrow), ("error", pa.string())])
    schema = T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _KEPT:
            _KEPT.clear()
            _KEPT[token] = make()
        f = _KEPT[token]

        def one(*row):
            if not permissive:
                return f(*row)
            try:
                return {"value": f(*row), "error": None}
            except ValueError as e:  # of specs, templates and patterns
                return {"value": None, "error": str(e)}

        for batch in batches:
            for part in _portions(batch, at):
                values = [None if any(v is None for v in row) else one(*row) for row in zip(*(part.column(i).to_pylist() for i in at))]
                yield pa.RecordBatch.from_arrays([*part.columns, array(values) if array else pa.array(values, arrow)], [*part.schema.names, name])

    return df.mapInArrow(run, schema)


def _pieces(values: list[places.Pieces | None]) -> pa.Array:
    """Lists of pieces, made column by column; values may be null."""
    known = [v for v in values if v is not None]
    empty = [np.zeros(0, np.int32)]
    flat = pa.StructArray.from_arrays([pa.array([t for v in known for t in v[0]], pa.string()), *(pa.array(np.concatenate([v[i] for v in known] or empty), pa.int32()) for i in (1, 2))], ["text", "start", "end"])
    ends = np.cumsum([0, *(0 if v is None else len(v[0]) for v in values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array([v is None for v in values], pa.bool_()))


def observed(df: DataFrame, column: str) -> tuple[DataFrame, Observation]:
    """df, and what a permissive column of it says once a query over it has run: rows, and errors among them."""
    counts = Observation(f"{column} {ERRORS}")
    return df.observe(counts, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(column)["error"].isNotNull()).alias(ERRORS)), counts


class TextPipeline:
    """A spec bound to DataFrames.

    errors: "fail" ends the query at a row that can't be encoded (a character that the model doesn't know, and no unknown token);
    "permissive" makes encodings, ids and counts struct<value, error>.
    """

    def __init__(self, spec: Spec, errors: str = "fail"):
        if errors not in ("fail", "permissive"):
            raise ValueError(f"errors must be fail or permissive, not {errors!r}")
        self.spec, self.permissive = spec, errors == "permissive"

    def encode(self, df: DataFrame, text: str = "text", out: str = "encoding", add_special: bool = True, pair: str | None = None) -> DataFrame:
        known = df.sparkSession.sparkContext.broadcast(self.spec)

        def make():
            t = Tokenizer(known.value)
            return (lambda a, b: _row(t.encode_pair(a, b, add_special))) if pair else (lambda a: _row(t.encode(a, add_special)))

        return _added_column(df, out, ENCODING, _ARROW, [text, pair] if pair else [text], make, self.permissive)

    def encode_chat(self, df: DataFrame, config: Config, messages: str = "messages", out: str = "encoding", name: str = "default", add_generation_prompt: bool = True, add_special: bool = True, args: dict | None = None) -> DataFrame:
        """Encodings of what a named template of the configuration makes of messages."""
        prompts = templates.apply_chat(df, config.templates[name], messages, "__prompt", add_generation_prompt, config.bos or "", config.eos or "", args)
        return self.encode(prompts, "__prompt", out, add_special).drop("__prompt")

    def ids(self, df: DataFrame, text: str = "text", out: str = "ids") -> DataFrame:
        known = df.sparkSession.sparkContext.broadcast(self.spec)
        return _added_column(df, out, "array<int>", _INTS, [text], lambda: Tokenizer(known.value).ids, self.permissive)

    def corpus_ids(self, df: DataFrame, key: Sequence[str], text: str = "text", out: str = "ids") -> DataFrame:
        """The key columns and ids of a large table, by a dictionary of its words (plans.dictionary); for specs that are expressions."""
        from ..plans import dictionary

        return dictionary.encode(df, self.spec, key, text, out=out)

    def count_tokens(self, df: DataFrame, text: str = "text", out: str = "n_tokens") -> DataFrame:
        known = df.sparkSession.sparkContext.broadcast(self.spec)

        def make():
            t = Tokenizer(known.value)
            return lambda x: len(t.ids(x))

        return _added_column(df, out, "int", pa.int32(), [text], make, self.permissive)

    def decode(self, df: DataFrame, ids: str = "ids", out: str = "text", skip_special: bool = True) -> DataFrame:
        known = df.sparkSession.sparkContext.broadcast(self.spec)

        def make():
            t = Tokenizer(known.value)
            return lambda x: t.decode(x, skip_special)

        return _added_column(df, out, "string", pa.string(), [ids], make)

    def normalize(self, df: DataFrame, text: str = "text", out: str = "normalized") -> DataFrame:
        known = df.sparkSession.sparkContext.broadcast(self.spec)

        return _added_column(df, out, "string", pa.string(), [text], lambda: stages.text_normalizer(known.value.normalizer))

    def pre_tokenize(self, df: DataFrame, text: str = "text", out: str = "pieces") -> DataFrame:
        """Pieces with byte offsets in the original."""
        known = df.sparkSession.sparkContext.broadcast(self.spec)

        def make():
            spec, t = known.value, Tokenizer(known.value)
            whole = places.pieces(spec.normalizer, spec.pre_tokenizer)

            def one(text):
                if whole:
                    with contextlib.suppress(places.EmptyMatch):
                        return whole(text)
                found = t.pieces(text)
                return [p.text for p in found], np.array([p.spans[0][0] for p in found], np.int32), np.array([p.spans[-1][1] for p in found], np.int32)

            return one

        kind = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return _added_column(df, out, "array<struct<text:string,start:int,end:int>>", kind, [text], make, array=_pieces)

    def token_frequencies(self, df: DataFrame, text: str = "text") -> DataFrame:
        """id, token, n over all texts: pieces are counted first, and the model runs once for each distinct piece.

        Pieces are words where the pre-tokenizer drops white space, else whole texts, so that what stands around a word counts.
        """
        word = F.col(text)
        if (self.spec.pre_tokenizer or {}).get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") and not self.spec.added:
            word = F.explode(F.split(word, r"(?U)\s+"))
        words = df.select(word.alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
        tokens = TextPipeline(self.spec).encode(words, "word", "e", add_special=False).select("n", F.explode(F.arrays_zip("e.ids", "e.tokens")).alias("t"))
        return tokens.groupBy(F.col("t.ids").alias("id"), F.col("t.tokens").alias("token")).agg(F.sum("n").alias("n"))

    def register_sql(self, spark: SparkSession, prefix: str = "") -> None:
        """SQL functions <prefix>encode_ids(text), <prefix>count_tokens(text), <prefix>decode(ids)."""
        spec = self.spec
        cache: list[Tokenizer] = []

        def tokenizer() -> Tokenizer:
            if not cache:
                cache.append(Tokenizer(spec))
            return cache[0]


        @F.pandas_udf("array<int>")
        def encode_ids(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None else tokenizer().ids(x))

        @F.pandas_udf("int")
        def count_tokens(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None else len(tokenizer().ids(x)))

        @F.pandas_udf("string")
        def decode(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None else tokenizer().decode([int(i) for i in x]))

        for name, f in (("encode_ids", encode_ids), ("count_tokens", count_tokens), ("decode", decode)):
            spark.udf.register(prefix + name, f)
