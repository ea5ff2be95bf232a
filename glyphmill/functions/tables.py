"""Table functions in SQL: pre_tokenize(text) and tokens(text), for use with LATERAL.

Both are SQL functions that return a table. Their bodies are generators over built-in functions, which Spark puts into the query in place of the
call: SELECT d.doc_id, t.* FROM documents d, LATERAL tokens(d.text) t scans, generates and nothing else; no shuffle, no Python.
tokens() looks words up in two constants of the plan, words by hash and their ids, where a word has two places; so it takes a
vocabulary of at most WORDS, as every task gets it.

Null and empty texts have no rows. Words that aren't in the vocabulary have the unknown token's id.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, SparkSession, functions as F

from ..operators.stages import BYTE_PATTERN
from ..operators.tokenizer import Spec
from . import expr
from .dialect import to_java
from .pipeline import Unsupported

#: Words of a vocabulary at most, places for each, and moves before the table is made larger.
WORDS, PLACES, MOVES = 1 << 14, 4, 200


def _quoted(text: str) -> str:
    """A SQL literal; backslashes escape within it."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pieces(spec: Spec, text: str) -> str:
    """SQL of the pieces of a text."""
    pre = spec.pre_tokenizer or {}
    kind = pre.get("type")
    patterns = {
        None: "(?s:.)+", "Whitespace": rf"[{expr.WORD}]+|(?U:[^\s{expr.WORD}])+", "WhitespaceSplit": r"[^ \t\n\r]+", "Punctuation": r"\p{P}|\P{P}+", "Digits": "[0-9]|[^0-9]+" if pre.get("individual_digits") else "[0-9]+|[^0-9]+",
        "BertPreTokenizer": r"[!-/:-@\[-\x60{-~\p{P}]|(?U:[^\s!-/:-@\[-\x60{-~\p{P}])+", "ByteLevel": to_java(BYTE_PATTERN) if not pre.get("add_prefix_space", True) else None,
    }
    if not patterns.get(kind) or spec.added:
        raise Unsupported(f"no table function for the pre-tokenizer {kind}" if not spec.added else "no table function with added tokens")
    steps = {None: "{}", "Lowercase": "array_join(transform(split({}, 'Σ', -1), x -> lower(x)), 'σ')", "StripAccents": "regexp_replace({}, '\\\\p{{Mn}}', '')"}
    normal = (spec.normalizer or {}).get("type")
    if normal not in steps:
        raise Unsupported(f"no table function for the normalizer {normal}")
    return f"regexp_extract_all({steps[normal].format(text)}, {_quoted(patterns[kind])}, 0)"


def _places(word: Column, size: int) -> list[Column]:
    return [F.pmod(F.xxhash64(word), F.lit(size)).cast("int").alias("first"), F.pmod(F.hash(word), F.lit(size)).cast("int").alias("second")]


def placed(words: list[tuple[int, int]], size: int) -> list[int | None] | None:
    """Which word is at each place, given each one's two: one that finds its place taken moves the other on. None if that doesn't end."""
    table: list[int | None] = [None] * size
    for k, (at, _) in enumerate(words):
        now: int | None = k
        for _ in range(MOVES):
            now, table[at] = table[at], now
            if now is None:
                break
            first, second = words[now]
            at = second if at == first else first
        else:
            return None
    return table


def _lookup(spark: SparkSession, spec: Spec, word: str) -> str:
    """SQL of a word's id."""
    vocab, unknown = spec.model["vocab"], spec.model.get("unk_token", "[UNK]")
    if spec.model.get("type") != "WordLevel" or len(vocab) > WORDS or unknown not in vocab:
        raise Unsupported(f"tokens() needs a WordLevel model of at most {WORDS} words with an unknown token")
    names, size = list(vocab), PLACES * max(1, len(vocab))
    df = spark.createDataFrame([(k, w) for k, w in enumerate(names)], "k int, word string")
    while True:
        table = placed([(r["first"], r["second"]) for r in df.select("k", *_places(F.col("word"), size)).orderBy("k").collect()], size)
        if table is not None:
            break
        size = size * 3 // 2 + 1
    words = _quoted(json.dumps([None if k is None else names[k] for k in table], ensure_ascii=False))
    ids = _quoted(json.dumps([None if k is None else vocab[names[k]] for k in table]))
    ways = [f"WHEN get(from_json({words}, 'array<string>'), {at}) = {word} THEN get(from_json({ids}, 'array<int>'), {at})" for at in (f"cast(pmod(xxhash64({word}), {size}) AS int)", f"cast(pmod(hash({word}), {size}) AS int)")]
    return f"CASE {' '.join(ways)} ELSE {int(vocab[unknown])} END"


def register(spark: SparkSession, spec: Spec, prefix: str = "") -> None:
    """<prefix>pre_tokenize(text): table of word, piece; for WordLevel models also <prefix>tokens(text): table of word, token, id."""
    name = f"{prefix}pre_tokenize"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS TABLE(word INT, piece STRING) RETURN SELECT pos, col FROM posexplode({_pieces(spec, f'{name}.text')})")
    if spec.model.get("type") == "WordLevel":
        name = f"{prefix}tokens"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS TABLE(word INT, token STRING, id INT) RETURN SELECT pos, col, {_lookup(spark, spec, 'col')} FROM posexplode({_pieces(spec, f'{name}.text')})")
