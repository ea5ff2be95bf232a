"""Pieces and offsets by expressions against the kernels."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import alignment
from glyphmill.functions.pipeline import Unsupported
from glyphmill.operators.tokenizer import Spec, Tokenizer

RNG = random.Random(8)
CHARS = [*"abthTH  \t\n.,!_12", "é", "É", "ß", "中", "😀", "\u0301", "\xa0", "İ", "Σ", "\x07"]
TEXTS = [None, "", " ", "th", "  the  ", *("".join(RNG.choices(CHARS, k=RNG.randint(1, 40))) for _ in range(250)), "the é " * 2000]
REPLACED = [{"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Replace", "pattern": {"String": "th"}, "content": "þþ"}, {"type": "Replace", "pattern": {"String": "."}, "content": ""}]
CASES = [
    (None, None), (None, {"type": "WhitespaceSplit"}), ({"type": "Lowercase"}, {"type": "Whitespace"}), ({"type": "StripAccents"}, {"type": "BertPreTokenizer"}), ({"type": "Nmt"}, {"type": "Digits"}), ({"type": "Strip"}, {"type": "Punctuation"}),
    ({"type": "Strip", "strip_left": False}, {"type": "ByteLevel", "add_prefix_space": False}), ({"type": "Prepend", "prepend": "é▁"}, {"type": "Digits", "individual_digits": True}), ({"type": "ByteLevel"}, {"type": "Whitespace"}),
    ({"type": "Sequence", "normalizers": REPLACED}, {"type": "WhitespaceSplit"}),
    ({"type": "Sequence", "normalizers": [{"type": "Strip"}, {"type": "Lowercase"}, *REPLACED, {"type": "StripAccents"}, {"type": "Prepend", "prepend": "> "}, {"type": "ByteLevel"}]}, {"type": "Whitespace"}),
]


@pytest.mark.parametrize("at", range(len(CASES)))
def test_equals_the_kernel(spark, at):
    normal, pre = CASES[at]
    t = Tokenizer(Spec.of({"model": {"type": "WordLevel", "vocab": {"[UNK]": 0}}, "normalizer": normal, "pre_tokenizer": pre}))
    df = spark.createDataFrame([(k, x, "own") for k, x in enumerate(TEXTS)], "k int, text string, pieces string")
    got = alignment.pre_tokenize(df, normal, pre)
    assert got.columns == ["k", "text", "pieces"] and "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for row in got.orderBy("k").collect():
        text = TEXTS[row["k"]]
        expected = None if text is None else [(p.text, p.spans[0][0], p.spans[-1][1]) for p in t.pieces(text)]
        assert (row["pieces"] and [tuple(p) for p in row["pieces"]]) == expected, repr(text)


def test_unsupported_and_empty(spark):
    df = spark.createDataFrame([], "text string")
    assert alignment.pre_tokenize(df, {"type": "Lowercase"}, None).collect() == []
    for normal in ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "a*"}, "content": "b"}):
        with pytest.raises(Unsupported):
            alignment.pre_tokenize(df, normal, None)


def test_no_array_a_byte_where_runs_do(spark):
    """A text without steps has no arrays of places, starts come without an entry a byte, and steps take runs over as slices."""
    df = spark.createDataFrame([("the é",)], "text string")
    plan = lambda normal: alignment.pre_tokenize(df, normal, {"type": "WhitespaceSplit"})._jdf.queryExecution().optimizedPlan().toString()
    assert "0_from" not in plan(None) and "array_repeat(false" not in plan(None)
    lower = plan({"type": "Lowercase"})
    assert "slice(__a0_from" in lower and "array_repeat(false" not in lower


def test_starts_of_many_pieces(spark):
    rows = [[RNG.randint(1, 9) for _ in range(n)] for n in (0, 1, 31, 32, 33, 64, 1024, 1025, 33_000, 70_001)]
    got = spark.createDataFrame([(k, r) for k, r in enumerate([*rows, None])], "k int, n array<int>").select("k", alignment.starts(F.col("n")).alias("s")).orderBy("k").collect()
    assert [r["s"] for r in got] == [[*itertools.accumulate(r, initial=0)][: len(r)] for r in rows] + [None]
