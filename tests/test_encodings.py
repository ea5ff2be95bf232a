"""Encodings by expressions against the kernel's."""

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import encodings
from glyphmill.operators.tokenizer import Encoding, Processor

SPECIALS = {"[A]": {"id": "[A]", "ids": [90, 91], "tokens": ["[A]", "+"]}, "[B]": {"id": "[B]", "ids": [92], "tokens": ["[B]"]}}
TEMPLATE = {"type": "TemplateProcessing", "single": "[A] $A:3 [B]:5", "pair": "[A] $B:2 [none] [B]:1 $A", "special_tokens": SPECIALS}
BERT = {"type": "BertProcessing", "cls": ["[CLS]", 101], "sep": ["[SEP]", 102]}
PROCESSORS = [None, BERT, {"type": "RobertaProcessing", "cls": ["<s>", 0], "sep": ["</s>", 2]}, TEMPLATE, {"type": "ByteLevel"}, {"type": "Sequence", "processors": [{"type": "ByteLevel"}, BERT]}, {"type": "Sequence", "processors": [BERT, TEMPLATE]}]
ROWS = [([], []), ([5], []), ([5, 6, 7], [8, 9]), ([1] * 50, [2] * 30)]


def _encoding(ids):
    n = len(ids)
    return Encoding(list(ids), [0] * n, ["t"] * n, [0] * n, [(0, 1)] * n, [0] * n, [1] * n)


def _fields(e):
    return tuple(e[f] if isinstance(e, dict) or not isinstance(e, Encoding) else getattr(e, f) for f in encodings.FIELDS)


@pytest.mark.parametrize("at", range(len(PROCESSORS)))
@pytest.mark.parametrize("add", [True, False])
def test_equals_the_kernel(spark, at, add):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(ROWS)] + [(99, None, [1]), (98, [1], None)], "k int, a array<int>, b array<int>")
    one, two = encodings.processed(PROCESSORS[at], F.col("a"), None, add), encodings.processed(PROCESSORS[at], F.col("a"), F.col("b"), add)
    left = encodings.padded(encodings.truncated(one, 4, left=True), 6, 77, 3, left=True)
    got = {r["k"]: r for r in df.select("k", one.alias("one"), two.alias("two"), left.alias("left"), encodings.padded(encodings.truncated(two, 7), 8).alias("right")).collect()}
    for k, (a, b) in enumerate(ROWS):
        run = lambda *x: Processor(PROCESSORS[at])(*x, add)
        single, pair = run(_encoding(a), None), run(_encoding(a), _encoding(b))
        assert _fields(got[k]["one"]) == _fields(single) and _fields(got[k]["two"]) == _fields(pair)
        single.truncate(4, True)
        single.pad(6, 77, 3, "p", True)
        pair.truncate(7)
        pair.pad(8)
        assert _fields(got[k]["left"]) == _fields(single) and _fields(got[k]["right"]) == _fields(pair)
    assert got[99]["one"] is None and got[99]["two"] is None and got[98]["two"] is None and got[98]["one"] is not None
