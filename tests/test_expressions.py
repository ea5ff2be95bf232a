"""Stages as Column expressions against the kernels that pipelines run, on random Unicode; ids by the fast way against the slow one."""

import random

import pytest

from glyphmill.functions import expr
from glyphmill.operators import stages
from glyphmill.operators.aligned import Aligned
from glyphmill.operators.tokenizer import Tokenizer
from glyphmill.plans.queries import BPE_SPEC

RNG = random.Random(9)
CHARS = [*"abcXYZ 09_-.,!?$+<>|'\"\n\t\r\x0b\x0c\x1c\x85\xa0", "　", " ", "é", "é", "ß", "中", "の", "ア", "١", "—", "…", "😀", "​"]
TEXTS = ["a\xa0b　c $d", "", " ", *("".join(RNG.choices(CHARS, k=RNG.randint(1, 40))) for _ in range(400))]
PAIRS = {
    "Whitespace": (expr.whitespace, {}), "BertPreTokenizer": (expr.bert, {}), "Punctuation": (expr.punctuation, {}),
    "Metaspace": (expr.metaspace, {}), "CharDelimiterSplit": (lambda t: expr.char_delimiter(t, "-"), {"delimiter": "-"}),
}


@pytest.mark.parametrize("kind", sorted(PAIRS))
def test_expression_equals_kernel(spark, kind):
    make, more = PAIRS[kind]
    kernel = stages.pre_tokenizer({"type": kind, **more})
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r["p"] for r in rows.select(make(rows["t"]).alias("p")).collect()]
    for text, pieces in zip(TEXTS, got):
        expected = [p.text for p in kernel(Aligned.of(text)) if p.chars]
        assert [p for p in pieces if p] == expected, text


def test_metaspace_with_a_mark_of_a_pattern(spark):
    rows = spark.createDataFrame([("a b",)], "t string")
    for mark in "^.*]\\":
        assert rows.select(expr.metaspace(rows["t"], mark).alias("p")).first()["p"] == [f"{mark}a", f"{mark}b"]


def test_remembered_ids_equal_the_pieces():
    fast, slow = Tokenizer(BPE_SPEC), Tokenizer(BPE_SPEC)
    slow.division = None
    for text in [*TEXTS, "it's the end of the 12 stones  \n\n x"] * 2:
        assert fast.ids(text) == slow.ids(text) == slow.encode(text).ids and fast.decode(fast.ids(text)) == text


def test_unigram_takes_the_best_path():
    scores = {"a": -1.0, "b": -1.5, "ab": -2.0, "ba": -2.2, "aba": -3.1}
    model = stages.Unigram({"vocab": [["<unk>", 0.0], *([k, v] for k, v in scores.items())], "unk_id": 0})

    def best(text):  # all paths
        if not text:
            return 0.0
        return max([scores[text[:n]] + best(text[n:]) for n in range(1, 4) if text[:n] in scores and len(text) >= n], default=float("-inf"))

    for _ in range(60):
        text = "".join(RNG.choices("ab", k=RNG.randint(1, 11)))
        pieces = model.pieces(text)
        assert "".join(pieces) == text and abs(sum(scores[p] for p in pieces) - best(text)) < 1e-9
    assert model.pieces("xyabxx") == ["xy", "ab", "xx"]
