"""The fold against the kernel, and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.functions.pipeline import Unsupported
from glyphmill.operators import stages
from glyphmill.operators.tokenizer import Spec
from glyphmill.plans import unigram
from glyphmill.plans.queries import UNIGRAM_SPEC

RNG = random.Random(6)
TIES = Spec.of({"model": {"type": "Unigram", "vocab": [["<unk>", 0.0], ["a", -1.0], ["b", -1.0], ["ab", -2.0], ["ba", -2.0], ["aba", -3.0], ["a", -9.0], ["é😀", -1.5], ["bbbb", -3.5]], "unk_id": 0}})
WORDS = ["", "a", "é", "xyz", "axxa", "é😀x", "bbbbbb", "<unk>", *("".join(RNG.choices("abxé😀", k=RNG.randint(1, 14))) for _ in range(300)), "ab" * 150]


@pytest.mark.parametrize(("spec", "words"), [(TIES, WORDS), (UNIGRAM_SPEC, ["the", "nothing", "schön", "and42the", "ration", "x" * 40, "中文"])])
def test_equals_the_kernel(spark, spec, words):
    model = stages.model(spec.model)
    df = spark.createDataFrame([(w,) for w in [*words, *words[:20], None]], "word string")
    got = {r["word"]: r for r in unigram.best_paths(df, spec).collect()}
    assert set(got) == set(words)
    for w in words:
        assert [(p["id"], p["text"]) for p in got[w]["pieces"]] == [t[:2] for t in model.tokenize(w)], w
        each = {True: lambda p: model.scores[p], False: lambda p: model.unknown_score * len(p)}
        assert got[w]["score"] == sum(each[p in model.scores](p) for p in model.pieces(w))


def test_plan_and_errors(spark):
    df = spark.createDataFrame([("ab",), ("xab",)], "word string")
    found = unigram.best_paths(df, TIES)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert unigram.best_paths(df.where("false"), TIES).collect() == []
    without = Spec.of({"model": {k: v for k, v in TIES.model.items() if k != "unk_id"}})
    assert unigram.best_paths(df.where("word = 'ab'"), without).select(F.size("pieces")).first()[0] == 1
    with pytest.raises(Exception, match="no unk_id"):
        unigram.best_paths(df, without).collect()
    with pytest.raises(Unsupported):
        unigram.best_paths(df, Spec.of({"model": TIES.model | {"byte_fallback": True}}))
