"""Table functions against the kernels, and that their plans only generate."""

import pytest

from glyphmill.functions import tables
from glyphmill.functions.pipeline import Unsupported
from glyphmill.operators.tokenizer import Spec, Tokenizer

TEXTS = [None, "", "it's a b, a\\b 'q' \"r\"", "é É́ Σ 12 ab", "x\ty\nz  a"]
MODEL = {"type": "WordLevel", "vocab": {"[UNK]": 7} | {w: 100 + i for i, w in enumerate(["a", "b", "it", "'", "\\", "é", "12", '"', *(f"w{k}" for k in range(3000))])}}


@pytest.mark.parametrize("pre", [None, "Whitespace", "WhitespaceSplit", "Punctuation", "Digits", "BertPreTokenizer"])
@pytest.mark.parametrize("normal", [None, "Lowercase", "StripAccents"])
def test_equals_the_kernel(spark, pre, normal):
    spec = Spec.of({"model": MODEL, "pre_tokenizer": pre and {"type": pre}, "normalizer": normal and {"type": normal}})
    t = Tokenizer(spec)
    tables.register(spark, spec, "k_")
    spark.createDataFrame(list(enumerate([*TEXTS, "w5 w2999 w3000"])), "k int, text string").createOrReplaceTempView("texts_of_tables")
    got = spark.sql("SELECT d.k, t.* FROM texts_of_tables d, LATERAL k_tokens(d.text) t")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate posexplode" in plan and not any(w in plan for w in ("Exchange", "Join", "Python"))
    rows = sorted(map(tuple, got.collect()))
    expected = [(k, i, p.text, MODEL["vocab"].get(p.text, 7)) for k, x in enumerate([*TEXTS, "w5 w2999 w3000"]) for i, p in enumerate(t.pieces(x) if x else [])]
    assert rows == sorted(expected)
    pieces = spark.sql("SELECT d.k, t.word, t.piece FROM texts_of_tables d, LATERAL k_pre_tokenize(d.text) t").collect()
    assert sorted(map(tuple, pieces)) == sorted(e[:3] for e in expected)


def test_places():
    assert sorted(x for x in tables.placed([(0, 1), (0, 2), (0, 1)], 4) if x is not None) == [0, 1, 2]
    assert tables.placed([(0, 1)] * 3, 4) is None


def test_unsupported(spark):
    for more in ({"pre_tokenizer": {"type": "UnicodeScripts"}}, {"normalizer": {"type": "NFC"}}, {"added_tokens": [{"content": "<s>"}]}, {"model": {"type": "WordLevel", "vocab": {"a": 0}}}):
        with pytest.raises(Unsupported):
            tables.register(spark, Spec.of({"model": MODEL} | more))
