"""Encoding by a dictionary against the kernels, text by text."""

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import expr, pipeline
from glyphmill.operators import stages
from glyphmill.operators.frames import TextPipeline
from glyphmill.operators.tokenizer import Spec, Tokenizer
from glyphmill.plans import dictionary
from glyphmill.plans.queries import BPE_SPEC

RNG = random.Random(4)
CHARS = [*"abcdeth ing  the on\t\n.,!12'", "é", "ß", "中", "の", "😀", "\xa0", "Σ", "▁"]
TEXTS = [None, "", " ", "the the the", "theing on the", *("".join(RNG.choices(CHARS, k=RNG.randint(1, 60))) for _ in range(200)), "the ing " * 3000, "x" * 500 + " the"]
LETTERS = {c: i for i, c in enumerate(["[UNK]", *"abcdethingo", "th", "the", "in", "ing", "on"])}
CHAR_BPE = {"type": "BPE", "vocab": LETTERS, "merges": ["t h", "th e", "i n", "in g", "o n"], "unk_token": "[UNK]", "fuse_unk": True}
SPECS = [
    BPE_SPEC, Spec.of({"model": CHAR_BPE, "normalizer": {"type": "Sequence", "normalizers": [{"type": "Lowercase"}, {"type": "Strip"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}]}, "pre_tokenizer": {"type": "Whitespace"}}),
    Spec.of({"model": CHAR_BPE, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "Punctuation"}, {"type": "Digits", "individual_digits": True}]}}),
    Spec.of({"model": {"type": "WordPiece", "vocab": LETTERS | {"##" + c: 100 + i for c, i in LETTERS.items()}, "unk_token": "[UNK]"}, "pre_tokenizer": {"type": "BertPreTokenizer"}}),
    Spec.of({"model": {"type": "Unigram", "vocab": [["<unk>", 0.0], *([c, -2.0] for c in "abcdethingo▁"), ["▁the", -3.0], ["ing", -3.5]], "unk_id": 0}, "pre_tokenizer": {"type": "Metaspace"}}),
    Spec.of({"model": CHAR_BPE, "pre_tokenizer": {"type": "Split", "pattern": {"Regex": "[aeo]+|,"}, "behavior": "Isolated"}}), Spec.of({"model": CHAR_BPE}),
]


@pytest.mark.parametrize("at", range(len(SPECS)))
def test_equals_the_kernel(spark, at):
    spec, t = SPECS[at], Tokenizer(SPECS[at])
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    expected = [None if x is None else t.ids(x) for x in TEXTS]
    got = {r["id"]: r["ids"] for r in dictionary.encode(df, spec, ["id"], dictionary=dictionary.words(df, spec, most=7)).collect()}
    assert [got[k] for k in range(len(TEXTS))] == expected
    counts = {r["id"]: r["n_tokens"] for r in dictionary.count(df, spec, ["id"]).collect()}
    assert [counts[k] for k in range(len(TEXTS))] == [None if x is None else len(x) for x in expected]


def test_dictionary_of_another_corpus_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "the ing"), (2, "on")], "id int, text string")
    none = df.where("false")
    t = Tokenizer(BPE_SPEC)
    for known in (dictionary.words(none, BPE_SPEC), dictionary.words(spark.createDataFrame([("other words",)], "text string"), BPE_SPEC)):
        assert {r["id"]: r["ids"] for r in dictionary.encode(df, BPE_SPEC, ["id"], dictionary=known).collect()} == {1: t.ids("the ing"), 2: t.ids("on")}
    assert {r["id"]: r["e"] for r in TextPipeline(BPE_SPEC).corpus_ids(df, ["id"], out="e").collect()} == {1: t.ids("the ing"), 2: t.ids("on")}
    assert dictionary.encode(none, BPE_SPEC, ["id"]).collect() == [] and dictionary.words(none, BPE_SPEC).count() == 0


def test_repeated_keys_and_rows(spark):
    rows = [(1, "the", "x"), (1, "the", "x"), (1, "the", "x"), (1, "on the", "y"), (None, "the", "x"), (None, "the", "x"), (2, None, "x"), (2, None, "x"), (2, "", "x"), (3, "the the \xe9", "x"), (3, "the the \xe9", "x")]
    t = Tokenizer(BPE_SPEC)
    got = dictionary.encode(spark.createDataFrame(rows, "ids int, text string, word string"), BPE_SPEC, ["ids", "word"], dictionary=dictionary.words(spark.createDataFrame([("the",)], "text string"), BPE_SPEC), out="e")
    assert got.columns == ["ids", "word", "e"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, w, None if x is None else t.ids(x)) for i, x, w in rows), key=str)


def test_whole_texts_stay_in_the_jvm(spark):
    df = spark.createDataFrame([(1, "the ing")], "id int, text string")
    plan = dictionary.encode(df, BPE_SPEC, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "SortMergeJoin" not in plan
    python = [line for line in plan.splitlines() if "ArrowEvalPython" in line or "MapInArrow" in line]
    assert len(python) == 2 and not any("text" in line.split("]")[0] for line in python)


@pytest.mark.parametrize(("decoder", "tokens"), [
    (None, ["a", "b"]), ({"type": "ByteLevel"}, ["ab", "Ġc", "Ã", "©"]), ({"type": "WordPiece"}, ["a", "##b", "c"]), ({"type": "BPEDecoder", "suffix": "</w>"}, ["a</w>", "b", "c</w>"]),
    ({"type": "Metaspace"}, ["▁a", "b▁"]), ({"type": "Fuse"}, ["a", "b"]), ({"type": "ByteFallback"}, ["a", "<0xC3>", "<0xA9>", "b", "<0xE5>", "<0x8f>", "c", "<0xE2>"]),
])
def test_decoding_equals_the_kernel(spark, decoder, tokens):
    spec = Spec.of({"model": {"type": "WordLevel", "vocab": {t: i for i, t in enumerate(tokens)}}, "decoder": decoder, "added_tokens": [] if decoder == {"type": "ByteLevel"} else [{"content": "<s>", "special": True}]})
    t = Tokenizer(spec)
    ids = [list(range(len(tokens))), [*range(len(tokens))][::-1], [], [99, 0, -1], [len(tokens), 0, len(tokens)]]
    df = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "k int, ids array<int>")
    for skip in (True, False):
        got = df.select("k", dictionary.decode(spec, F.col("ids"), skip).alias("t")).orderBy("k").collect()
        assert [r["t"] for r in got] == [t.decode(i, skip) for i in ids]


def test_byte_runs(spark):
    pieces = ["a", "<0xC3>", "<0xa9>", "<0x41>", "<0xFF>", "<0xE2>", "<0x82>", "<0xAC>", "", "x0A", "<0x4>", "y"]
    rows = [[RNG.choice(pieces) for _ in range(RNG.randint(0, 9))] for _ in range(300)] + [["<0x61>"] * 20_000]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, a array<string>")
    got = df.select("k", expr.byte_fallback(F.col("a")).alias("b")).orderBy("k").collect()
    assert [r["b"] for r in got] == [stages.decoder({"type": "ByteFallback"})(r) for r in rows]


def test_what_has_no_expression():
    for normal, pre in (({"type": "NFC"}, None), (None, {"type": "FixedLength"}), (None, {"type": "Split", "pattern": {"Regex": "a+"}, "behavior": "MergedWithNext"})):
        with pytest.raises(pipeline.Unsupported):
            pipeline.pieces(normal, pre)
