"""Scripts, added tokens and batches as expressions and jobs, against the kernels and plain computation."""

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import expr
from glyphmill.operators import stages
from glyphmill.operators.aligned import Aligned
from glyphmill.operators.tokenizer import Spec, Tokenizer
from glyphmill.plans import batches

RNG = random.Random(3)
LETTERS = [*"abZ   09.,-", "é", "λ", "Ж", "中", "の", "ア", "ー", "한", "ا", "א", "ก", "अ", "ა", "́", "ᚠ", "ꓐ", "𐎀", "͸", "😀", "\n", "𝔸"]
TEXTS = [None, "", "  ", " a", "中 a", *("".join(RNG.choices(LETTERS, k=RNG.randint(1, 30))) for _ in range(300)), "ab 12 中" * 40_000, " " * 100_000, "a" * 300_000]
TOKENS = ["<s>", "</s>", "<start>", "<start_of_turn>", "<start_of", "<", "a", "ab", "abc", "abd", "b.c", "(x)", "[INST]", "[/INST]", "é", "😀😀", *(f"<extra_{i}>" for i in range(500))]


def test_scripts_equal_the_kernel(spark):
    kernel = stages.pre_tokenizer({"type": "UnicodeScripts"})
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string")
    got = {r["k"]: r["p"] for r in df.select("k", expr.unicode_scripts(F.col("t"), expr.script_names()).alias("p")).collect()}
    for k, text in enumerate(TEXTS):
        if text is None or len(text) > 1000:
            continue
        assert got[k] == [p.text for p in kernel(Aligned.of(text)) if p.chars], repr(text)
    assert got[0] is None and "".join(got[len(TEXTS) - 3]) == TEXTS[-3] and got[len(TEXTS) - 2] == [TEXTS[-2]] and got[len(TEXTS) - 1] == [TEXTS[-1]]
    assert len(expr.script_names()) > 130 and len(stages._script_names()) > 130


def test_added_tokens_equal_the_kernel(spark):
    t = Tokenizer(Spec.of({"model": {"type": "WordLevel", "vocab": {"[UNK]": 0, "ab": 1}}, "added_tokens": [{"content": c} for c in TOKENS]}))
    pieces = [*TOKENS[:20], "x", " ", "<st", "<extra_", "<extra_12", "ac", "中", "\n"]
    texts = [None, "", *("".join(RNG.choices(pieces, k=RNG.randint(1, 12))) for _ in range(300)), "<start_of_tur" * 20_000, "x" * 500_000 + "<s>", "<" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = df.select("k", expr.added_tokens(F.col("t"), t.added).alias("s"), expr.added_tokens(F.col("t"), {}).alias("none")).orderBy("k").collect()
    for row, text in zip(got, texts):
        assert (row["s"] and [tuple(x) for x in row["s"]]) == (None if text is None else t.segments(text) if text else []), repr(text)[:100]
        assert (row["none"] and [tuple(x) for x in row["none"]]) == (None if text is None else [(text, None)] if text else [])


def test_a_trie_shares_beginnings():
    pattern = expr.trie([f"<|token_{i}|>" for i in range(1000)])
    assert pattern.count("token_") == 1 and len(pattern) < 1000 * 12


@pytest.mark.parametrize(("size", "multiple"), [(1, 1), (4, 8), (1000, 3)])
def test_batches_equal_a_sorted_list(spark, size, multiple):
    rows = [(k % 90, None if k % 17 == 0 else [RNG.randint(0, 9)] * RNG.choice([0, 1, 2, 5, 5, 5, 40])) for k in range(150)] + [(7, [3] * 5)] * 60
    df = spark.createDataFrame(rows, "id int, ids array<int>").withColumn("batch", F.lit("own")).repartition(5)
    got = batches.padded(df, size, ["id"], multiple=multiple, pad_id=-1).collect()
    order = sorted(len(i or []) for _, i in rows)
    up = lambda n: -(-n // multiple) * multiple
    assert sorted((r["batch"], r["place"]) for r in got) == [divmod(k, size) for k in range(len(rows))]
    for r in got:
        assert r["target"] == up(max(order[r["batch"] * size : (r["batch"] + 1) * size])) and (r["ids"] is None or len(r["ids"]) == r["target"])
    assert sorted((r["id"], str(r["ids"] and [i for i in r["ids"] if i >= 0] or (r["ids"] and []))) for r in got) == sorted((k, str(i and list(i) or (i and []))) for k, i in rows) or size > 1 or multiple > 1
    lengths = {(r["batch"], r["place"]): len([i for i in r["ids"] or [] if i >= 0]) for r in got}
    assert [lengths[k] for k in sorted(lengths)] == order
    assert batches.padded(df.where("false"), size, ["id"]).count() == 0


def test_rows_alike_spread_over_ranges(spark):
    df = spark.createDataFrame([(1, [1, 2])] * 4000, "id int, ids array<int>").repartition(4)
    ranked = batches.ranked(df, [F.size("ids"), F.col("id"), F.rand(1)])
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(4000))
