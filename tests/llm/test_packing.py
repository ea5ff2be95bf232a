"""Ids equal the tokenizer's own, whatever its file says of case; step groups hold equal numbers of tokens over all tasks."""

import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import packing

RNG = random.Random(5)
with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
    FILE = f.read()
ODD = "Hello hello HELLO it's IT'S don't ÉTÉ été Ünïcode ß ẞ ª µ ½ 12 a1b2 x### y!!! $$$ <|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b İstanbul ΣΟΦΟΣ 日本 é   \x85 \xa0 \x1c a\x1fb ​ 😀 _a_ -- 'll 'LL a'S".split(" ")


def _cased() -> bytes:
    config = json.loads(FILE)
    config["normalizer"]["normalizers"] = [n for n in config["normalizer"]["normalizers"] if n["type"] != "Lowercase"]
    return json.dumps(config).encode()


def _other() -> bytes:
    config = json.loads(FILE)
    config["pre_tokenizer"] = {"type": "Whitespace"}
    return json.dumps(config).encode()


@pytest.mark.parametrize("file", [FILE, _cased(), _other()], ids=["file", "cased", "other division"])
def test_ids_are_the_tokenizers(file):
    tokens = packing.Tokens(file)
    assert (tokens.apart, tokens.lowers) == {FILE: (True, True), _cased(): (True, False), _other(): (False, True)}[file]
    texts = [None, "", " ", *ODD, *(RNG.choice(["", " "]) + RNG.choice([" ", "\n", "  "]).join(RNG.choices(ODD, k=RNG.randint(1, 30))) for _ in range(400)), "word " * 50_000, "x" * 5_000]
    got = list(tokens(pa.array(texts, pa.string())))
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*tokens.tokenizer.encode(text or "", add_special_tokens=False).ids, 1], text
    tokens.limit = 3  # forgotten words are learned again
    assert list(tokens(pa.array(texts, pa.string()))) == got and list(tokens(pa.array(texts, pa.string()).slice(5, 9))) == got[5:14]


def test_step_groups_are_balanced(spark):
    df = spark.range(700).select(F.col("id").alias("doc_id"), F.expr("repeat('river stone ', cast(5 + id * 37 % 900 as int))").alias("text")).repartition(9)
    step = 8 * 2048
    rows = packing.pack(df, FILE, step_tokens=step).collect()
    sums = Counter()
    for r in rows:
        sums[r["tier"], r["step_group"]] += r["length"]
    for tier in {t for t, _ in sums}:
        own = sorted((n for (t, _), n in sums.items() if t == tier), reverse=True)
        assert all(n == step for n in own[:-1]) and own[-1] <= step
    assert len(sums) > 20


def test_no_rows(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, tier int"), FILE).count() == 0
