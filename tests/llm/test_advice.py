"""Cases of the review: near copies of the pipeline's stage, texts in languages that weren't learned."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphmill.llm import language, nearcopies

RNG = random.Random(3)


def _brute(rows):
    """The row kept of each component of 5-word Jaccard >= 0.8, all pairs compared; rows (key, text)."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b)):
                root[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append((k is None, k or 0))
    return sorted(min(g) for g in groups.values())


def test_near_copies_of_five_words(spark, sf):
    documents = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    words = [RNG.choice(["stone", "river", "bridge", "field", "cloud", "morning"]) + str(RNG.randrange(500)) for _ in range(200)]
    edited = [" ".join(words[:i] + ["edited"] + words[i + 1 :]) for i in (20, 60, 100, 140)]
    twice = [" ".join(words[:i] + ["changed"] + words[i + 2 :]) for i in range(10, 190, 3)]  # a family, larger than a pair
    rows = [*documents, *((10_000_000 + i, t) for i, t in enumerate([" ".join(words), *edited, *twice])), (None, "no id"), (None, "no id"), (20_000_000, "shares"), (20_000_000, "an id"), (30_000_000, None), (30_000_001, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).repartition(5)
    got = corpus_pipeline.simhash_dedup(spark, df, sf)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == _brute(rows)


@pytest.mark.parametrize("least", [0.5, 0.9])
def test_near_copies_bounds(spark, least):
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k"), (3, "x y z")]
    kept = nearcopies.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), least=least, words=2)
    assert {r["doc_id"] for r in kept.collect()} == ({1, 3} if least == 0.5 else {1, 2, 3})


def test_unlearned_languages(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["lang"], r["text"]) for r in documents.collect()]
    labeller = language.Labeller(language.learn([r for r in rows if r[0] != "de"]))
    english = next(t for lang, t in rows if lang == "en" and len(t.split()) > 200).split()
    russian = "река и камни были светлыми утром над старым мостом".split()
    assert labeller.label(" ".join(russian))[:2] == ("und", 0.0)
    mixed = labeller.label(" ".join(russian * 4 + english[:20]))
    assert mixed[:2] == ("und", 0.0) and [s[2] for s in mixed[2]] == ["und", "en"]
    third = labeller.label(" ".join(english[:60] + russian * 3))
    assert third[0] == "en" and third[1] < 0.8
    noise = " ".join("".join(RNG.choices("abcdefghijklmnopqrstuvwxyz", k=RNG.randint(2, 10))) for _ in range(100))
    assert labeller.label(noise)[1] < 0.5
    scores = {k: sorted(labeller.label(t)[1] for lang, t in rows if lang == k and len(t.split()) > 20) for k in ("de", "en", "es", "fr")}
    assert all(scores[k][len(scores[k]) // 20] >= 0.5 for k in ("en", "es", "fr"))  # all but a twentieth
    assert scores["de"][-len(scores["de"]) // 20] < 0.5


def test_long_words_count_by_length():
    labeller = language.Labeller(language.learn([("a", "lorem ipsum dolor " * 30), ("b", "zzzz qqqq xxxx " * 30)]))
    short, long_ = (labeller.rows[labeller.forms[w]].min() for w in ("lorem", "loremipsumdolor" * 4))
    assert short >= -language.LEAST and long_ < -2 * language.LEAST


def test_rows_without_an_id_of_their_own_stay(spark):
    rows = [(None, "a text of its own"), (7, "first text of seven"), (7, "another text"), (8, "another text"), (None, "another text"), (9, None)]
    kept = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[1], rows[2], rows[5]], key=str)
