"""What the plans of queries leave out, so that their work grows no faster than the tables."""

from pyspark.sql import functions as F

from glyphmill.functions import expr
from glyphmill.operators import frames, stages
from glyphmill.plans import dictionary, queries, unigram


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_word_is_shuffled_with_its_document(spark, sf):
    assert "Aggregate [doc_id#" in (found := plan(queries.wordlevel_ids(spark, sf))) and not any(line.strip(" +-:").startswith("Aggregate [doc_id#") and "token#" in line.split("]")[0] for line in found.splitlines())


def test_edges_of_words_are_no_rows(spark):
    df = spark.createDataFrame([("ab",)], "word string")
    assert "Generate" not in plan(unigram.best_paths(df, queries.UNIGRAM_SPEC))


def test_texts_are_cut_once(spark, sf):
    split = plan(queries.added_token_split(spark, sf))
    assert split.count("regexp_extract_all(") == 1 and "array_position" not in split
    pairs = plan(queries.pair_encode(spark, sf))
    assert pairs.count("regexp_extract_all(") == 1 and pairs.count("split(") == 1


def test_ids_are_put_together_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, "the ing")], "id int, text string")
    found = plan(dictionary.encode(df, queries.BPE_SPEC, ["id"], dictionary=spark.createDataFrame([("the", [1])], "word string, ids array<int>")))
    assert "Aggregate" not in found and "Repartition" not in found


def test_a_text_over_many_batches(spark):
    df = spark.createDataFrame([(1, None), (2, "the ing on " * 9000), (3, ""), (4, "of"), (5, "a b " * 5000), (6, "")], "id int, text string").coalesce(1)
    counts = {r["id"]: r["n_tokens"] for r in dictionary.count(df, queries.BPE_SPEC, ["id"]).collect()}
    ids = {r["id"]: r["ids"] for r in dictionary.encode(df, queries.BPE_SPEC, ["id"]).collect()}
    t = queries.Tokenizer(queries.BPE_SPEC)
    assert ids == {r["id"]: None if r["text"] is None else t.ids(r["text"]) for r in df.collect()} and counts == {k: None if v is None else len(v) for k, v in ids.items()}


def test_what_workers_remember_is_bounded(monkeypatch):
    monkeypatch.setattr(dictionary, "REMEMBERED", 10)
    monkeypatch.setattr(stages, "REMEMBERED", 10)
    known = dictionary._Words(queries.BPE_SPEC, True)
    for n in range(40):
        assert known[f"{n}"] and known["x" * (100 + n)] and len(known) <= 10 and len(known.model.cache) <= 10


def test_rows_of_short_texts_come_in_small_portions():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 10_000)], ["word"])
    assert max(p.num_rows for p in frames._portions(batch, [0])) <= frames.ROWS < 10_000


def test_lookup(spark):
    keys = {f"{c}{n}é": n for c in "ab" for n in range(50)} | {"": -1}
    df = spark.createDataFrame([(k,) for k in [*keys, "a", "zé", None]], "k string")
    assert {r["k"]: r["v"] for r in df.select("k", expr.lookup(keys, "int")(F.col("k"))["value"].alias("v")).collect()} == keys | {"a": None, "zé": None, None: None}


def test_byte_tokens_are_told_run_by_run(spark):
    df = spark.createDataFrame([(["<0xC3>", "<0xA9>", "a"],)], "a array<string>")
    (line,) = [x for x in plan(df.select(expr.byte_fallback(F.col("a")))).splitlines() if x.startswith("Project")]
    assert "3C3078" in line and "\\A<0x" not in line  # a pattern a run, none a token
