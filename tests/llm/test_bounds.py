"""What is learned from stays within its bound, and predictions within the contract, whatever the ids."""

from pyspark.sql import functions as F

from glyphmill.llm import classify, language, queries


def test_repeated_ids_count_once(spark, monkeypatch):
    rows = [(7, f"the same id number {k}", "en") for k in range(3000)] + [(k, f"ein Satz mit der Nummer {k}", "de") for k in range(40)] + [(100 + k, f"a phrase of number {k}", "en") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language, "learn", lambda found: seen.append(found))
    language.fit(df, per_language=10)
    counts = {k: sum(lang == k for lang, _ in seen[0]) for k in ("de", "en")}
    assert counts == {"de": 10, "en": 10}
    labels = spark.createDataFrame([(7, k % 2, 1) for k in range(500)] + [(k, k % 2, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    assert len(classify.sampled(df, labels, "quality", F.lit(True), 10)) <= 20
    monkeypatch.setattr(classify, "train_marks", lambda toxic, others: seen.append((toxic, others)))
    classify.fit_toxicity(df, labels, F.lit(True), F.lit(True), 10)
    assert len(seen[1][0]) <= 10 and len(seen[1][1]) <= 20


def test_letters_have_a_learned_language(spark, tmp_path):
    base = ["the river runs through the old town", "der Fluss fließt durch die alte Stadt"]
    rows = [(k, f"{base[k % 2]} {k}", ("en", "de")[k % 2]) for k in range(60)] + [(60, "вечером река замерзает", None), (61, "вечером река замерзает the river", None), (62, "12 !?", None), (63, None, None), (64, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op3_language(spark, str(tmp_path)).collect()}
    assert got[60]["lang_pred"] in ("de", "en") and got[60]["score"] == 0 and got[61]["lang_pred"] == "en"
    assert all(got[k]["lang_pred"] == "und" for k in (62, 63, 64)) and all(got[k]["lang_pred"] == ("en", "de")[k % 2] for k in range(60))
    # the operator tells such texts apart
    model = language.fit(spark.read.parquet(str(tmp_path / "documents.parquet")))
    assert {r["lang_pred"] for r in language.identify(spark.read.parquet(str(tmp_path / "documents.parquet")), model).where("doc_id IN (60, 61)").collect()} == {"und"}
