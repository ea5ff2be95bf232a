"""The cascade: its estimates, its order, and columns with the names of its own."""

from pyspark.sql import functions as F

from glyphmill.llm import quality


def test_order_by_rejections_per_second(spark, sf):
    rows = quality.counts(quality.sampled(spark.read.parquet(f"{sf}/documents.parquet")))
    dear = quality.Rule("dear", r"char_length(regexp_replace(regexp_replace(text, '[^\\p{L}]', 'ab'), '[^\\p{Lu}]', '')) >= 0")
    cheap, never = quality.Rule("cheap", "n_words >= 0"), quality.Rule("never", "n_words < 0")
    for _ in range(3):
        found = quality.ordered(rows, (never, dear, cheap))
        assert [r.name for r, _, _ in found] == ["cheap", "dear", "never"]
        cost = {r.name: c for r, _, c in found}
        share = {r.name: s for r, s, _ in found}
        assert cost["dear"] > 8 * cost["cheap"] and (share["cheap"], share["dear"], share["never"]) == (1, 1, 0)


def test_sample_comes_from_all_partitions(spark):
    df = spark.range(40_000).select(F.col("id").cast("string").alias("text")).repartition(16)
    once, again = (sorted(r["text"] for r in quality.sampled(df).collect()) for _ in range(2))
    assert once == again and 2000 <= len(once) <= 4000
    assert quality.sampled(df).withColumn("p", F.spark_partition_id()).select("p").distinct().count() == 16
    assert quality.sampled(df.limit(50)).count() == 50


def test_own_columns_stay(spark):
    long_ = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(1, long_, "mine", 7), (2, "short", "mine", 8), (None, None, None, None), (1, long_, "mine", 7)], "doc_id long, text string, kept string, n_words int")
    got = quality.keep(df)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(1, long_, "mine", 7)] * 2
    assert quality.keep(df.where("false")).count() == 0


def test_other_text_column(spark):
    df = spark.createDataFrame([("x " * 60, " ".join(f"word{i}" for i in range(80)))], "text string, body string")
    assert quality.judge(df, "body").first()["kept"] and not quality.judge(df).first()["kept"]


def test_what_lies_behind_a_rule_is_not_evaluated(spark, monkeypatch):
    # a division by zero that two rules share, and a shared value that fails
    monkeypatch.setitem(quality.SHARED, "__bad", "1 / zero")
    df = spark.createDataFrame([(k % 2 == 0, 0, "text") for k in range(50)], "base_failed boolean, zero int, text string").repartition(2)
    first = quality.Rule("first", "text = 'text'")
    for later in (("1 / zero > 1", "1 / zero > 2", ()), ("__bad > 1", "__bad > 2", ("__bad",))):
        rules = [quality.Rule("a", later[0], later[2]), quality.Rule("b", later[1], later[2])]
        assert df.select(F.expr(quality.cascade([first, *rules])).alias("r")).distinct().collect()[0]["r"] is True
        assert df.where("base_failed").select(F.expr(quality.cascade(rules)).alias("r")).distinct().collect()[0]["r"] is True
        try:
            df.select(F.expr(quality.cascade([*rules, first])).alias("r")).collect()
        except Exception as e:
            assert "DIVIDE_BY_ZERO" in str(e)
        else:
            raise AssertionError("the rules aren't reached at all")


def test_any_order_gives_the_same_verdict(spark, sf):
    rows = quality.counts(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).withColumn("base_failed", quality.base_failed()).persist()
    rules, verdicts = list(quality.RULES), set()
    for k in range(0, len(rules), 3):
        got = rows.select("doc_id", F.expr(quality.cascade(rules[k:] + rules[:k])).alias("r")).where("r").select(F.sort_array(F.collect_list("doc_id"))).first()[0]
        verdicts.add(tuple(got))
    rows.unpersist()
    assert len(verdicts) == 1


def test_the_first_user_pays_for_a_shared_value(spark, monkeypatch):
    monkeypatch.setitem(quality.SHARED, "__dear", "char_length(repeat(text, 2000))")
    rows = quality.counts(spark.createDataFrame([("word " * 100,)] * 50, "text string"))
    found = quality.ordered(rows, (quality.Rule("a", "__dear > 0", ("__dear",)), quality.Rule("b", "__dear >= 0", ("__dear",)), quality.Rule("c", "n_words > 0")))
    cost = {r.name: c for r, _, c in found}
    assert found[0][0].name == "c" and cost[found[1][0].name] > 4 * cost[found[2][0].name]
