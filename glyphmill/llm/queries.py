"""The queries of this subpackage, opN_<name>, each over its whole table, and what SQL can say of them."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import classify, codebooks, globs, interactions, language, neighbours, packing, private, quality, sentencepiece, simhash, wrappers
from .common import fold, table

PIECES = os.environ.get("GLYPHMILL_PIECES") or public_tokenizers.path("piece_bpe_32k.model")
WORDS = os.environ.get("GLYPHMILL_WORDS") or public_tokenizers.path("word_bpe_49k.json")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.digest(table(spark, sf_dir, "documents"), sentencepiece.load(PIECES))


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("key") % 20 == 0)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = language.identify(documents, language.fit(documents, learns=language.learnable()))
    # a text of letters has a learned language, if with a score of 0; the operator itself says `und` of most letters in other scripts
    predicted = F.when(F.col("lang_pred") == language.UNDETERMINED, F.coalesce("lang_best", "lang_pred")).otherwise(F.col("lang_pred"))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), predicted.alias("lang_pred"), "score", "n_spans")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(WORDS, "rb") as f:
        return packing.pack(table(spark, sf_dir, "documents"), f.read())


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = classify.fit_quality(documents, labels, fold("doc_id", 3) != 1)
    return classify.score_quality(documents, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = classify.fit_toxicity(documents, labels, fold("doc_id", 5) != 0, fold("doc_id", 5) != 0)
    return classify.score_marks(documents, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), private.key_of(spark))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_url_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return globs.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def queries() -> dict:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op8_quality_rules": quality.ORACLE_SQL, "op11_filter_interactions": interactions.ORACLE_SQL, "op12_url_globs": globs.ORACLE_SQL, "op13_vector_codes": codebooks.ORACLE_SQL}
