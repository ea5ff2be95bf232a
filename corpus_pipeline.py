"""A corpus pipeline of five stages over `documents`, each by one of the operators in glyphmill.llm.

A stage gets what its predecessor kept, as Parquet, and all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import common, language, nearcopies, packing, private, quality, queries

#: A document goes if its language's share of its letters, times their fit to it, is less than this, or if it has none.
LEAST_SHARE = 0.5
#: Words that a worker remembers in a stage: workers hold them on into the next one.
WORDS = 300_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep(docs, language.fit(docs, learns=language.learnable()), LEAST_SHARE, words=WORDS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.deduplicate(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return private.pseudonymise(docs, private.key_of(spark), counts=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with open(queries.WORDS, "rb") as f:
        return packing.pack(docs, f.read(), words=WORDS)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("simhash_dedup", simhash_dedup), ("pii", pii), ("packing", pack)]

#: SQL can't express the stages; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two of them lies a table in the shared folder, deleted when the next one is written.

    The last table stays, as the rows returned are read from it.
    """
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
