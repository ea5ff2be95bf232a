"""Held-out accuracy of the trained operators and recall of the neighbour search: python -m glyphmill.llm.evaluate SF_DIR."""

from __future__ import annotations

import json
import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import queries
from .common import table


def auc(label: np.ndarray, score: np.ndarray) -> float:
    """Chance that a row of label 1 has a higher score than one of label 0; equal scores count half."""
    values, inverse, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inverse]
    ones = int(label.sum())
    return float((rank[label == 1].sum() - ones * (ones + 1) / 2) / max(1, ones * (len(label) - ones)))


def classifier(scored: DataFrame, labels: DataFrame, name: str) -> dict:
    rows = scored.where("held_out").join(labels, "doc_id").select(F.col(name).alias("y"), "score", "predicted").toPandas()
    y, p = rows["y"].to_numpy(), rows["predicted"].to_numpy()
    return {"rows": len(rows), "auc": round(auc(y, rows["score"].to_numpy()), 4), "recall_of_1": round(float(p[y == 1].mean()), 4), "ones_among_0": round(float(p[y == 0].mean()), 4)}


def recall(spark: SparkSession, sf_dir: str, most: int = 200, k: int = 20) -> dict:
    """Of the true k nearest of `most` queries, the share found."""
    rows = [(r[0], r[1]) for r in table(spark, sf_dir, "embeddings").select("vec_id", "embedding").dropna().collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    found: dict[int, set] = {}
    for r in queries.op2_nn_descent(spark, sf_dir).select("query_id", "vec_id").collect():
        found.setdefault(r[0], set()).add(r[1])
    hits = total = 0
    for q in sorted(found)[:: max(1, len(found) // most)]:
        score = np.where(ids == q, -np.inf, x @ x[np.flatnonzero(ids == q)[0]])
        best = ids[np.lexsort((ids, -score))[:k]]
        hits, total = hits + len(found[q] & set(best.tolist())), total + len(best)
    return {"rows": len(ids), "recall": round(hits / max(1, total), 4)}


def main(sf_dir: str) -> None:
    spark = SparkSession.builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    labels, documents = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    right = queries.op3_language(spark, sf_dir).where("held_out").join(documents.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL")
    found = {
        "op3": right.agg(F.count("*").alias("rows"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("accuracy")).first().asDict(),
        "op5": classifier(queries.op5_quality_classifier(spark, sf_dir), labels, "quality"),
        "op6": classifier(queries.op6_toxicity(spark, sf_dir), labels, "toxic"),
        "op2": recall(spark, sf_dir),
    }
    print(json.dumps({"data": sf_dir, **found}))


if __name__ == "__main__":
    main(sys.argv[1])
