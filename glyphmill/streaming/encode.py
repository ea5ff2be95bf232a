"""Streams of text: encoding keeps no state, so a streaming DataFrame goes through the same pipeline as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.frames import TextPipeline
from ..operators.tokenizer import Spec


def encode_stream(stream: DataFrame, spec: Spec, text: str = "text", out: str = "ids") -> DataFrame:
    return TextPipeline(spec).ids(stream, text, out)


def token_rate(stream: DataFrame, spec: Spec, time: str, text: str = "text", window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Rows and tokens of each window; rows later than `late` are left out."""
    counted = TextPipeline(spec).count_tokens(stream, text).withWatermark(time, late)
    return counted.groupBy(F.window(time, window)).agg(F.count("*").alias("n_rows"), F.sum("n_tokens").alias("n_tokens"))
