"""Encoding streams: tokenizing keeps no state, so it runs on a streaming DataFrame as it is; counts go by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.plans.tokenizer import Tokenizer


def encode_stream(stream: DataFrame, tokenizer: Tokenizer, text_col: str = "text", to: str = "ids") -> DataFrame:
    """Ids of a stream's texts."""
    return tokenizer.encode(stream, text_col, to)


def token_counts(stream: DataFrame, tokenizer: Tokenizer, time_col: str, text_col: str = "text", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Tokens per window of event time; rows later than ``late`` are dropped."""
    sized = encode_stream(stream, tokenizer, text_col, "_ids").withWatermark(time_col, late)
    return sized.groupBy(F.window(time_col, window)).agg(F.sum(F.size("_ids")).alias("tokens"), F.count("*").alias("texts"))
