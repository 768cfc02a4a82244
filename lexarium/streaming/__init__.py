"""Streams.

The operators have no state across documents of their own: those that work
within a row (the splits of operators.tokenizer, phrase and word columns) take
a streaming DataFrame as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_stream(stream: DataFrame, parts: Column, place: str = "pos", part: str = "part", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each part of each arriving document; parts: a column of Tokenizer, such as words_column."""
    return stream.filter(F.col("text").isNotNull()).select(*keep, F.posexplode(parts).alias(place, part))
