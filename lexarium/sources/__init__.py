"""Where documents and word lists come from, and where results go.

Any Spark reader and writer serves; these are the forms that the operators
expect.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def text_source(spark: SparkSession, text: str) -> DataFrame:
    """One text as a table of one document."""
    return corpus_source(spark, [text])


def corpus_source(spark: SparkSession, texts: Iterable[str]) -> DataFrame:
    """Texts as a table of documents, numbered from 0."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def table_source(spark: SparkSession, path: str, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A Parquet table as documents; only the two columns are read."""
    return spark.read.parquet(path).selectExpr(f"`{doc_col}` AS doc_id", f"`{text_col}` AS text")


def word_list(df: DataFrame, column: str = "word", most: int = 100_000) -> tuple[str, ...]:
    """A table of stop words or targets as a list. Word lists are literals of a plan, so ``most`` bounds them."""
    rows = df.select(column).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} words")
    return tuple(sorted(r[0] for r in rows if r[0] is not None))
