"""What the operators share: inputs, work within a row, ranking and lookups."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexarium.operators.batches import Found

_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
#: Rows that a batch of results holds at most.
_FLUSH = 1 << 16
#: Bytes of text that are worked on at once, one document's aside.
_PIECE = 1 << 20
#: Distinct keys of a lookup that are kept in memory.
_KEYS = 10_000
#: A line of a printed plan that is an exchange, whatever columns and folders are called.
_EXCHANGE = re.compile(r"^[\s:+|*()\d-]*Exchange ", re.MULTILINE)


def documents(df: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of the rows that have a text."""
    return df.select(F.col(doc_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores; only an input with fewer splits than that, such as one small file, is dealt out anew.

    A large table keeps its splits and isn't shuffled. What comes out of a
    shuffle stays as it is: counting its partitions would run it.
    """
    if _EXCHANGE.search(df._jdf.queryExecution().executedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their texts exceed _PIECE; a longer document is a piece of its own."""
    for batch in batches:
        texts = [pc.fill_null(pc.binary_length(c), 0) for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
        ends = np.cumsum(sum(t.to_numpy(zero_copy_only=False).astype(np.int64) for t in texts))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PIECE, "right")))
            yield batch.slice(at, end - at)
            at = end


def within_rows(df: DataFrame, work: Callable[..., tuple], kinds: dict[str, str], nested: bool = False) -> DataFrame:
    """(doc_id, *kinds): what ``work`` makes of the other columns of some rows at a time: places of rows, and a column for each of kinds.

    A row is a document: rows that share a doc_id, or have none, are scored
    one by one and nothing is shuffled. A task holds the words of one piece of
    its texts at a time, or those of one longer document. nested: one row with
    arrays for each document, else a row for each element.
    """
    inputs = [c for c in df.columns if c != "doc_id"]
    types = [_ARROW[k] for k in kinds.values()]
    names = ["doc_id", *kinds]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            rows, *found = work(*(piece.column(c) for c in inputs))
            columns = [x.cast(t) if isinstance(x, pa.Array) else pa.array(x).cast(t) for x, t in zip(found, types)]
            if nested:
                order = pa.array(np.argsort(rows, kind="stable"))
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=piece.num_rows)))).astype(np.int32))
                rows, columns = np.arange(piece.num_rows), [pa.ListArray.from_arrays(offsets, c.take(order)) for c in columns]
            out = pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(rows)), *columns], names=names)
            step = out.num_rows if nested else _FLUSH
            for at in range(0, out.num_rows, max(1, step)):
                yield out.slice(at, step)

    kind_of_id = df.schema["doc_id"].dataType.simpleString()
    fields = [f"`{n}` " + (f"array<{k}>" if nested else k) for n, k in kinds.items()]
    return df.mapInArrow(run, ", ".join([f"doc_id {kind_of_id}", *fields]))


def scored(
    df: DataFrame,
    find: Callable[..., Found],
    key: str,
    n: int | None = None,
    nested: bool = False,
    digits: int | None = None,
    keys: frozenset[str] | None = None,
    more: dict[str, str] | None = None,
    before: dict[str, str] | None = None,
) -> DataFrame:
    """What ``find`` finds in pieces of the rows, as (doc_id, key, *before, score, *more).

    n: only the n best of each document, with their rank. nested: one row with
    arrays for each document. digits: one text for each document instead, of
    its keys in byte order, each with its score to so many places. keys: only
    these keys.
    """
    if n is not None and n < 0:
        raise ValueError("n must be 0 or more")
    more, before = more or {}, before or {}

    def work(*columns: pa.Array) -> tuple:
        found = find(*columns)
        if digits is not None:
            return found.text(len(columns[0]), digits)
        if n is not None:
            return found.best(n)
        if keys is None:
            return found.columns()
        names = found.names(None)
        at = np.flatnonzero(pc.is_in(names, pa.array(sorted(keys), names.type)).to_numpy(zero_copy_only=False))
        return found.columns(at)

    if digits is not None:
        return within_rows(df, work, {"scores": "string"})
    return within_rows(df, work, {key: "string", **before, "score": "double", **({} if n is None else {"rank": "int"}), **more}, nested)


def ranked(scores: DataFrame, n: int, key: str, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """The n best of each group: by score, downwards, then by key in byte order. rank counts from 1.

    Without groups the top rows are taken without a full sort.
    """
    if n < 0:
        raise ValueError("n must be 0 or more")
    order = [F.col(score).desc_nulls_last(), F.col(key).asc()]
    if not by:
        top = scores.orderBy(*order).limit(n)  # n rows, so the window below is small
        return top.withColumn("rank", F.row_number().over(W.orderBy(*order)))
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def looked_up(scores: Callable[[frozenset[str] | None], DataFrame], wanted: DataFrame, on: list[str], score: str = "score") -> DataFrame:
    """The score of each wanted row, 0 where it has none; one row for each document with that id.

    Up to _KEYS distinct keys, counted first, go to where the scores are made:
    scores(keys) gives no others, so only what is asked for is joined.
    """
    key = on[-1]
    rows = wanted.select(key).distinct().limit(_KEYS + 1).collect()
    keys = frozenset(r[0] for r in rows if r[0] is not None) if len(rows) <= _KEYS else None
    return wanted.join(scores(keys).select(*on, score), on, "left").withColumn(score, F.coalesce(F.col(score), F.lit(0.0)))


def as_map(nested: DataFrame, key: str, score: str = "score") -> DataFrame:
    """(doc_id, scores): one map of key to score for each document, from its arrays."""
    return nested.select("doc_id", F.map_from_arrays(key, score).alias("scores"))


def rounded(column: str, digits: int = 6) -> Column:
    return F.round(F.col(column), digits)
