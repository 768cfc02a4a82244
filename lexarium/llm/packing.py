"""Packing token ids into rows of one length, best fit decreasing.

Documents longer than a row are split into pieces, and no token is lost. The
pieces of a chunk are placed from longest to shortest, each into the row whose
free room it fills best; a segment tree over capacities finds that row in
log2(length) steps. A partition packs by itself, in chunks of bounded size, so
nothing is shuffled and nothing grows with the input; each chunk leaves a few
rows that aren't full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.llm.common import spread

LENGTH = 2048
#: Fills what is left of a row; no token of the vocabulary has it.
PAD = 50256
#: Tokens that a task holds at most, besides one document.
CHUNK_TOKENS = 4_000_000

SCHEMA = "pack_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, doc_starts array<long>"


class CapacityTree:
    """Open rows by free room, 0 to ``most``: a segment tree whose nodes count the rows below them."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = self.size + room
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return the row with the least room that is enough, and its room."""
        count, at = self.count, self.size + need
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up, until the sibling on the right has rows
                at >>= 1
            if at <= 1:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return self.rows[room].pop(), room


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """The pieces (by place) of each row; every length is 1 to capacity."""
    tree, rows = CapacityTree(capacity), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = tree.take(lengths[k])
        if found is None:
            row, room = len(rows), capacity
            rows.append([])
        else:
            row, room = found
        rows[row].append(k)
        if room > lengths[k]:
            tree.add(room - lengths[k], row)
    return rows


def pieces(n: int, length: int) -> list[tuple[int, int]]:
    """Start and size of the pieces of a document of n tokens."""
    return [(at, min(length, n - at)) for at in range(0, n, length)]


def packed_rows(docs: list[tuple[int | None, np.ndarray]], length: int, pad: int) -> Iterator[tuple]:
    """n_tokens, ids, cu_seqlens, position_ids, doc_ids and doc_starts of each packed row."""
    parts = [(doc, at, ids[at : at + n]) for doc, ids in docs for at, n in pieces(len(ids), length)]
    for row in best_fit_decreasing([len(p[2]) for p in parts], length):
        ids, positions = np.full(length, pad, "<u4"), np.zeros(length, "<u4")
        ends = [0]
        for k in row:
            a, b = ends[-1], ends[-1] + len(parts[k][2])
            ids[a:b], positions[a:b] = parts[k][2], np.arange(b - a)
            ends.append(b)
        yield ends[-1], ids.tobytes(), ends, positions.tobytes(), [parts[k][0] for k in row], [parts[k][1] for k in row]


def pack(docs: DataFrame, encoder: Callable[[], Callable[[list], Iterable[bytes]]], length: int = LENGTH, pad: int = PAD, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row for each packed row of docs(doc_id, text, ...).

    encoder: makes, in a worker, what turns texts into little-endian unsigned
    32-bit ids. pack_id: the partition and the place in it. ids: ``length`` ids
    of 32 bits, padded at the end. cu_seqlens: where the segments end, from 0.
    position_ids: 32-bit positions that start again at 0 in each segment.
    doc_ids and doc_starts: each segment's document, and its first token there.

    Null and empty texts have no tokens and no segment; repeated rows are
    packed each; a null doc_id stays null in doc_ids; an empty table gives an
    empty result; further columns are ignored, whatever their names.
    """
    if length < 1:
        raise ValueError("length must be 1 or more")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first, made = encoder(), TaskContext.get().partitionId() << 40, 0
        held, room = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal made
            rows = []
            for row in packed_rows(held, length, pad):
                rows.append((first + made, *row))
                made += 1
                if len(rows) * length >= 1 << 20:
                    yield as_batch(rows)
                    rows = []
            if rows:
                yield as_batch(rows)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist())):
                    held.append((doc, np.frombuffer(ids, "<u4")))
                    room += len(ids) // 4
                    if room >= chunk_tokens:
                        yield from out()
                        held, room = [], 0
        yield from out()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(slim).mapInArrow(run, SCHEMA)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = ["pack_id", "n_tokens", "ids", "cu_seqlens", "position_ids", "doc_ids", "doc_starts"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
