"""Exact duplicates through mergeable counting quotient filters.

Every partition of the table builds counting quotient filters of the 64-bit
fingerprints of its texts, one for each block of the quotient space. The
filters of a block merge losslessly, because each holds its remainders sorted
under their quotients: the merge joins the sorted runs and adds the counts.
Only fingerprints with a merged count above one go on; their texts, and no
others, are grouped by their bytes, and the classes that this finds decide.

What is shuffled: filters, a slim row for each document, and one text per
class and partition for texts that have a copy (or share a filter bit with
one). A hot class is pre-aggregated before each shuffle, so no task gathers it.

Blocks, quotients and the route table are sized by the number of rows:
a merge holds about BLOCK_ROWS fingerprints whatever the input. Beyond some
2**(MOST_ROUTE_BITS - 4) repeated fingerprints the route table, whose size is
bounded, lets through more than it should, and texts without a copy are
shuffled with the others: that costs a shuffle of the texts and changes no
result.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarium.llm.common import BLANKS, counted, numbered, spread, without_rows, written

#: Fingerprints that a merge holds, about.
BLOCK_ROWS = 1 << 19
#: Least bits of a quotient: remainders are stored in 48 bits at most.
QUOTIENT_BITS = 16
#: 2**bits bits of route table, 16 for each repeated fingerprint within these bounds: at most 2**(MOST_ROUTE_BITS - 6) rows of 16 bytes are broadcast.
LEAST_ROUTE_BITS, MOST_ROUTE_BITS = 20, 26


def sizes(rows: int, partitions: int) -> tuple[int, int]:
    """(block bits, quotient bits): blocks of about BLOCK_ROWS fingerprints, and about a quotient for each fingerprint of a partition's filter."""
    blocks = min(24, max(4, ceil(log2(max(rows, 1) / BLOCK_ROWS + 1))))
    inside = ceil(log2(max(1, rows / max(partitions, 1) / (1 << blocks))))
    return blocks, max(QUOTIENT_BITS, blocks + inside)


class CountingQuotientFilter:
    """Counts of fingerprints of one block, as quotients and sorted remainders.

    ``occupied`` has a bit for each quotient that has a run, ``run_end`` a bit
    for each slot that ends one, ``slots`` the remainders in order, ``counted``
    a bit for each slot whose count is above one and ``counts`` those counts.
    """

    def __init__(self, quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray, bits: int):
        """Entries sorted by quotient and remainder, without repeats."""
        self.bits, self.n = bits, len(quotients)
        occupied = np.zeros(1 << bits, np.uint8)
        occupied[quotients] = 1
        self.occupied = np.packbits(occupied, bitorder="little")
        self.run_end = np.packbits(np.append(quotients[1:] != quotients[:-1], True)[: self.n], bitorder="little")
        self.slots = remainders.astype("<u8")
        self.counted = np.packbits(counts > 1, bitorder="little")
        self.counts = counts[counts > 1].astype("<u8")

    @classmethod
    def of(cls, local: np.ndarray, bits: int, remainder_bits: int, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """Filter of the fingerprints' lower bits: a quotient of ``bits`` over a remainder."""
        order = np.argsort(local, kind="stable")  # over sorted runs this is a merge
        local = local[order]
        first = np.flatnonzero(np.append(True, local[1:] != local[:-1])[: len(local)])
        weights = np.ones(len(local), np.uint64) if counts is None else counts[order].astype(np.uint64)
        total = np.add.reduceat(weights, first) if len(first) else weights
        local = local[first]
        mask = np.uint64((1 << remainder_bits) - 1)
        return cls((local >> np.uint64(remainder_bits)).astype(np.int64), local & mask, total, bits)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Quotients, remainders and counts, in order."""
        ends = np.unpackbits(self.run_end, count=self.n, bitorder="little").astype(np.int64)
        run = np.cumsum(ends) - ends
        quotients = np.flatnonzero(np.unpackbits(self.occupied, bitorder="little"))[run] if self.n else run
        counts = np.ones(self.n, np.uint64)
        counts[np.flatnonzero(np.unpackbits(self.counted, count=self.n, bitorder="little"))] = self.counts
        return quotients, self.slots, counts

    def to_bytes(self) -> bytes:
        six = self.slots.view(np.uint8).reshape(-1, 8)[:, :6]  # remainders have 48 bits at most
        return b"".join((struct.pack("<BII", self.bits, self.n, len(self.counts)), self.occupied.tobytes(), self.run_end.tobytes(), six.tobytes(), self.counted.tobytes(), self.counts.tobytes()))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        new = cls.__new__(cls)
        new.bits, new.n, more = struct.unpack_from("<BII", data)
        at = struct.calcsize("<BII")

        def take(n: int) -> np.ndarray:
            nonlocal at
            at += n
            return np.frombuffer(data, np.uint8, n, at - n)

        new.occupied, new.run_end = take(max(1, (1 << new.bits) // 8)), take((new.n + 7) // 8)
        slots = np.zeros((new.n, 8), np.uint8)
        slots[:, :6] = take(6 * new.n).reshape(-1, 6)
        new.slots = slots.reshape(-1).view("<u8")
        new.counted, new.counts = take((new.n + 7) // 8), take(8 * more).copy().view("<u8")
        return new

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter], remainder_bits: int) -> CountingQuotientFilter:
        """The filter of all entries together; no count is lost."""
        parts = [f.entries() for f in filters]
        local = np.concatenate([q.astype(np.uint64) << np.uint64(remainder_bits) | r for q, r, _ in parts])
        return cls.of(local, filters[0].bits, remainder_bits, np.concatenate([c for _, _, c in parts]))


def _build(block_bits: int, quotient_bits: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    low = 64 - block_bits

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column("fp").to_numpy(zero_copy_only=False) for b in batches if b.num_rows]
        if not held:
            return
        fps = np.sort(np.concatenate(held).astype(np.int64).view(np.uint64))
        blocks = (fps >> np.uint64(low)).astype(np.int64)
        starts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
        names, data = [], []
        for a, b in zip(starts, np.append(starts[1:], len(fps))):
            local = fps[a:b] & np.uint64((1 << low) - 1)
            names.append(int(blocks[a]))
            data.append(CountingQuotientFilter.of(local, quotient_bits - block_bits, 64 - quotient_bits).to_bytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary())], names=["block", "filter"])

    return run


def _merge(block_bits: int, quotient_bits: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        filters = [CountingQuotientFilter.from_bytes(x.as_py()) for x in group.column("filter")]
        q, r, n = CountingQuotientFilter.merged(filters, 64 - quotient_bits).entries()
        more = n > 1
        top = np.uint64(group.column("block")[0].as_py()) << np.uint64(64 - block_bits)
        fps = top | q[more].astype(np.uint64) << np.uint64(64 - quotient_bits) | r[more]
        return pa.table({"fp": pa.array(fps.view(np.int64)), "n": pa.array(n[more].astype(np.int64))})

    return run


def repeated_fingerprints(fps: DataFrame) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once in fps(fp), a written table: it is counted first."""
    bits = sizes(fps.count(), fps.rdd.getNumPartitions())
    filters = fps.select("fp").mapInArrow(_build(*bits), "block int, filter binary")
    return filters.groupBy("block").applyInArrow(_merge(*bits), "fp long, n long")


def normalised(text: str = "text") -> Column:
    """The text without blanks; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), f"[{BLANKS}]+", "")


def routed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of docs(fp, ...) whose fingerprint has its bit in the route table of wanted(fp), a written table.

    The table is a bitmap of 2**MOST_ROUTE_BITS bits at most, whatever the
    input; a bit that several fingerprints share only lets a row through that
    the exact steps after it sort out.
    """
    bits = min(MOST_ROUTE_BITS, max(LEAST_ROUTE_BITS, ceil(log2(16 * max(1, wanted.count())))))
    bit = F.col("fp").bitwiseAND(F.lit((1 << bits) - 1))
    word = F.shiftright(bit, 6)
    one = F.expr("shiftleft(1L, cast(__bit & 63 as int))")
    words = wanted.select(bit.alias("__bit")).groupBy(F.shiftright("__bit", 6).alias("__word")).agg(F.bit_or(one).alias("__bits"))
    marked = docs.withColumns({"__bit": bit, "__at": word}).join(F.broadcast(words), F.col("__at") == F.col("__word"))
    return marked.filter(F.col("__bits").bitwiseAND(one) != 0).drop("__bit", "__at", "__word", "__bits")


def _decided(source: DataFrame) -> DataFrame:
    """source(row, doc_id, text) to (row, doc_id, keep_id, group_size, kept, text_sha256)."""
    plain = source.select("row", "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), normalised().alias("norm"))
    fp = F.xxhash64("norm").alias("fp")
    rows = written(plain.select("row", "doc_id", "n_chars", fp, F.sha2("norm", 256).alias("sha")), "rows")
    repeated = written(repeated_fingerprints(rows).select("fp"), "repeated")
    texts = routed(plain.select("norm", fp), repeated).groupBy("fp", "norm").agg(F.count("*").alias("n_equal"))
    verified = texts.filter("n_equal > 1").select("fp", F.sha2("norm", 256).alias("sha"), "n_equal")
    first = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row")))
    # grouped at once, with partial sums: no step deals out a hot class's rows by its fingerprint
    classes = routed(rows, repeated).groupBy("fp", "sha").agg(F.count("*").alias("n"), first.alias("first")).filter("n > 1")
    odd = F.raise_error(F.lit("texts with equal SHA-256 differ in their bytes"))
    classes = classes.join(verified, ["fp", "sha"], "left").select("fp", "sha", F.when(F.col("n") == F.col("n_equal"), F.col("n")).otherwise(odd.cast("long")).alias("n"), F.col("first.id").alias("id"), F.col("first.row").alias("first_row"))
    classes = written(classes, "classes")  # so that both sides of the last join are plain exchanges, and a hot class can be split
    found = rows.join(classes, ["fp", "sha"], "left")
    alone = F.col("n").isNull()
    return found.select(
        "row",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs(doc_id, text, ...).

    Texts are equal when they are so after all blanks are deleted. Of equal
    texts the row with the most code points in its original text stays, then
    the one with the smallest doc_id.

    Null and empty texts are equal to each other and to texts of blanks only.
    A null doc_id ranks after all others. Of repeated rows (same doc_id and
    text) just one is kept. An empty table gives an empty result; further
    columns of docs are ignored, whatever their names.
    """
    source = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return _decided(source.withColumn("row", counted())).drop("row")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The columns and rows of docs with one row of each class of equal texts.

    Rows are named by their place in the table, so those without a doc_id, and those
    that share one, are each decided on by their own text.
    """
    named, row = numbered(docs, "numbered")
    decided = _decided(named.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return without_rows(named, row, decided.filter("not kept").select(F.col("row").alias(row)))
