"""SimHash near-duplicates by a grid over per-segment bit counts.

A 64-bit fingerprint is cut into 32 segments of two bits and each segment is
replaced by its number of set bits. Flipping one bit of a fingerprint moves
one count by one, so the Manhattan distance of the count vectors is never
above the Hamming distance of the fingerprints. The counts are kept in unary
(0 -> 00, 1 -> 01, 2 -> 11), so that the whole vector is one 64-bit number
and the Manhattan distance of two vectors is the bit count of their xor.

The grid: the 32 segments form g groups. Vectors at distance 3 or less differ
in three groups at most, so they agree on g - 3 groups or more and share a
cell of one of the grids that are laid over every choice of g - 3 groups. A
range-join over the cells finds all pairs within the distance; the lower
bound is tested first and the Hamming distance after it. g follows from the
number of distinct fingerprints: with five groups a cell agrees on about 18
bits, with seven on 26, with ten on 32, at the price of more grids.

A cell never expands into all its pairs: the links of a cell are followed from
fingerprint to fingerprint against those not yet reached, and only a spanning
forest leaves it.

Cells above ``cell_rows`` members are cut into blocks, so no task holds an
unbounded cell. Each block also gets the cell's pivots, a few members that all
blocks share: within a dense group nearly all members link to one, so one pass
that is linear in the cell joins them. Then each member outside the cell's
largest component meets every block. A link that was missed joins two
components, so one of its ends is such a member: none is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarium.llm.common import ROW, counted, numbered, spread, without_rows, written

SEED = 42
SHINGLE = 3
DISTANCE = 3
GROUPS = (5, 6, 7, 8, 9, 10)
#: What a row of a cell costs against one comparison within it.
ROW_COST = 1000
#: Edges of a node from which it counts as a hub, in a small graph.
HUB = 512
_LOW = 0x5555555555555555
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned SimHash of a text; 0 for a null text or one without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    view, digest = memoryview(line), xxhash.xxh64_intdigest
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    ones, n = np.zeros(64, np.int64), len(first)
    for at in range(0, n, _CHUNK):
        hashes = np.array([digest(view[a:b], SEED) for a, b in zip(first[at : at + _CHUNK], last[at : at + _CHUNK])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(x.as_py()) for x in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(values.view(np.int64))], names=["row", "doc_id", "fp"])


def fingerprints(source: DataFrame) -> DataFrame:
    """(row, doc_id, fp) of every row of source(row, doc_id, text); fp is the 64 bits as a signed long."""
    return source.select("row", "doc_id", "text").mapInArrow(_fingerprint_batches, f"{ROW}, doc_id long, fp long")


def unary_counts(fp: Column) -> Column:
    """The 32 bit counts of a fingerprint, in unary, as one long."""
    other = F.shiftrightunsigned(fp, 1)
    low, high = fp.bitwiseOR(other).bitwiseAND(F.lit(_LOW)), fp.bitwiseAND(other).bitwiseAND(F.lit(_LOW))
    return low.bitwiseOR(F.shiftleft(high, 1))


def unary_counts_of(fp: np.ndarray) -> np.ndarray:
    other, low = fp >> np.uint64(1), np.uint64(_LOW)
    return ((fp | other) & low) | (((fp & other) & low) << np.uint64(1))


def groups_for(rows: int, distance: int = DISTANCE) -> int:
    """The number of groups with the least work for so many distinct fingerprints: rows of cells and comparisons within them.

    Two random counts of two bits agree with probability 3/8.
    """
    work = lambda g: comb(g, distance) * (ROW_COST + rows / 2 * 0.375 ** (32 * (g - distance) / g))
    return min(GROUPS, key=work)


def grid_masks(groups: int = GROUPS[0], distance: int = DISTANCE) -> list[int]:
    """One signed mask for each grid: the groups on which a cell's members agree."""
    edges = [round(32 * g / groups) for g in range(groups + 1)]
    parts = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:])]
    masks = [reduce(int.__or__, chosen) for chosen in combinations(parts, groups - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _near(one: np.ndarray, many: np.ndarray, one_u: np.ndarray, many_u: np.ndarray, distance: int) -> np.ndarray:
    """Matrix of the links; the Manhattan bound first, then the exact distance where it holds."""
    near = np.bitwise_count(one_u[:, None] ^ many_u[None, :]) <= distance
    rows, cols = np.nonzero(near)
    near[rows, cols] = np.bitwise_count(one[rows] ^ many[cols]) <= distance
    return near


def cell_forest(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among the fingerprints of one cell.

    Each step links a part of the frontier with what isn't reached yet, so a
    dense cell costs little more than one look at each member.
    """
    unary = unary_counts_of(fps)
    rest = np.arange(len(fps))
    a, b = [], []
    while len(rest) > 1:
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            part, frontier = frontier[:32], frontier[32:]
            near = _near(fps[part], fps[rest], unary[part], unary[rest], distance)
            found = near.any(axis=0)
            if found.any():
                a.append(fps[part[near[:, found].argmax(axis=0)]])
                b.append(fps[rest[found]])
                frontier = np.concatenate((frontier, rest[found]))
                rest = rest[~found]
    empty = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _links_of(keys: np.ndarray, fps: np.ndarray, distance: int, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole, sorted cells."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = [], []
    unary = unary_counts_of(fps)
    few = np.repeat(sizes <= small, sizes)
    for lag in range(1, min(small, int(sizes.max(initial=1)))):
        same = np.flatnonzero((keys[lag:] == keys[:-lag]) & few[lag:])
        same = same[np.bitwise_count(unary[same] ^ unary[same + lag]) <= distance]
        same = same[np.bitwise_count(fps[same] ^ fps[same + lag]) <= distance]
        a.append(fps[same])
        b.append(fps[same + lag])
    for k in np.flatnonzero(sizes > small):
        x, y = cell_forest(np.unique(fps[starts[k] : starts[k] + sizes[k]]), distance)
        a.append(x)
        b.append(y)
    empty = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _cell_links(distance: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def out(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = _links_of(keys, fps, distance)
            a, b = a.view(np.int64), b.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            held_k = np.concatenate((held_k, batch.column("cell").to_numpy(zero_copy_only=False)))
            held_f = np.concatenate((held_f, batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
            whole = int(np.searchsorted(held_k, held_k[-1])) if len(held_k) else 0  # the last cell may go on
            if whole:
                yield out(held_k[:whole], held_f[:whole])
                held_k, held_f = held_k[whole:], held_f[whole:]
        if len(held_k):
            yield out(held_k, held_f)

    return run


def in_blocks(members: DataFrame, key: str, cell_rows: int, *more: str) -> DataFrame:
    """members(cell, key, n) to (key, more, cell): a cell as it is where n is null, else its blocks, each with the cell's pivots."""
    blocks = F.ceil(F.col("n") / F.lit(cell_rows // 2)).cast("int")
    own = F.pmod(F.xxhash64(F.lit("block"), key), blocks).cast("int")
    pivot = F.pmod(F.xxhash64(F.lit("pivot"), "cell", key), F.col("n")) < max(1, cell_rows // 64)
    every = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.xxhash64("cell", j))
    return members.select(key, *more, F.explode(F.when(F.col("n").isNull(), F.array("cell")).when(pivot, every).otherwise(F.array(F.xxhash64("cell", own)))).alias("cell"))


def rest_in_blocks(members: DataFrame, roots: DataFrame, key: str, cell_rows: int, *more: str) -> DataFrame:
    """members(cell, key, n) of large cells and the roots(node, root) found so far to (key, more, cell): whoever isn't in the cell's largest component with each of the cell's blocks."""
    rooted = members.join(roots.withColumnRenamed("node", key), key, "left").select("cell", key, *more, "n", F.coalesce("root", key).alias("root"))
    sizes = rooted.groupBy("cell", "root").agg(F.count("*").alias("own"))
    largest = sizes.groupBy("cell").agg(F.max_by("root", F.struct("own", "root")).alias("largest"), (F.sum("own") - F.max("own")).alias("rest")).filter("rest > 0")
    met = rooted.join(largest, "cell")
    half = F.lit(cell_rows // 2)
    blocks, rests = F.ceil(F.col("n") / half).cast("int"), F.ceil(F.col("rest") / half).cast("int")
    block, rest = F.pmod(F.xxhash64(F.lit("block"), key), blocks).cast("int"), F.pmod(F.xxhash64(F.lit("rest"), key), rests).cast("int")
    as_member = F.transform(F.sequence(F.lit(0), rests - 1), lambda r: F.xxhash64(F.lit("rest"), "cell", block, r))
    as_rest = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.xxhash64(F.lit("rest"), "cell", j, rest))
    return met.select(key, *more, F.explode(F.when(F.col("root") == F.col("largest"), as_member).otherwise(F.array_union(as_member, as_rest))).alias("cell"))


def links(distinct: DataFrame, distance: int = DISTANCE, groups: int | None = None, cell_rows: int = 2048) -> DataFrame:
    """(a, b), a < b: links that connect just what all pairs within the distance connect.

    distinct: one column fp without repeats; it is counted to choose the groups.
    """
    groups = groups or groups_for(distinct.count(), distance)
    unary = unary_counts(F.col("fp"))
    cells = distinct.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(t), unary.bitwiseAND(F.lit(m).cast("long"))) for t, m in enumerate(grid_masks(groups, distance))])).alias("cell"))
    hot = written(cells.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > cell_rows), "hot")

    def found(dealt: DataFrame) -> DataFrame:
        ordered = dealt.repartition("cell").sortWithinPartitions("cell")
        return ordered.mapInArrow(_cell_links(distance), "a long, b long").distinct()

    first = found(in_blocks(cells.join(hot, "cell", "left"), "fp", cell_rows))
    if hot.isEmpty():
        return first
    first = written(first, "first_links")
    return first.union(found(rest_in_blocks(cells.join(hot, "cell"), components(first), "fp", cell_rows)))


def with_least(e: DataFrame, key: str, other: str, rows: int, hub: int = HUB) -> DataFrame:
    """e(key, other) with m, the least ``other`` of each key. e has about so many rows.

    A hub, a key of many rows, would be one task of the join. Hubs are 2**12 at
    most, so they are broadcast with their m, and only the rows of other keys
    are joined by a shuffle.
    """
    low = e.groupBy(key).agg(F.min(other).alias("m"), F.count("*").alias("n"))
    limit = max(hub, rows >> 12)
    hubs = F.broadcast(low.filter(F.col("n") > limit).select(key, "m"))
    rest = e.join(hubs.select(key), key, "left_anti").join(low.filter(F.col("n") <= limit).select(key, "m"), key)
    return rest.unionByName(e.join(hubs, key))


def components(edges: DataFrame, most_rounds: int = 60, hub: int = HUB) -> DataFrame:
    """(node, root): the smallest node that is reachable, for nodes with an edge.

    Alternates the large-star and small-star steps until nothing changes; each
    round is written to the shared folder. Only two numbers reach the driver
    in a round.
    """

    def large_star(e: DataFrame, rows: int) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        return with_least(both, "a", "b", 2 * rows, hub).filter("b > a").select(F.least("a", "m").alias("a"), "b").filter("a <> b").distinct()

    def small_star(e: DataFrame, rows: int) -> DataFrame:
        met = with_least(e, "b", "a", rows, hub)
        return met.select(F.col("m").alias("a"), F.col("a").alias("b")).union(met.select(F.col("m").alias("a"), "b")).filter("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = written(edges.filter("a <> b"), "links")
    was = state(edges)
    for _ in range(most_rounds):
        if not was[0]:
            break
        edges = written(small_star(written(large_star(edges, was[0]), "large_stars"), was[0]), "stars")
        now = state(edges)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _decided(source: DataFrame, distance: int) -> DataFrame:
    """source(row, doc_id, text) to (row, doc_id, fp, component_id, first_row) of every row."""
    rows = written(fingerprints(source), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row")))
    distinct = written(rows.groupBy("fp").agg(first.alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), distance))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = written(rooted.drop("first").join(lowest, "root").select("fp", F.col("first.id").alias("component_id"), F.col("first.row").alias("first_row")), "components")
    return rows.join(named, "fp").select("row", "doc_id", "fp", "component_id", "first_row")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs(doc_id, text, ...).

    component_id is the smallest doc_id reachable over links of fingerprints
    that differ in ``distance`` bits or fewer, the row itself included.

    Null and empty texts have fingerprint 0 and link like any other; a null
    doc_id takes part and is never a component_id unless its component has no
    other; repeated rows stay repeated; an empty table gives an empty result;
    further columns of docs are ignored, whatever their names.
    """
    slim = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return _decided(slim.withColumn("row", counted()), distance).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The columns and rows of docs with one row of each component: the one with the smallest doc_id.

    Rows are named by their place in the table, so those without a doc_id, and those
    that share one, are each decided on by their own text.
    """
    named, row = numbered(docs, "numbered")
    decided = _decided(named.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), distance)
    return without_rows(named, row, decided.filter(F.col("row") != F.col("first_row")).select(F.col("row").alias(row)))
