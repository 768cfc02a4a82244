"""Near copies by SimHash over the set of word shingles, verified exactly.

Two texts are linked when their sets of five-word shingles have a Jaccard
similarity of 0.8 or more; a text of fewer words is one shingle. At 0.8 the
sets' cosine is 0.89 at least, so a bit of their SimHash differs with
probability 0.152 at most. 64 bits are too few to tell that from chance, so
the fingerprint has ``WORDS`` times 64, and the steps are those of simhash_grid
at a wider distance:

* each segment of two bits is replaced by its number of set bits;
* a grid's cell is the counts of some segments drawn at random. How many is
  chosen by the number of distinct sets, and then as many grids are laid as
  leave a pair at exactly 0.8 without a common cell with probability ``MISSED``;
* within a cell, fingerprints are candidates where the Manhattan distance of
  the counts, a lower bound, and then the Hamming distance of the first
  ``COMPARED`` words are ``DISTANCE`` or less, 5.4 standard deviations above
  the mean of a pair at 0.8 and 5.8 below that of unlike texts;
* of a few shingles the sums behind the bits are coarse, and a set of four and one
  of five differ more often. Up to ``FEW`` shingles such a pair is a set and the
  same set without one shingle, which are met by these sets' own hashes;
* the components of the candidates are clusters: any link lies within one. A
  cluster's texts meet once, and their whole sets decide on each link.

Equal sets count once. Only texts in a cluster of two sets or more are
shuffled. In a cell and in a cluster alike, links are followed from member to
member against those not yet reached, so a dense one costs little more than one
look at each; above ``GRID_ROWS`` and ``cell_rows`` members they are cut into
blocks that share pivots, and whoever the pivots don't join meets every block
(see simhash_grid), so that none is capped and no link is lost.

Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.llm.common import ROW, counted, met, numbered, spread, without_rows, written
from lexarium.llm.exact_cqf import routed
from lexarium.llm.simhash_grid import components, in_blocks, rest_in_blocks, unary_counts_of, with_least

SEED = 42
SHINGLE = 5
SIMILARITY = 0.8
#: Words of a fingerprint, those of them that cells compare, and the most bits at which these differ in a candidate.
WORDS, COMPARED, DISTANCE = 12, 3, 56
#: The same for the first of them alone, which is looked at first: 5 standard deviations above the mean.
FIRST_DISTANCE = 24
SEGMENTS = 32 * WORDS
#: The probability that a pair at exactly SIMILARITY shares no cell.
MISSED = 3e-5
#: Segments that a grid may draw, and what a row of a cell costs against one comparison within it; rows also take disk.
DRAWN, ROW_COST = range(4, 13), 5_000
#: Shingles up to which a set also meets those that it holds but for one shingle.
FEW = 8
#: Members from which a cell of a grid is cut into blocks.
GRID_ROWS = 1 << 15
_CHUNK = 255  # rows of bits that a byte can count
_FRONT = 32
_r = np.random.default_rng(SEED)
_FACTORS = _r.integers(0, 1 << 63, (1, WORDS), np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _r.integers(0, 1 << 64, (1, WORDS), np.uint64)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of the text's shingles; none for a null text or one without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    view, digest = memoryview(line), xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.unique(np.fromiter((digest(view[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1))


def set_key(items: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(items.tobytes(), SEED)


def without_one(items: np.ndarray) -> list[int]:
    """The keys of a set of few items and of all that it leaves without one of them; none for a larger one."""
    if not 0 < len(items) <= FEW:
        return []
    return [set_key(items), *(set_key(np.delete(items, k)) for k in range(len(items)) if len(items) > 1)]


def fingerprint(items: np.ndarray) -> np.ndarray:
    """The SimHash of a set, as WORDS words: a bit is 1 where it is in over half of the items' hashes."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(items), _CHUNK):
        mixed = items[at : at + _CHUNK, None] * _FACTORS + _SHIFTS
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _FACTORS
        mixed ^= mixed >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(items), bitorder="little").view(np.uint64)


@lru_cache
def grids_for(drawn: int, missed: float = MISSED) -> int:
    """The fewest grids of so many segments that leave a pair at SIMILARITY without a common cell with probability ``missed`` at most.

    Of the pair's segments a binomial number agree in their counts; a grid's segments all have to be among them.
    """
    differs = float(np.arccos(2 * SIMILARITY / (1 + SIMILARITY)) / np.pi)
    same = (1 - differs) ** 2 + differs**2 / 2
    agree = range(SEGMENTS + 1)
    share = np.array([comb(SEGMENTS, k) * same**k * (1 - same) ** (SEGMENTS - k) for k in agree])
    met = np.array([comb(k, drawn) / comb(SEGMENTS, drawn) for k in agree])
    grids = 1
    while float((share * (1 - met) ** grids).sum()) > missed:
        grids += 1
    return grids


def drawn_for(rows: int) -> int:
    """The number of segments with the least work for so many sets: rows of cells and comparisons within them."""
    return min(DRAWN, key=lambda s: grids_for(s) * (ROW_COST + rows / 2 * 0.375**s))


def grids(drawn: int) -> np.ndarray:
    """The segments of each grid."""
    r = np.random.default_rng(SEED)
    return np.array([r.choice(SEGMENTS, drawn, replace=False) for _ in range(grids_for(drawn))])


def cells(fps: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """The cell of each fingerprint in each grid: the grid and the counts of its segments, as one number."""
    unary = unary_counts_of(fps)
    bits = np.unpackbits(np.ascontiguousarray(unary).view(np.uint8).reshape(len(fps), 8 * WORDS), axis=1, bitorder="little")
    counts = (bits[:, ::2] + bits[:, 1::2]).astype(np.int64)
    places = 3 ** np.arange(grid.shape[1], dtype=np.int64)
    return counts[:, grid] @ places + np.arange(len(grid)) * 3 ** grid.shape[1]


def candidate_forest(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect just what all candidates among the members of a cell connect, as two arrays of keys; fps has the compared words.

    Members not yet reached are taken up some at a time, as most are strangers to all others.
    """
    unary = unary_counts_of(fps)
    rest, a, b = np.arange(len(keys)), [], []

    def near(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in x and y of the candidates: the first word, then the Manhattan bound, then the exact distance."""
        i, j = np.nonzero(np.bitwise_count(fps[x, 0][:, None] ^ fps[y, 0][None, :]) <= FIRST_DISTANCE)
        for words in (unary, fps):
            kept = np.bitwise_count(words[x[i]] ^ words[y[j]]).sum(axis=1, dtype=np.int64) <= DISTANCE
            i, j = i[kept], j[kept]
        return i, j

    while len(rest) > 1:
        frontier, rest = rest[:_FRONT], rest[_FRONT:]
        i, j = near(frontier, frontier)
        a.append(keys[frontier[i[i < j]]])
        b.append(keys[frontier[j[i < j]]])
        while len(frontier) and len(rest):
            part, frontier = frontier[:_FRONT], frontier[_FRONT:]
            i, j = near(part, rest)
            if len(j):
                j, first = np.unique(j, return_index=True)
                a.append(keys[part[i[first]]])
                b.append(keys[rest[j]])
                frontier = np.concatenate((frontier, rest[j]))
                rest = np.delete(rest, j)
    empty = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _sketch_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.int64())
    for batch in batches:
        keys, found, few = np.empty(batch.num_rows, np.uint64), [], []
        for k, x in enumerate(batch.column("text")):
            items = shingle_set(x.as_py())
            keys[k] = set_key(items)
            found.append(fingerprint(items).tobytes())
            few.append(np.array(without_one(items), np.uint64).view(np.int64))
        columns = [pa.array(keys.view(np.int64)), pa.array(found, pa.binary()), pa.array(few, kind)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("text_key"), *columns], names=["row", "doc_id", "text_key", "key", "fp", "few"])


def _cell_batches(drawn: int):
    """Batches of (key, fp) to (cell, key, the compared words), a row for each grid."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = grids(drawn)
        names = ["cell", "key", *_compared()]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fps = np.frombuffer(b"".join(part.column("fp").to_pylist()), np.uint64).reshape(-1, WORDS)
                repeated = [part.column("key").to_numpy(zero_copy_only=False), *fps[:, :COMPARED].view(np.int64).T]
                yield pa.RecordBatch.from_arrays([pa.array(cells(fps, grid).reshape(-1)), *[pa.array(np.repeat(c, len(grid))) for c in repeated]], names=names)

    return run


def _compared() -> list[str]:
    return [f"w{k}" for k in range(COMPARED)]


def _candidate_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of the cells, whose rows come one after another."""
    held = [np.empty(0, np.int64)] * (2 + COMPARED)

    def out(columns: list[np.ndarray]) -> pa.RecordBatch:
        cell, key, fps = columns[0], columns[1], np.stack(columns[2:], axis=1).view(np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        made = [candidate_forest(key[s:e], fps[s:e]) for s, e in zip(starts, np.append(starts[1:], len(cell))) if e - s > 1]
        a, b = (np.concatenate([np.empty(0, np.int64), *side]) for side in zip(*made)) if made else (np.empty(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for batch in batches:
        held = [np.concatenate((h, batch.column(c).to_numpy(zero_copy_only=False))) for h, c in zip(held, ["cell", "key", *_compared()])]
        whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last cell may go on
        if whole:
            yield out([h[:whole] for h in held])
            held = [h[whole:] for h in held]
    if len(held[0]):
        yield out(held)


def candidates(distinct: DataFrame, drawn: int | None = None, grid_rows: int = GRID_ROWS) -> DataFrame:
    """(a, b), a < b: of distinct(key, fp, few), pairs whose components hold every pair that shares a cell and is near there, and those of few shingles."""
    rows = distinct.count()
    drawn = drawn or drawn_for(rows)
    few = with_least(distinct.select("key", F.explode("few").alias("cell")), "cell", "key", rows).select(F.col("m").alias("a"), F.col("key").alias("b")).filter("a <> b").distinct()
    dealt = distinct.select("key", "fp").mapInArrow(_cell_batches(drawn), "cell long, key long, " + ", ".join(f"{w} long" for w in _compared()))
    hot = written(dealt.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > grid_rows), "hot")

    def found(searched: DataFrame) -> DataFrame:
        ordered = searched.select("cell", "key", *_compared()).repartition("cell").sortWithinPartitions("cell")
        return ordered.mapInArrow(_candidate_batches, "a long, b long").distinct()

    if hot.isEmpty():
        return written(found(dealt).union(few), "candidates")
    first = written(found(in_blocks(dealt.join(F.broadcast(hot), "cell", "left"), "key", grid_rows, *_compared())).union(few), "candidates")
    rest = rest_in_blocks(dealt.join(F.broadcast(hot), "cell"), components(first), "key", grid_rows, *_compared())
    return written(first.union(found(rest)), "candidates")


def _set_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            sets = [shingle_set(x.as_py()) for x in batch.column("text")[at : at + 512]]
            keys = np.fromiter(map(set_key, sets), np.uint64, len(sets))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "items"])


def cell_forest(keys: np.ndarray, sets: list, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among the distinct sets of one cell, as two arrays of keys."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    items, place = np.unique(np.concatenate(sets), return_inverse=True) if sizes.sum() else (np.empty(0, np.uint64), np.empty(0, np.int64))
    own = np.split(place, np.cumsum(sizes)[:-1])
    marks = np.zeros(len(items), np.int64)
    rest, a, b = np.arange(len(keys)), [], []
    while len(rest) > 1:
        frontier, rest = [int(rest[0])], rest[1:]
        held, owner = np.concatenate([own[k] for k in rest]), np.repeat(np.arange(len(rest)), sizes[rest])
        while frontier and len(rest):
            one = frontier.pop()
            marks[own[one]] = 1
            common = np.bincount(owner, weights=marks[held], minlength=len(rest))
            marks[own[one]] = 0
            whole = sizes[one] + sizes[rest] - common
            near = common >= similarity * whole - 1e-9
            if near.any():
                a.append(np.full(int(near.sum()), keys[one]))
                b.append(keys[rest[near]])
                frontier += rest[near].tolist()
                stays = ~near[owner]
                held, rest = held[stays], rest[~near]
                owner = (np.cumsum(~near) - 1)[owner[stays]]
    empty = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _cell_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the cells, whose rows come one after another."""
    cell, keys, sets = None, [], []

    def out() -> Iterator[pa.RecordBatch]:
        if len(keys) > 1:
            a, b = cell_forest(np.array(keys, np.int64), sets)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for batch in batches:
        for c, k, x in zip(batch.column("cell").to_pylist(), batch.column("key").to_pylist(), batch.column("items")):
            if c != cell:
                yield from out()
                cell, keys, sets = c, [], []
            keys.append(k)
            sets.append(np.frombuffer(x.as_py(), np.uint64))
    yield from out()


def _members(source: DataFrame, cell_rows: int, grid_rows: int = GRID_ROWS) -> tuple[DataFrame, DataFrame]:
    """source(row, doc_id, text) to (row, doc_id, key) of every row, and (key, root) of every set."""
    slim = source.withColumn("text_key", F.xxhash64("text"))
    rows = written(slim.mapInArrow(_sketch_batches, f"{ROW}, doc_id long, text_key long, key long, fp binary, few array<long>"), "sketches")
    distinct = written(rows.groupBy("key").agg(F.min("text_key").alias("text_key"), F.min("fp").alias("fp"), F.min("few").alias("few")), "sets")
    clusters = components(candidates(distinct, grid_rows=grid_rows))
    clusters = written(clusters.union(clusters.select("root", "root").distinct()), "clusters")
    large = written(clusters.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > cell_rows), "large")
    dealt = written(met(clusters, large, "root", "left").select(F.col("node").alias("key"), F.col("root").alias("cell"), "n"), "members")

    def found(searched: DataFrame) -> DataFrame:
        """The links within the cells of searched(cell, key)."""
        wanted = written(distinct.join(searched.select("key").distinct(), "key", "left_semi").select(F.col("text_key").alias("fp")), "wanted")
        texts = routed(slim.select("text", F.col("text_key").alias("fp")), wanted).select("text")
        sets = texts.mapInArrow(_set_batches, "key long, items binary").groupBy("key").agg(F.first("items").alias("items"))
        ordered = searched.join(sets, "key").repartition("cell").sortWithinPartitions("cell")
        return written(ordered.mapInArrow(_cell_links, "a long, b long").distinct(), "cell_links")

    edges = found(in_blocks(dealt, "key", cell_rows))
    roots = components(edges)
    large = dealt.filter("n is not null")
    if not large.isEmpty():
        rest = written(rest_in_blocks(large, roots, "key", cell_rows), "rest")
        if not rest.isEmpty():
            roots = components(edges.union(found(rest)))
    return rows.select("row", "doc_id", "key"), distinct.select("key").join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("root"))


def _decided(source: DataFrame, cell_rows: int = 512) -> DataFrame:
    """source(row, doc_id, text) to (row, doc_id, component_id, first_row) of every row."""
    rows, rooted = _members(source, cell_rows)
    least = lambda none, id, row: F.min(F.struct(none.alias("none"), id.alias("id"), row.alias("row")))
    of_set = written(rows.groupBy("key").agg(least(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")).alias("first")).join(rooted, "key"), "rooted")
    of_root = of_set.groupBy("root").agg(F.min("first").alias("first"))
    named = written(of_set.select("key", "root").join(of_root, "root").select("key", F.col("first.id").alias("component_id"), F.col("first.row").alias("first_row")), "components")
    return rows.join(named, "key").select("row", "doc_id", "component_id", "first_row")


def near_copies(docs: DataFrame, cell_rows: int = 512) -> DataFrame:
    """(doc_id, component_id) of every row of docs(doc_id, text, ...).

    component_id is the smallest doc_id reachable over links, the row itself
    included.

    Null, empty and blank texts have the empty set and link to each other; a
    null doc_id takes part and is never a component_id unless its component has
    no other; repeated rows stay repeated; an empty table gives an empty
    result; further columns of docs are ignored, whatever their names.
    """
    slim = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return _decided(slim.withColumn("row", counted()), cell_rows).select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The columns and rows of docs with one row of each component: the one with the smallest doc_id.

    Rows are named by their place in the table, so those without a doc_id, and those
    that share one, are each decided on by their own text.
    """
    named, row = numbered(docs, "numbered")
    decided = _decided(named.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return without_rows(named, row, decided.filter(F.col("row") != F.col("first_row")).select(F.col("row").alias(row)))
