"""Quality rules, and an isolation forest over their statistics.

Each text gets the statistics of the rules. Base rules reject by fixed limits;
the forest looks for what no single limit shows. Its trees split on random
statistics at random places, so an unusual document is alone after few splits:
a short mean path marks an anomaly. One forest sees all statistics and one
each of them alone. A tree of an isolation forest is by definition grown on a
few rows, ``TREE_ROWS``; each draws its own from all documents that pass the
base rules. The path length below which a forest rejects is calibrated on all
labelled rows that pass them, forest by forest, so one that only finds harmless
oddities rejects nothing: rows of equal path are counted together, and the cuts
are tried within buckets of path lengths, whose running sums meet on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexarium.llm.common import least_rows, met, spread, written

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent
#: Rows that each tree draws, and trees of a forest.
TREE_ROWS, TREES = 256, 50
#: Buckets of path lengths to a unit; a path is some 3 units at most, whatever the table.
BUCKETS = 4096
#: Share of good documents that a calibrated threshold may reject at most.
GOOD_LOST = 0.001
#: The features that each forest sees, by their place in features().
VIEWS = ((0, 1, 2, 3), (0,), (1,), (2,), (3,))
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list, window: int = REPEAT_WINDOW) -> int:
    """Words inside a window that stands twice or more in the text, the first place included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    if len(ids) == len(words):
        return 0
    hashes = np.zeros(n, np.uint64)
    for k in range(window):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + (codes[k : k + n] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        hashes ^= hashes >> np.uint64(29)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return 0
    alike = np.zeros(n, bool)
    alike[order[1:][same]] = alike[order[:-1][same]] = True
    places: dict = {}
    for at in np.flatnonzero(alike).tolist():  # equal hashes only suggest; the words decide
        places.setdefault(codes[at : at + window].tobytes(), []).append(at)
    edge = np.zeros(len(words) + 1, np.int64)
    for found in places.values():
        if len(found) > 1:
            np.add.at(edge, found, 1)
            np.add.at(edge, np.array(found) + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; zeros for null."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    seen: set = set()
    twice = 0
    for line in text.split("\n"):
        if line.strip(" \t\v\f\r"):
            twice += line in seen
            seen.add(line)
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), twice, repeated_words(words)


def _statistics_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(x.as_py()) for x in batch.column("text")], np.int64).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in rows.T)], names=["doc_id", *STATISTICS])


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the five statistics and base_failed of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = spread(slim).mapInArrow(_statistics_batches, "doc_id long, " + ", ".join(f"{s} long" for s in STATISTICS))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def features(stats: np.ndarray) -> np.ndarray:
    """What the trees split on: the statistics as rates."""
    words, chars, symbols, lines, repeats = stats.astype(np.float64).T
    n = np.maximum(words, 1)
    return np.stack((chars / n, symbols / n, np.log1p(lines), repeats / n), axis=1)


class IsolationForest:
    """Trees as arrays: feature (-1 at a leaf), cut, and the left child; the right child follows it."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], rows: int):
        self.trees, self.norm = trees, mean_path(rows)

    @classmethod
    def grow(cls, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 11) -> IsolationForest:
        random = np.random.default_rng(seed)
        rows = min(rows, len(x))
        deepest = math.ceil(math.log2(max(rows, 2)))
        if len(x) >= trees * rows:  # enough for each tree to have rows of its own
            drawn = iter(random.permutation(len(x))[: trees * rows].reshape(trees, rows))
        else:
            drawn = (random.choice(len(x), rows, replace=False) for _ in range(trees))
        return cls([_tree(x[own], deepest, random) for own in drawn], rows)

    def path_lengths(self, x: np.ndarray) -> np.ndarray:
        """The mean path of each row over the trees, as a share of the usual one."""
        total = np.zeros(len(x))
        for feature, cut, left, depth in self.trees:
            at = np.zeros(len(x), np.int32)
            while True:
                going = np.flatnonzero(feature[at] >= 0)
                if not len(going):
                    break
                node = at[going]
                at[going] = left[node] + (x[going, feature[node]] >= cut[node])
            total += depth[at]
        return total / len(self.trees) / self.norm


def mean_path(n: int) -> float:
    """The mean path of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _tree(x: np.ndarray, deepest: int, random: np.random.Generator) -> tuple[np.ndarray, ...]:
    feature, cut, left, depth = [-1], [0.0], [0], [0.0]
    open_nodes = [(0, x, 0)]
    while open_nodes:
        node, rows, level = open_nodes.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        varied = np.flatnonzero(high > low)
        if level >= deepest or len(rows) < 2 or not len(varied):
            depth[node] = level + mean_path(len(rows))
            continue
        f = int(random.choice(varied))
        feature[node], cut[node], left[node] = f, float(random.uniform(low[f], high[f])), len(feature)
        if cut[node] <= low[f]:
            cut[node] = float(high[f])
        right = rows[:, f] >= cut[node]
        for part in (rows[~right], rows[right]):
            open_nodes.append((len(feature), part, level + 1))
            feature.append(-1), cut.append(0.0), left.append(0), depth.append(0.0)
    return np.array(feature, np.int32), np.array(cut), np.array(left, np.int32), np.array(depth)


def calibrated(paths: np.ndarray, good: np.ndarray, lost: float = GOOD_LOST) -> float:
    """The path length that parts good rows from bad ones best, rejecting at most a share ``lost`` of good rows.

    Rows with a shorter path are rejected. 0, which rejects nothing, where a class is missing.
    """
    n_good, n_bad = int(good.sum()), int((~good).sum())
    if not n_good or not n_bad:
        return 0.0
    order = np.argsort(paths, kind="stable")
    p, g = paths[order], good[order]
    lost_good, caught = np.cumsum(g), np.cumsum(~g)
    ends = np.append(p[1:] > p[:-1], True)
    gain = np.where(ends & (lost_good <= lost * n_good), caught / n_bad - lost_good / n_good, -1.0)
    best = int(gain.argmax())
    if gain[best] <= 0:
        return 0.0
    return float((p[best] + p[min(best + 1, len(p) - 1)]) / 2)


class Judge:
    """The forests of the views with their thresholds."""

    def __init__(self, x: np.ndarray):
        self.forests = [IsolationForest.grow(x[:, list(view)]) for view in VIEWS]
        self.thresholds = [0.0] * len(VIEWS)

    def paths(self, x: np.ndarray) -> list[np.ndarray]:
        return [forest.path_lengths(x[:, list(view)]) for view, forest in zip(VIEWS, self.forests)]

    def verdicts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The path length in the forest of all statistics, and whether any forest rejects."""
        paths = self.paths(x)
        return paths[0], np.any([p < t for p, t in zip(paths, self.thresholds)], axis=0)


def _path_counts(judge: Judge):
    """Batches of (quality, statistics) to (view, path, good, bad): the rows of each path length in each forest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATISTICS], axis=1)
            good = batch.column("quality").to_numpy(zero_copy_only=False) == 1
            for view, paths in enumerate(judge.paths(features(x))):
                values, at = np.unique(paths, return_inverse=True)
                n, n_good = np.bincount(at, minlength=len(values)), np.bincount(at[good], minlength=len(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), view, np.int32)), pa.array(values), pa.array(n_good), pa.array(n - n_good)], names=["view", "path", "good", "bad"])

    return run


def thresholds(counts: DataFrame, lost: float = GOOD_LOST) -> dict[int, float]:
    """What ``calibrated`` gives for each view, from counts(view, path, good, bad) of any number of rows.

    The driver sees a row for each bucket of path lengths; every cut is tried
    where its bucket is. Views whose threshold is 0 are left out.
    """
    counts = counts.withColumn("bucket", F.floor(F.col("path") * BUCKETS).cast("int"))
    sums = counts.groupBy("view", "bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("path").alias("least"))
    rows = []
    for _, own in sums.toPandas().sort_values(["view", "bucket"]).groupby("view"):
        n_good, n_bad = int(own["good"].sum()), int(own["bad"].sum())
        if n_good and n_bad:
            befores = [(own[c].cumsum() - own[c]).tolist() for c in ("good", "bad")]
            rows += zip(own["view"].tolist(), own["bucket"].tolist(), *befores, [*own["least"].tolist()[1:], None], [n_good] * len(own), [n_bad] * len(own))
    if not rows:
        return {}
    starts = counts.sparkSession.createDataFrame(rows, "view int, bucket int, good_before long, bad_before long, following double, n_good long, n_bad long")
    within = W.partitionBy("view", "bucket").orderBy("path")
    run = counts.join(F.broadcast(starts), ["view", "bucket"])
    run = run.withColumns({
        "lost": F.col("good_before") + F.sum("good").over(within),
        "caught": F.col("bad_before") + F.sum("bad").over(within),
        "next": F.coalesce(F.lead("path").over(within), "following", "path"),
    })
    gain = F.col("caught") / F.col("n_bad") - F.col("lost") / F.col("n_good")
    tried = run.filter(F.col("lost") <= lost * F.col("n_good")).select("view", "path", "next", gain.alias("gain")).filter("gain > 0")
    best = tried.groupBy("view").agg(F.min(F.struct(-F.col("gain"), "path", "next")).alias("cut"))
    return {r["view"]: (r["path"] + r["next"]) / 2 for r in best.select("view", "cut.path", "cut.next").collect()}


def fit(stats: DataFrame, labels: DataFrame) -> Judge | None:
    """Forests whose trees draw from all rows that pass, calibrated on all of these that have a label. None for too few rows."""
    passing = stats.filter(~F.col("base_failed"))
    order = F.xxhash64("doc_id", *STATISTICS)  # rows without a doc_id, or that share one, are drawn one by one
    drawn = least_rows(passing, TREES * TREE_ROWS, order, "doc_id", *STATISTICS).select(*STATISTICS).toPandas().to_numpy()
    if len(drawn) < 2:
        return None
    judge = Judge(features(drawn))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    known = written(known.groupBy("doc_id").agg(F.min("quality").alias("quality")), "labels")
    labelled = met(passing, known, "doc_id", "inner").select("quality", *STATISTICS)
    paths = labelled.mapInArrow(_path_counts(judge), "view int, path double, good long, bad long")
    counts = written(paths.groupBy("view", "path").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "paths")
    for view, threshold in thresholds(counts).items():
        judge.thresholds[view] = threshold
    return judge


def judged(stats: DataFrame, judge: Judge | None) -> DataFrame:
    """stats with path_length (1 is usual) and kept."""
    if judge is None:
        return stats.withColumn("path_length", F.lit(1.0)).withColumn("kept", ~F.col("base_failed"))
    shared = stats.sparkSession.sparkContext.broadcast(judge)  # TREES trees of TREE_ROWS rows for each view, whatever the input
    names = stats.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATISTICS], axis=1)
            paths, odd = shared.value.verdicts(features(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths), pa.array(odd)], names=[*names, "path_length", "odd"])

    found = stats.mapInArrow(run, stats.select("*").schema.add("path_length", "double").add("odd", "boolean"))
    return found.withColumn("kept", ~F.col("base_failed") & ~F.col("odd")).drop("odd")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the five statistics, base_failed, path_length and kept of every row of docs(doc_id, text, ...).

    Null and empty texts have zeros and fail the base rules; repeated rows get
    equal verdicts; without usable labels the forest rejects nothing; an empty
    table gives an empty result; further columns are ignored.
    """
    stats = written(rule_statistics(docs), "statistics")
    return judged(stats, fit(stats, labels))
