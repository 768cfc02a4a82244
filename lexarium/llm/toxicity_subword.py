"""Toxicity from subword bags: character n-gram embeddings, averaged, into a linear softmax.

A word is a bag of its character n-grams (with marks at both ends), hashed
into a table of embeddings; the bag's average goes through a linear softmax
over the two classes. Embeddings and softmax are trained jointly, in numpy. A
document is as toxic as its most toxic word, so a single word shows in a text
of any length; in training a soft maximum over the words passes the document's
label down to them. A misspelling that was never seen shares n-grams with the
words that were.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarium.llm.common import free_name, least_rows, spread, written

#: Labelled rows that training sees at most, by label, chosen by the hash of doc_id.
TOXIC_ROWS, CLEAN_ROWS = 2500, 5000
SHORTEST, LONGEST = 3, 6
TABLE_BITS = 18
WIDTH = 8
STEPS = 60
FLOOR = 0.05
_CHUNK = 1 << 18


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the word of each (numbered over all texts), and the words of each text."""
    coded = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    gap = np.zeros(1, np.uint32)
    codes = np.concatenate([x for c in coded for x in (gap, c)] + [gap])
    owner = np.repeat(np.arange(len(texts) + 1), [len(c) + 1 for c in coded] + [1])
    codes = np.where(_letters()[codes], codes, 0)
    keep = np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))  # one mark between words
    codes, owner = codes[keep].astype(np.uint64), owner[keep]
    marks = codes == 0
    words_of = np.bincount(owner[np.flatnonzero(marks[:-1] & ~marks[1:]) + 1], minlength=len(texts))[: len(texts)] if len(codes) > 1 else np.zeros(len(texts), np.int64)
    number = np.cumsum(marks)
    buckets, words = [], []
    h = codes.copy()
    for n in range(2, LONGEST + 1):
        if len(codes) < n:
            break
        h = h[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        if n < SHORTEST:
            continue
        inside = number[n - 2 : len(codes) - 1] - number[: len(codes) - n + 1]  # marks at 1..n-2
        at = np.flatnonzero(inside == 0)
        buckets.append(((h[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int32))
        words.append(number[at + 1] - 1)
    if not buckets:
        return np.empty(0, np.int32), np.empty(0, np.int64), words_of
    return np.concatenate(buckets), np.concatenate(words), words_of


class SubwordModel:
    """Embeddings (buckets x width), softmax weights (2 x width) and offsets (2)."""

    def __init__(self, embeddings: np.ndarray, weights: np.ndarray, offsets: np.ndarray, base: float):
        self.embeddings, self.weights, self.offsets, self.base = embeddings, weights, offsets, base

    def margins(self) -> np.ndarray:
        """What each bucket adds to the log-odds, before averaging."""
        return (self.embeddings @ (self.weights[1] - self.weights[0])).astype(np.float64)

    def offset(self) -> float:
        return float(self.offsets[1] - self.offsets[0])


def _word_bags(docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words: their n-gram buckets and starts; each document's distinct words and starts."""
    ids: dict[str, int] = {}
    members, starts = [], [0]
    for text in docs:
        own = {ids.setdefault(w, len(ids)) for w in text.split(" ") if w}
        members.append(np.array(sorted(own), np.int32))
        starts.append(starts[-1] + len(own))
    words, buckets, sizes = list(ids), [], []
    for at in range(0, len(words), 20_000):
        part = words[at : at + 20_000]
        b, w, _ = subwords([" ".join(part)])
        order = np.argsort(w, kind="stable")
        buckets.append(b[order])
        sizes.append(np.bincount(w, minlength=len(part)))
    sizes = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
    return np.concatenate(buckets) if buckets else np.empty(0, np.int32), sizes, np.concatenate([np.empty(0, np.int32), *members]), np.array(starts, np.int64)


def train(docs: list[str], labels: list[int], seed: int = 5, steps: int = STEPS) -> SubwordModel | None:
    """Fit to documents given as their distinct words, joined by spaces. None where a class is missing."""
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return None
    buckets, sizes, members, starts = _word_bags(docs)
    full = np.diff(starts) > 0
    y, used = y[full], np.flatnonzero(full)
    if not len(y) or y.min() == y.max():
        return None
    first, count = starts[:-1][used], np.diff(starts)[used]
    doc_of = np.repeat(np.arange(len(used)), count)
    bag_start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    share = 1.0 / sizes
    random = np.random.default_rng(seed)
    e = random.normal(0, 0.1, (1 << TABLE_BITS, WIDTH)).astype(np.float32)
    w = random.normal(0, 0.5, (2, WIDTH)).astype(np.float32)
    c = np.zeros(2, np.float32)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    met = np.zeros(1 << TABLE_BITS, bool)
    met[buckets] = True
    seen = np.flatnonzero(met)
    local = (np.cumsum(met, dtype=np.int32) - 1)[buckets]
    del buckets
    e_seen = e[seen]
    # words in blocks of bounded size: no array over all n-grams is made in a step
    cuts = [0]
    while cuts[-1] < len(sizes):
        cuts.append(min(len(sizes), int(np.searchsorted(bag_start, bag_start[cuts[-1]] + _CHUNK, "right"))))
    spans = [(a, b, bag_start[a], bag_start[b] if b < len(sizes) else len(local)) for a, b in zip(cuts, cuts[1:])]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (e_seen, w, c)]
    for step in range(steps):
        sharp = 1.0 + 5.0 * step / steps  # the soft maximum grows harder
        v = w[1] - w[0]
        each = e_seen @ v
        z = np.concatenate([np.add.reduceat(each[local[i:j]], bag_start[a:b] - i) for a, b, i, j in spans]).astype(np.float64) * share + float(c[1] - c[0])
        zd = z[members] * sharp
        top = np.maximum.reduceat(zd, first)
        mass = np.exp(zd - top[doc_of])
        total = np.add.reduceat(mass, first)
        attention = mass / total[doc_of]
        score = np.add.reduceat(attention * z[members], first)
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        g_doc = (p - y) * weight / len(y)
        g_word = np.bincount(members, attention * g_doc[doc_of], minlength=len(sizes))
        g_word *= share
        g_bucket = np.zeros(len(seen))
        for a, b, i, j in spans:
            g_bucket += np.bincount(local[i:j], np.repeat(g_word[a:b], sizes[a:b]), minlength=len(seen))
        g_bucket = g_bucket.astype(np.float32)
        g_v = e_seen.T @ g_bucket
        grads = (np.outer(g_bucket, v), np.stack((-g_v, g_v)), np.array([-g_doc.sum(), g_doc.sum()], np.float32))
        for param, grad, (m1, m2), rate in zip((e_seen, w, c), grads, state, (0.1, 0.05, 0.05)):
            m1 += 0.1 * (grad - m1)
            m2 += 0.01 * (grad * grad - m2)
            size = np.sqrt(m2 / (1 - 0.99 ** (step + 1)))
            # a floor under the sizes: n-grams with a trace of gradient, met once or twice, hardly move
            param -= rate * (m1 / (1 - 0.9 ** (step + 1))) / (size + FLOOR * float(size.max()) + 1e-8)
    e[:] = 0  # an n-gram that training never met says nothing
    e[seen] = e_seen
    return SubwordModel(e, w, c, min(0.49, float(np.mean(labels))))


def train_calibrated(docs: list[str], labels: list[int], part: int = 6) -> SubwordModel | None:
    """Train on all but every ``part``-th row, then set the offset so that those rows part best at a half."""
    rest = [k for k in range(len(docs)) if k % part]
    model = train([docs[k] for k in rest], [labels[k] for k in rest])
    if model is None:
        return train(docs, labels)
    held = [k for k in range(0, len(docs), part) if docs[k]]
    y = np.array([labels[k] for k in held])
    p = scores([docs[k] for k in held], model.margins(), model.offset(), model.base)
    if not len(y) or y.min() == y.max():
        return model
    z = np.log(np.clip(p, 1e-13, 1 - 1e-13) / np.clip(1 - p, 1e-13, 1 - 1e-13))
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    wrong = np.cumsum(np.append(0, y)) + (len(y) - y.sum()) - np.cumsum(np.append(0, 1 - y))  # with the cut before each row
    cut = np.concatenate((z[:1] - 1, (z[1:] + z[:-1]) / 2, z[-1:] + 1))
    gap = np.concatenate(([0], np.diff(z), [0]))
    best = np.flatnonzero(wrong == wrong.min())
    model.offsets[1] -= np.float32(cut[best[gap[best].argmax()]])
    return model


def scores(texts: list[str | None], margins: np.ndarray, offset: float, base: float) -> np.ndarray:
    """The probability of the toxic class of each text; ``base`` where a text has no word."""
    out, at = np.full(len(texts), base), 0
    while at < len(texts):
        end, room = at, 0
        while end < len(texts) and (end == at or room + len(texts[end] or "") <= _CHUNK):
            room += len(texts[end] or "")
            end += 1
        best = np.full(end - at, -np.inf)
        part = [t or "" for t in texts[at:end]]
        for own, piece in _pieces(part):
            buckets, words, words_of = subwords(piece)
            n = int(words_of.sum())
            if not n:
                continue
            z = np.bincount(words, margins[buckets], minlength=n) / np.maximum(np.bincount(words, minlength=n), 1)
            some = np.flatnonzero(words_of)
            high = np.maximum.reduceat(z, (np.cumsum(words_of) - words_of)[some])
            np.maximum.at(best, own[some], high)
        found = np.flatnonzero(np.isfinite(best))
        out[at + found] = 1 / (1 + np.exp(-np.clip(best[found] + offset, -30, 30)))
        at = end
    return out


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """A long text in pieces that end between words, so that arrays stay small; others as they are."""
    if len(texts) > 1 or len(texts[0]) <= _CHUNK:
        yield np.arange(len(texts)), texts
        return
    text, at = texts[0], 0
    while at < len(text):
        end = min(len(text), at + _CHUNK)
        while end < len(text) and text[end].isalnum() and text[end - 1].isalnum():
            end += 1
        yield np.zeros(1, np.int64), [text[at:end]]
        at = end


def _distinct_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            lower = (text or "").lower()
            out.append(" ".join(sorted(set("".join(ch if ch.isalnum() else " " for ch in lower).split()))))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), batch.column("toxic")], names=["doc_id", "words", "toxic"])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels training never sees: a fifth, by the CRC-32 of doc_id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> SubwordModel | None:
    """A model from labelled rows that aren't held out: at most toxic_rows and clean_rows of them, by the hash of doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = written(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    order = F.xxhash64("doc_id")
    chosen = [least_rows(known.filter(F.col("toxic") == k), n, order, "doc_id") for k, n in ((1, toxic_rows), (0, clean_rows))]
    sample = chosen[0].unionByName(chosen[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    found = texts.mapInArrow(_distinct_words, "doc_id long, words string, toxic int")
    once = found.groupBy("doc_id").agg(F.min(F.struct("words", "toxic")).alias("row")).select("doc_id", "row.*")  # repeated rows don't lift the bound
    rows = once.toPandas().sort_values("doc_id")
    return train_calibrated(rows["words"].tolist(), rows["toxic"].tolist())


def _scored(docs: DataFrame, model: SubwordModel | None, name: str, keep_text: bool) -> DataFrame:
    """docs with the column ``name`` put last, and without its text unless keep_text."""
    names = [c for c in docs.columns if keep_text or c != "text"]
    if model is None:
        return docs.select(*names).withColumn(name, F.lit(0.0))
    # 2**TABLE_BITS floats, whatever the input
    shared = docs.sparkSession.sparkContext.broadcast((model.margins().astype(np.float32), model.offset(), model.base))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins, offset, base = shared.value
        for batch in batches:
            values = scores(batch.column("text").to_pylist(), margins, offset, base)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(values)], names=[*names, name])

    return docs.mapInArrow(run, docs.select(*names).schema.add(name, "double"))


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs(doc_id, text, ...).

    Labels only teach: labels, lang, source and doc_id are never inputs of a
    score. Null and empty texts, and texts without a letter or digit, get the
    score ``base``, below a half: no word speaks against them. Without a model
    (no labels, or of one class) every score is 0. Repeated rows get equal
    scores; a null doc_id is never held out; an empty table gives an empty
    result; further columns are ignored, whatever their names.
    """
    slim = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    scored = _scored(slim, fit(docs, labels, **how), "score", keep_text=False)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """The columns and rows of docs whose score is below the threshold. The texts are read once and not shuffled."""
    name = free_name(docs, "toxic_score")
    return _scored(docs, fit(docs, labels, **how), name, keep_text=True).filter(F.col(name) < threshold).drop(name)
