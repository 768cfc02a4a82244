"""TextRank: words ranked by a walk over the graph of their neighbourhood, and phrases by their words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.functions.text import dropped_words
from lexarium.operators.batches import Found, Phrases, Terms, means, numbered, taken
from lexarium.operators.common import as_map, documents, looked_up, scored, spread, within_rows
from lexarium.operators.tokenizer import Tokenizer
from lexarium.params import TextRankParams


def _edges(terms: Terms, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directed edges of the terms of each document, and their weights, in order of both ends."""
    ids, doc, n = terms.term, terms.doc, max(1, terms.n)
    pairs = [(a[same], b[same]) for k in range(1, window + 1) if k < len(ids) for a, b, same in ((ids[:-k], ids[k:], (doc[:-k] == doc[k:]) & (ids[:-k] != ids[k:])),)]
    if not pairs:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    a, b = (np.concatenate(x) for x in zip(*pairs))
    number, keys = numbered(np.minimum(a, b) * n + np.maximum(a, b))
    low, high = np.divmod(keys, n)
    weight = np.bincount(number, minlength=len(keys))
    keys = np.concatenate((keys, high * n + low))
    order = np.argsort(keys)
    return *np.divmod(keys[order], n), np.concatenate((weight, weight))[order]


def walk(terms: Terms, n_docs: int, p: TextRankParams, fixed: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores and out-weights of the terms; the steps that each document made and whether its changes were below the tolerance.

    All documents of a piece walk together; one that has settled stands still.
    fixed: make just so many steps, whatever the change.
    """
    src, dst, weight = _edges(terms, p.window_size)
    n, doc = terms.n, terms.of
    out = np.bincount(src, weight, n)
    share = weight / out[dst]
    scores, steps, settled = np.ones(n), np.zeros(n_docs, np.int64), np.zeros(n_docs, bool)
    most = p.max_iterations if fixed is None else fixed
    walks = np.ones(n_docs, bool)
    step = 0
    while walks.any() and (most is None or step < most):
        new = (1 - p.damping) + p.damping * np.bincount(src, share * scores[dst], n)
        moved = ~(np.abs(new - scores) < p.tolerance) & (out > 0)
        step += 1
        scores = np.where(walks[doc], new, scores)
        steps[walks] = step
        settled = np.where(walks, np.bincount(doc[moved], minlength=n_docs) == 0, settled)
        if fixed is None and (settled & walks).any():
            walks &= ~settled
            left = walks[doc[src]]
            src, dst, share = src[left], dst[left], share[left]
    return scores, out, steps, settled


def word_rank(words: list[str], p: TextRankParams, fixed: int | None = None) -> tuple[list[str], np.ndarray, int, bool]:
    """Nodes, their scores, the steps made and whether all changes were below the tolerance, of one stream of words."""
    found = pa.array(words, pa.string()).dictionary_encode()
    terms = Terms(np.zeros(len(words), np.int64), found.indices.to_numpy().astype(np.int64), found.dictionary)
    scores, out, steps, settled = walk(terms, 1, p, fixed)
    at = np.flatnonzero(out > 0)
    return terms.names().take(pa.array(at)).to_pylist(), scores[at], int(steps[0]), bool(settled[0])


class TextRank:
    """Ranks of every document; a row is a document.

    Words come from the JVM's tokenizer; the walk to the fixpoint runs in
    numpy where the rows are, for some documents at once: no shuffle. With a damping
    below 1 each step shrinks the change, so the walk ends without a bound on
    its steps; ``max_iterations`` sets one on request, and ``converged`` tells
    whether a document had settled.
    """

    def __init__(self, df: DataFrame, params: TextRankParams | None = None, fixed_steps: int | None = None):
        self.params, self.fixed = params or TextRankParams(), fixed_steps
        self.texts = spread(documents(df)).select("doc_id", Tokenizer(self.params).lowered_column(F.col("text")).alias("lowered"))

    def _read(self):
        p = self.params
        stop, dropped, length = frozenset(p.stop_words), frozenset(dropped_words((), p.punctuation)), p.phrase_length
        return lambda lowered: Phrases(lowered, stop, dropped, length)

    def graph(self) -> DataFrame:
        """(doc_id, src, dst, weight): both directions of every edge."""
        read, window = self._read(), self.params.window_size

        def work(lowered: pa.Array) -> tuple:
            terms = read(lowered)
            src, dst, weight = _edges(terms, window)
            names = terms.names()
            return terms.of[src], names.take(pa.array(src)), names.take(pa.array(dst)), weight

        return within_rows(self.texts, work, {"src": "string", "dst": "string", "weight": "long"})

    def out_weights(self) -> DataFrame:
        """(doc_id, word, out_weight)."""
        read, window = self._read(), self.params.window_size

        def work(lowered: pa.Array) -> tuple:
            terms = read(lowered)
            src, _, weight = _edges(terms, window)
            out = np.bincount(src, weight, terms.n).astype(np.int64)
            at = np.flatnonzero(out)
            return terms.of[at], terms.names().take(pa.array(at)), out[at]

        return within_rows(self.texts, work, {"word": "string", "out_weight": "long"})

    def _words(self, n: int | None = None, **form) -> DataFrame:
        read, params, fixed = self._read(), self.params, self.fixed

        def find(lowered: pa.Array) -> Found:
            terms = read(lowered)
            scores, out, _, settled = walk(terms, len(lowered), params, fixed)
            at = np.flatnonzero(out > 0)
            return Found(terms.of[at], taken(terms.names().take(pa.array(at))), scores[at], lambda: terms.ranks()[at], [settled[terms.of[at]]])

        return scored(self.texts, find, "word", n, more={"converged": "boolean"}, **form)

    def _phrases(self, n: int | None = None, **form) -> DataFrame:
        read, params, fixed = self._read(), self.params, self.fixed

        def find(lowered: pa.Array) -> Found:
            phrases = read(lowered)
            scores, out, _, settled = walk(phrases, len(lowered), params, fixed)
            rows, run, names, ranks = phrases.distinct()
            means_ = means(phrases, np.where(out > 0, scores, 0.0))  # unknown words add nothing and count in the divisor
            return Found(rows, taken(names), means_[run], ranks, [settled[rows]])

        return scored(self.texts, find, "phrase", n, more={"converged": "boolean"}, **form)

    def word_scores(self) -> DataFrame:
        """(doc_id, word, score, converged); words without an edge are absent."""
        return self._words()

    def phrase_scores(self) -> DataFrame:
        """(doc_id, phrase, score, converged): the sum of the words' scores over the number of words."""
        return self._phrases()

    def ranked_words(self, n: int) -> DataFrame:
        """(doc_id, word, score, rank, converged): the n best of each document, by score to six places, then by the word."""
        return self._words(n)

    def ranked_phrases(self, n: int) -> DataFrame:
        return self._phrases(n)

    def word_score(self, wanted: DataFrame) -> DataFrame:
        """The score of each (doc_id, word) wanted, 0 where there is none."""
        return looked_up(lambda keys: self._words(keys=keys), wanted, ["doc_id", "word"])

    def phrase_score(self, wanted: DataFrame) -> DataFrame:
        return looked_up(lambda keys: self._phrases(keys=keys), wanted, ["doc_id", "phrase"])

    def word_scores_map(self) -> DataFrame:
        return as_map(self._words(nested=True), "word")

    def phrase_scores_map(self) -> DataFrame:
        return as_map(self._phrases(nested=True), "phrase")

    def word_scores_text(self, digits: int = 6) -> DataFrame:
        """(doc_id, scores): the words of each document in byte order, each with its score, as one text."""
        return self._words(digits=digits)

    def phrase_scores_text(self, digits: int = 6) -> DataFrame:
        return self._phrases(digits=digits)
