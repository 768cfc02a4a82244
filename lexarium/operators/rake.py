"""RAKE: words and phrases scored by the phrases that words stand in."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.functions.text import dropped_words
from lexarium.operators.batches import Found, Phrases, means, taken
from lexarium.operators.common import as_map, documents, looked_up, scored, spread
from lexarium.operators.tokenizer import Tokenizer
from lexarium.params import RakeParams


def word_counts(phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Frequency and degree of each term."""
    degree = np.bincount(phrases.term, (phrases.size - 1)[phrases.run], phrases.n)
    return np.bincount(phrases.term, minlength=phrases.n), degree.astype(np.int64)


class Rake:
    """Scores of every document; a row is a document.

    A word's score is degree / frequency, the degree being the sum of (length
    - 1) over the phrases of its occurrences; a phrase's score is the mean of
    its words' scores, and equal phrases are one. Words come from the JVM's
    tokenizer and are counted where the rows are: no shuffle.
    """

    def __init__(self, df: DataFrame, params: RakeParams | None = None):
        self.params = params or RakeParams()
        self.texts = spread(documents(df)).select("doc_id", Tokenizer(self.params).lowered_column(F.col("text")).alias("lowered"))

    def _read(self):
        p = self.params
        stop, dropped, length = frozenset(p.stop_words), frozenset(dropped_words((), p.punctuation)), p.phrase_length
        return lambda lowered: Phrases(lowered, stop, dropped, length)

    def _words(self, n: int | None = None, **form) -> DataFrame:
        read, counted = self._read(), n is None and "digits" not in form

        def find(lowered: pa.Array) -> Found:
            phrases = read(lowered)
            frequency, degree = word_counts(phrases)
            return Found(phrases.of, taken(phrases.names()), degree / frequency, phrases.ranks, before=(frequency, degree) if counted else ())

        return scored(self.texts, find, "word", n, before={"frequency": "long", "degree": "long"} if counted else None, **form)

    def _phrases(self, n: int | None = None, **form) -> DataFrame:
        read = self._read()

        def find(lowered: pa.Array) -> Found:
            phrases = read(lowered)
            frequency, degree = word_counts(phrases)
            rows, run, names, ranks = phrases.distinct()
            return Found(rows, taken(names), means(phrases, degree / frequency)[run], ranks)

        return scored(self.texts, find, "phrase", n, **form)

    def word_scores(self) -> DataFrame:
        """(doc_id, word, frequency, degree, score)."""
        return self._words()

    def phrase_scores(self) -> DataFrame:
        """(doc_id, phrase, score)."""
        return self._phrases()

    def ranked_keywords(self, n: int) -> DataFrame:
        """(doc_id, word, score, rank): the n best words of each document, by score to six places, then by the word."""
        return self._words(n)

    def ranked_phrases(self, n: int) -> DataFrame:
        return self._phrases(n)

    def keyword_score(self, wanted: DataFrame) -> DataFrame:
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
