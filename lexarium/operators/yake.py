"""YAKE: n-grams scored by how their terms are written, placed and surrounded."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.functions import strings as S
from lexarium.functions import text as X
from lexarium.operators.batches import SENTENCE, Found, Terms, among, byte_ranks, matching, numbered, starts_of, taken, tokens
from lexarium.operators.common import as_map, documents, looked_up, scored, spread, within_rows
from lexarium.params import YakeParams

#: The smallest step above 1 of 32-bit floats; it keeps divisors off 0.
EPSILON = 2.0**-23
#: Keywords of a document that the greedy choice looks at, at a time.
_LOOK = 64
_NUMBER = r"(?i)^[+-]?(?:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)$"


def _case(word: str) -> int:
    """1: in capitals; 2: capitalised; 3: both."""
    if word.isascii():
        upper = word.upper() == word
        return (upper and len(word) > 1) + 2 * ("A" <= word[:1] <= "Z" and (len(word) == 1 or not word[1:].isupper() and word[1:] != word[1:].upper()))
    return S.is_upper(word) + 2 * S.is_capitalised(word)


def _cases(words: pa.Array) -> np.ndarray:
    """_case of each word; one that begins with a small letter of Latin-1 has none."""
    case, at = np.zeros(len(words), np.int64), np.flatnonzero(~matching(words, "^[a-zà-öø-ÿ]"))
    case[at] = [_case(w) for w in words.take(pa.array(at)).to_pylist()]
    return case


class Piece:
    """The sentences of some texts, read once: their valid terms, and their candidates by size."""

    def __init__(self, surfaces: pa.Array, lowered: pa.Array, n_sentences: pa.Array, p: YakeParams, invalid: frozenset[str]):
        self.params, self.n_docs, self.n_sentences = p, len(lowered), n_sentences.to_numpy().astype(np.int64)
        doc, surface, self.surfaces = tokens(surfaces)
        _, term, terms = tokens(lowered)
        unfit = among(terms, invalid) | matching(terms, _NUMBER)
        kind = np.where(among(terms, [""]), 0, np.where(among(terms, [SENTENCE]), 1, np.where(unfit, 2, 3)))[term]
        ends = np.cumsum(kind == 1)
        per_doc = np.bincount(doc[kind == 1], minlength=self.n_docs)
        keep = kind > 1
        doc, ends = doc[keep], ends[keep]
        self.surface, self.valid = surface[keep], kind[keep] == 3
        self.sentence = ends + doc  # another one for each sentence of each document
        self.place = ends - (np.cumsum(per_doc) - per_doc)[doc]
        self.terms = Terms(doc[self.valid], term[keep][self.valid], terms)
        self.number = np.full(len(doc), -1)
        self.number[self.valid] = self.terms.term
        self.tf = np.bincount(self.terms.term, minlength=self.terms.n)

    def contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """left_count, left_distinct, right_count and right_distinct of the terms."""
        n, valid, number, surface = len(self.valid), self.valid, self.number, self.surface
        many = max(1, len(self.surfaces))
        found = []
        for side in (-1, 1):
            keys = []
            for k in range(1, min(self.params.window_size, n - 1) + 1):
                at = np.flatnonzero(self.sentence[k:] == self.sentence[:-k])
                own, other = (at + k, at) if side < 0 else (at, at + k)
                own, other = own[valid[own]], other[valid[own]]
                keys.append(number[own] * many + surface[other])
            keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
            found += [np.bincount(x // many, minlength=self.terms.n) for x in (keys, numbered(keys)[1])]
        return tuple(found)

    def weights(self) -> np.ndarray:
        """A low weight marks a telling term."""
        terms, tf = self.terms, self.tf
        if not terms.n:
            return np.empty(0)
        begin = starts_of(terms.of)
        group = np.zeros(terms.n, np.int64)
        group[begin] = 1
        group = np.cumsum(group) - 1
        mean = np.add.reduceat(tf, begin) / (np.diff(np.append(begin, terms.n)) + EPSILON)
        std = np.sqrt(np.bincount(group, (tf - mean[group]) ** 2))
        most = np.maximum.reduceat(tf, begin)[group]
        case = _cases(self.surfaces)[self.surface[self.valid]]
        upper, capital = (np.bincount(terms.term, case & bit != 0, terms.n) for bit in (1, 2))
        order = np.argsort(terms.term, kind="stable")
        places, sorted_terms = self.place[self.valid][order], terms.term[order]
        new = np.ones(len(order), bool)
        new[1:] = (places[1:] != places[:-1]) | (sorted_terms[1:] != sorted_terms[:-1])
        sentences = np.bincount(sorted_terms[new], minlength=terms.n)
        left, left_distinct, right, right_distinct = self.contexts()
        casing = np.maximum(upper, capital) / (1 + np.log(tf))
        frequency = tf / ((mean + std)[group] + EPSILON)
        related = 1 + (left_distinct / (left + EPSILON) + right_distinct / (right + EPSILON)) * tf / most
        spread_ = sentences / (self.n_sentences[terms.of] + EPSILON)
        return related * np.log(np.log(3 + middles(places, np.cumsum(tf) - tf, tf))) / (casing + frequency / related + spread_ / related)

    def candidates(self) -> list[tuple[list[np.ndarray], np.ndarray]]:
        """For each size from 1: the terms of the distinct candidates, place by place, and how often they stand there."""
        many = max(1, self.terms.n)
        at = np.flatnonzero(self.valid)
        code, parts, found = self.terms.term, [np.arange(self.terms.n)], [([np.arange(self.terms.n)], self.tf)]
        for n in range(1, self.params.ngram):
            on = at + n < len(self.valid)
            on[on] = self.valid[at[on] + n] & (self.sentence[at[on] + n] == self.sentence[at[on]])
            at = at[on]
            code, keys = numbered(code[on] * many + self.number[at + n])
            before, last = np.divmod(keys, many)
            parts = [*(p[before] for p in parts), last]
            found.append((parts, np.bincount(code, minlength=len(keys))))
        return found

    def names(self, found: list) -> pa.Array:
        words = self.terms.names()
        each = [[words.take(pa.array(p)) for p in parts] for parts, _ in found]
        return pa.concat_arrays([c[0] if len(c) == 1 else pc.binary_join_element_wise(*c, " ") for c in each])

    def ranks(self, found: list, names: pa.Array) -> np.ndarray:
        """The places of the candidates in byte order: by their terms' places, as a blank comes before what terms are made of."""
        many, n = len(self.terms.words) + 1, len(found)
        if many**n < 2**62 and not matching(self.terms.words, r"[\x00-\x1d\x1f]").any():
            rank = self.terms.ranks() + 1
            return np.concatenate([sum(rank[p] * many ** (n - 1 - k) for k, p in enumerate(parts)) for parts, _ in found])
        coded = names.dictionary_encode()
        return byte_ranks(coded.dictionary)[coded.indices.to_numpy()]

    def keywords(self) -> Found:
        """Candidates and scores, the best of each text 1.

        A single term is weighed down by the number of places that it takes in
        distinct longer candidates.
        """
        weights, found = self.weights(), self.candidates()
        longer = [p for parts, _ in found[1:] for p in parts]
        inside = np.bincount(np.concatenate(longer), minlength=self.terms.n) if longer else np.zeros(self.terms.n, np.int64)
        raw = []
        for parts, tf in found:
            total, product = 0.0, 1.0
            for p in parts:
                total, product = total + weights[p], product * weights[p]
            raw.append(tf * (1 + total) / ((np.maximum(inside, 1) if len(parts) == 1 else 1) * product))
        rows = np.concatenate([self.terms.of[parts[0]] for parts, _ in found])
        names = self.names(found)
        return Found(rows, taken(names), scaled(np.concatenate(raw), rows, self.n_docs), lambda: self.ranks(found, names))

    def term_scores(self) -> Found:
        terms = self.terms
        return Found(terms.of, taken(terms.names()), scaled(1 / self.weights(), terms.of, self.n_docs), terms.ranks)


def scaled(raw: np.ndarray, rows: np.ndarray, n_docs: int) -> np.ndarray:
    """Over the largest of the document."""
    most = np.full(n_docs, EPSILON)
    np.maximum.at(most, rows, raw)
    return raw / most[rows]


def middles(places: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The middle of each group of sorted places: an even number takes the upper middle one, an odd number the mean of the middle one and the one before."""
    upper = places[begin + n // 2]
    lower = places[begin + np.maximum(n // 2 - 1, 0)]
    return np.where((n == 1) | (n % 2 == 0), upper, (upper + lower) / 2)


def middle(places: list[int]) -> float:
    return float(middles(np.array(places), np.array([0]), np.array([len(places)]))[0])


class Yake:
    """Scores of every document; higher is better, and the best of a document has 1. A row is a document.

    Sentences and tokens come from the JVM, once; terms and n-grams are
    counted and scored where the rows are: no shuffle.
    """

    def __init__(self, df: DataFrame, params: YakeParams | None = None):
        self.params = p = params or YakeParams()
        self.invalid = frozenset(X.dropped_words(p.stop_words, p.punctuation))
        cut = spread(documents(df)).select("doc_id", X.sentences(X.without_controls(F.col("text"))).alias("cut"))
        cut = cut.select("doc_id", X.token_text(F.array_join("cut", SENTENCE), SENTENCE).alias("surfaces"), F.size("cut").alias("n_sentences"))
        self.texts = cut.select("doc_id", "surfaces", F.lower("surfaces").alias("lowered"), "n_sentences")

    def _read(self):
        params, invalid = self.params, self.invalid
        return lambda surfaces, lowered, n_sentences: Piece(surfaces, lowered, n_sentences, params, invalid)

    def candidates(self) -> DataFrame:
        """(doc_id, keyword, n, tf): runs of 1 to ngram valid terms."""
        read = self._read()

        def work(*columns: pa.Array) -> tuple:
            piece = read(*columns)
            found = piece.candidates()
            rows, sizes = (np.concatenate(x) for x in zip(*((piece.terms.of[parts[0]], np.full(len(tf), len(parts))) for parts, tf in found)))
            return rows, piece.names(found), sizes, np.concatenate([tf for _, tf in found])

        return within_rows(self.texts, work, {"keyword": "string", "n": "int", "tf": "long"})

    def contexts(self) -> DataFrame:
        """(doc_id, term, left_count, left_distinct, right_count, right_distinct) of the valid terms."""
        read = self._read()

        def work(*columns: pa.Array) -> tuple:
            piece = read(*columns)
            return piece.terms.of, piece.terms.names(), *piece.contexts()

        return within_rows(self.texts, work, {"term": "string"} | dict.fromkeys(("left_count", "left_distinct", "right_count", "right_distinct"), "int"))

    def term_weights(self) -> DataFrame:
        """(doc_id, term, tf, weight): a low weight marks a telling term."""
        read = self._read()

        def work(*columns: pa.Array) -> tuple:
            piece = read(*columns)
            return piece.terms.of, piece.terms.names(), piece.tf, piece.weights()

        return within_rows(self.texts, work, {"term": "string", "tf": "long", "weight": "double"})

    def _terms(self, n: int | None = None, **form) -> DataFrame:
        read = self._read()
        return scored(self.texts, lambda *columns: read(*columns).term_scores(), "term", n, **form)

    def _keywords(self, **form) -> DataFrame:
        read = self._read()
        return scored(self.texts, lambda *columns: read(*columns).keywords(), "keyword", **form)

    def term_scores(self) -> DataFrame:
        """(doc_id, term, score)."""
        return self._terms()

    def keyword_scores(self) -> DataFrame:
        """(doc_id, keyword, score), near-duplicates included."""
        return self._keywords()

    def ranked_keywords(self, n: int) -> DataFrame:
        """(doc_id, keyword, score, rank): at most n, best first, by score to six places; one that is too like a better one is passed over.

        Keywords are looked at in order until n are kept.
        """
        read, threshold = self._read(), self.params.threshold
        if n < 0:
            raise ValueError("n must be 0 or more")

        def work(*columns: pa.Array) -> tuple:
            found = read(*columns).keywords()
            values = S.rounded(found.scores)
            order = np.lexsort((found.ranks(), -values, found.rows))
            begin = starts_of(found.rows[order])
            chosen, ranks = [], []
            for first, end in zip(begin.tolist(), np.append(begin[1:], len(order)).tolist()):
                kept: list[int] = []
                parts: list = []
                for at in range(first, end, _LOOK):
                    if len(kept) >= n:
                        break
                    some = order[at : min(at + _LOOK, end)]
                    for k, keyword in zip(some.tolist(), found.names(some).to_pylist()):
                        own = S.graphemes(keyword)
                        if len(kept) < n and not any(S.alike(own, other, threshold) for other in parts):
                            kept.append(k)
                            parts.append(own)
                chosen += kept
                ranks += range(1, len(kept) + 1)
            at = np.array(chosen, np.int64)
            return found.columns(at, values[at], np.array(ranks, np.int32))

        return within_rows(self.texts, work, {"keyword": "string", "score": "double", "rank": "int"})

    def ranked_terms(self, n: int) -> DataFrame:
        """(doc_id, term, score, rank): the n best terms, by score to six places, then by the term."""
        return self._terms(n)

    def keyword_score(self, wanted: DataFrame) -> DataFrame:
        """The score of each (doc_id, keyword) wanted, 0 where there is none."""
        return looked_up(lambda keys: self._keywords(keys=keys), wanted, ["doc_id", "keyword"])

    def term_score(self, wanted: DataFrame) -> DataFrame:
        return looked_up(lambda keys: self._terms(keys=keys), wanted, ["doc_id", "term"])

    def keyword_scores_map(self) -> DataFrame:
        return as_map(self._keywords(nested=True), "keyword")

    def term_scores_map(self) -> DataFrame:
        return as_map(self._terms(nested=True), "term")

    def keyword_scores_text(self, digits: int = 6) -> DataFrame:
        """(doc_id, scores): the keywords of each document in byte order, each with its score, as one text."""
        return self._keywords(digits=digits)

    def term_scores_text(self, digits: int = 6) -> DataFrame:
        return self._terms(digits=digits)
