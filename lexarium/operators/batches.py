"""Many documents at once: their words as numbers, counted and scored in numpy, with no step in Python for each word.

Columns of text come in pieces of bounded size; what is known of a distinct
word is found once for each piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexarium.functions.strings import rounded

#: Stands for a sentence's end among the tokens of a text, and for a line's.
SENTENCE, LINE = "\x1e", "\n"


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each key, from 0 in order of first appearance, and the distinct keys."""
    found = pa.array(keys).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary.to_numpy()


def numbered_words(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = words.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def firsts(numbers: np.ndarray, n: int) -> np.ndarray:
    """Where each number from 0 to n first stands."""
    first = np.empty(n, np.int64)
    first[numbers[::-1]] = np.arange(len(numbers) - 1, -1, -1)
    return first


def byte_ranks(words: pa.Array) -> np.ndarray:
    """The place of each distinct word in byte order."""
    rank = np.empty(len(words), np.int64)
    rank[pc.array_sort_indices(words.cast(pa.binary())).to_numpy()] = np.arange(len(words))
    return rank


def among(words: pa.Array, some: Iterable[str]) -> np.ndarray:
    """Whether each word is one of some."""
    return pc.is_in(words, pa.array(list(some), words.type)).to_numpy(zero_copy_only=False)


def matching(words: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False)


def tokens(joined: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Documents and word numbers of tokens that stand apart by blanks, and the distinct words."""
    cut = pc.split_pattern(joined, " ")
    codes, words = numbered_words(cut.flatten())
    return np.repeat(np.arange(len(joined)), np.diff(cut.offsets.to_numpy())), codes, words


def starts_of(groups: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))) if len(groups) else np.empty(0, np.int64)


class Terms:
    """The words of a piece's documents, each with its document a term of its own.

    doc, word: of each place; term: the number of its term, in order of first
    appearance; of: the document of each term; as_word: its word.
    """

    def __init__(self, doc: np.ndarray, word: np.ndarray, words: pa.Array):
        self.doc, self.word, self.words = doc, word, words
        self.term, keys = numbered(doc * max(1, len(words)) + word)
        self.of, self.as_word = np.divmod(keys, max(1, len(words)))
        self.n = len(keys)

    def names(self) -> pa.Array:
        return self.words.take(pa.array(self.as_word))

    def ranks(self) -> np.ndarray:
        return byte_ranks(self.words)[self.as_word]


class Phrases(Terms):
    """The words of a piece, and the runs of them between stop words; cut after ``length`` words where that is given.

    run: of each word, the number of its run; size: of each run; run_doc.
    """

    def __init__(self, lowered: pa.Array, stop_words: frozenset[str], dropped: frozenset[str], length: int | None = None):
        doc, codes, words = tokens(lowered)
        kind = np.where(among(words, dropped), 0, np.where(among(words, stop_words), 1, 2))[codes]
        stops = np.cumsum(kind == 1)
        keep = kind == 2
        super().__init__(doc[keep], codes[keep], words)
        stops = stops[keep]
        new = np.ones(len(stops), bool)
        new[1:] = (stops[1:] != stops[:-1]) | (self.doc[1:] != self.doc[:-1])
        if length:
            begin = np.flatnonzero(new)
            at = np.arange(len(new)) - (begin[np.cumsum(new) - 1] if len(begin) else 0)
            new = at % length == 0
        self.run = np.cumsum(new) - 1
        self.begin = np.flatnonzero(new)
        self.size = np.diff(np.append(self.begin, len(new)))
        self.run_doc = self.doc[self.begin]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, pa.Array, Callable[[], np.ndarray]]:
        """The documents, a run and the text of the distinct phrases of each document, and their ranks in byte order."""
        offsets = pa.array(np.append(self.begin, len(self.word)).astype(np.int32))
        texts = pc.binary_join(pa.ListArray.from_arrays(offsets, self.words.take(pa.array(self.word))), " ")
        code, phrases = numbered_words(texts)
        number, keys = numbered(self.run_doc * max(1, len(phrases)) + code)
        run = firsts(number, len(keys))
        return self.run_doc[run], run, phrases.take(pa.array(code[run])), lambda: byte_ranks(phrases)[code[run]]


def means(phrases: Phrases, scores: np.ndarray) -> np.ndarray:
    """The mean score of each run's words, added up in their order."""
    return np.bincount(phrases.run, scores[phrases.term], len(phrases.size)) / phrases.size


class Found:
    """Keys and scores of a piece's documents; more: further columns. ranks gives the place of each key in byte order."""

    def __init__(self, rows: np.ndarray, names: Callable[[np.ndarray | None], pa.Array], scores: np.ndarray, ranks: Callable[[], np.ndarray], more: Iterable[np.ndarray] = (), before: Iterable[np.ndarray] = ()):
        self.rows, self.names, self.scores, self.ranks, self.more, self.before = rows, names, scores, ranks, list(more), list(before)

    def columns(self, at: np.ndarray | None = None, scores: np.ndarray | None = None, rank: np.ndarray | None = None) -> tuple:
        """Rows, keys, scores and the rest, of the places ``at``."""
        some = (lambda x: x) if at is None else (lambda x: x[at])
        mid = [] if rank is None else [rank]
        return some(self.rows), self.names(at), *map(some, self.before), some(self.scores) if scores is None else scores, *mid, *map(some, self.more)

    def best(self, n: int) -> tuple:
        """The n best of each document by rounded score, then by key in byte order; rank counts from 1."""
        values = rounded(self.scores)
        order = np.lexsort((self.ranks(), -values, self.rows))
        rows = self.rows[order]
        begin = starts_of(rows)
        rank = np.arange(len(rows)) - np.repeat(begin, np.diff(np.append(begin, len(rows))))
        order, rank = order[rank < n], rank[rank < n]
        return self.columns(order, values[order], (rank + 1).astype(np.int32))

    def text(self, n_rows: int, digits: int) -> tuple:
        """One text for each document, key=score;key=score, by key in byte order; half up by the score times a power of ten."""
        ranks = self.ranks()
        most = int(ranks.max(initial=0)) + 1
        order = np.argsort(self.rows * most + ranks) if n_rows * most < 2**62 else np.lexsort((ranks, self.rows))
        scores, scale = self.scores[order], 10**digits
        if np.isfinite(scores).all() and (scores >= 0).all() and (scores < 2**53 / scale).all():
            moved = scores * scale
            whole = np.floor(moved)
            whole = (whole + (moved - whole >= 0.5)).astype(np.int64)
            left, right = np.divmod(whole, scale)
            numbers = pc.binary_join_element_wise(pa.array(left).cast(pa.string()), pc.utf8_slice_codeunits(pa.array(right + scale).cast(pa.string()), 1), ".")
        else:
            numbers = pa.array([f"{x:.{digits}f}" for x in scores.tolist()], pa.string())
        entries = pc.binary_join_element_wise(self.names(order), numbers, "=")
        ends = np.cumsum(np.bincount(self.rows, minlength=n_rows))
        offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
        return np.arange(n_rows), pc.binary_join(pa.ListArray.from_arrays(offsets, entries), ";")


def taken(names: pa.Array) -> Callable[[np.ndarray | None], pa.Array]:
    return lambda at: names if at is None else names.take(pa.array(at))
