"""TF-IDF: one score for each word of a corpus, smoothed and scaled to length 1."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.functions import text as X
from lexarium.operators.batches import LINE, SENTENCE, Found, Phrases, Terms, among, numbered, taken, tokens
from lexarium.operators.common import documents, looked_up, ranked, scored, spread
from lexarium.operators.tokenizer import Tokenizer
from lexarium.params import TextSplit, TfIdfInput, TfIdfParams


def segments(df: DataFrame, params: TfIdfParams) -> DataFrame:
    """(corpus, parts): the documents of corpus 0, a row each, as their words. Empty ones stay, for they count."""
    whole = Tokenizer(params).document_column(F.col("text")) if params.kind is TfIdfInput.UNPROCESSED else F.col("text")
    return spread(documents(df)).select(F.lit(0).alias("corpus"), F.array(X.split_blank(whole)).alias("parts"))


def block_scores(terms: Terms, part: np.ndarray, n_parts: np.ndarray) -> np.ndarray:
    """Scores of the terms of text blocks, whose parts are their documents. part: of each word; n_parts: of each block."""
    count = np.bincount(terms.term, minlength=terms.n)
    most = int(part.max(initial=0)) + 1
    _, keys = numbered(terms.term * most + part)
    held = np.bincount(keys // most, minlength=terms.n)
    raw = count * (np.log((n_parts[terms.of] + 1) / (held + 1)) + 1)
    return raw / np.sqrt(np.bincount(terms.of, raw * raw, len(n_parts)))[terms.of]


def _blocks(df: DataFrame, params: TfIdfParams, n: int | None = None, **form) -> DataFrame:
    """(doc_id, word, score) of every text block, or its n best words with their rank. A row is a block: no shuffle."""
    tokenizer, text, by_phrase = Tokenizer(params), F.col("text"), params.split is TextSplit.PHRASES
    stop, dropped = frozenset(params.stop_words), frozenset(X.dropped_words((), params.punctuation))
    placed = spread(documents(df))
    if by_phrase:
        placed = placed.select("doc_id", tokenizer.lowered_column(text).alias("lowered"), F.lit(0).alias("size"))
    else:
        by_line = params.split is TextSplit.PARAGRAPHS
        mark = LINE if by_line else SENTENCE
        cut = F.transform(X.lines(text), lambda line: F.array_join(X.sentences(line), SENTENCE)) if by_line else X.sentences(text)
        placed = placed.select("doc_id", cut.alias("cut"))
        placed = placed.select("doc_id", F.lower(X.token_text(F.array_join("cut", mark), "".join({SENTENCE, mark}))).alias("lowered"), F.size("cut").alias("size"))

    def find(lowered: pa.Array, size: pa.Array) -> Found:
        if by_phrase:
            terms = Phrases(lowered, stop, dropped)
            part, n_parts = terms.run, np.bincount(terms.run_doc, minlength=len(lowered))
        else:
            doc, codes, words = tokens(lowered)
            kind = np.where(among(words, [mark]), 1, np.where(among(words, {SENTENCE, *dropped, *stop}), 0, 2))[codes]
            keep = kind == 2
            terms = Terms(doc[keep], codes[keep], words)
            part, n_parts = np.cumsum(kind == 1)[keep], size.to_numpy().astype(np.int64)
        return Found(terms.of, taken(terms.names()), block_scores(terms, part, n_parts), terms.ranks)

    return scored(placed, find, "word", n, **form).withColumnRenamed("doc_id", "corpus")


def word_counts(cut: DataFrame) -> DataFrame:
    """(corpus, word, count, df, n) from one pass over (corpus, parts).

    Sorted, a part shows where a word is its first; so one grouping, with
    partial sums before the shuffle, gives both the count and the number of
    parts that hold the word. n is the number of parts of the row.
    """
    flagged = F.flatten(F.transform(F.transform("parts", lambda part: F.array_sort(part)), lambda part: _first_flags(part)))
    each = cut.select("corpus", F.size("parts").alias("n"), F.explode(flagged).alias("w"))
    return each.groupBy("corpus", F.col("w.word").alias("word")).agg(F.count("*").alias("count"), F.sum("w.first").alias("df"), F.max("n").alias("n"))


def _first_flags(part):
    return F.transform(part, lambda w, k: F.struct(w.alias("word"), F.when((k == 0) | (F.get(part, k - 1) != w), 1).otherwise(0).alias("first")))


def tf_idf(df: DataFrame, params: TfIdfParams | None = None) -> DataFrame:
    """(corpus, word, score). corpus is 0 for a corpus of documents, else the doc_id of the text block.

    The score is tf * (ln((N + 1) / (df + 1)) + 1), scaled to length 1 over
    the corpus; tf's divisor, the same for all words, goes with the scaling. N
    counts empty segments too.
    """
    params = params or TfIdfParams()
    if params.kind is TfIdfInput.TEXT_BLOCK:
        return _blocks(df, params)
    counts = word_counts(segments(df, params))
    raw = (F.col("count") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)).alias("raw")
    size = documents(df).agg(F.count("*").alias("n"))  # one row, as is the length: the vocabulary isn't gathered in one task
    weighed = counts.drop("n").join(F.broadcast(size)).select("corpus", "word", raw)
    norm = weighed.agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"))
    return weighed.join(F.broadcast(norm)).select("corpus", "word", (F.col("raw") / F.col("length")).alias("score"))


def ranked_words(df: DataFrame, n: int, params: TfIdfParams | None = None) -> DataFrame:
    """(corpus, word, score, rank): the n best words of each corpus, by score to six places, then by the word."""
    params = params or TfIdfParams()
    if params.kind is TfIdfInput.TEXT_BLOCK:
        return _blocks(df, params, n)
    return ranked(tf_idf(df, params).withColumn("score", F.round("score", 6)), n, "word")


def word_score(df: DataFrame, wanted: DataFrame, params: TfIdfParams | None = None) -> DataFrame:
    """The score of each (corpus, word) wanted, 0 where there is none."""
    params = params or TfIdfParams()

    def scores(keys: frozenset[str] | None) -> DataFrame:
        if params.kind is TfIdfInput.TEXT_BLOCK:
            return _blocks(df, params, keys=keys)
        found = tf_idf(df, params)
        return found if keys is None else found.filter(F.col("word").isin(sorted(keys)))

    return looked_up(scores, wanted, ["corpus", "word"])


def word_scores_map(df: DataFrame, params: TfIdfParams | None = None) -> DataFrame:
    """(corpus, scores): one map of word to score for each corpus; a vocabulary is one row here, so it has to fit into one."""
    params = params or TfIdfParams()
    if params.kind is TfIdfInput.TEXT_BLOCK:
        return _blocks(df, params, nested=True).select("corpus", F.map_from_arrays("word", "score").alias("scores"))
    entry = F.collect_list(F.struct("word", "score"))
    return tf_idf(df, params).groupBy("corpus").agg(F.map_from_entries(F.array_sort(entry)).alias("scores"))


def word_scores_text(df: DataFrame, params: TfIdfParams, digits: int = 6) -> DataFrame:
    """(corpus, scores): the words of each text block in byte order, each with its score, as one text."""
    if params.kind is not TfIdfInput.TEXT_BLOCK:
        raise ValueError("only text blocks have a text each")
    return _blocks(df, params, digits=digits)
