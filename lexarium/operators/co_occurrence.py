"""Co-occurrence of target words within a window, over the largest count of all."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.functions import text as X
from lexarium.operators.common import documents, spread


class CoOccurrence:
    """Relations of ``words`` in the documents of df.

    Documents are only split at blanks. Two targets count when they stand at
    most ``window`` places apart, both ways round, the same word at two places
    included. Pairs are found within the row: among a document's targets, each
    with those that follow inside the window. Partial sums go before the one
    shuffle, whose groups are pairs of targets.
    """

    def __init__(self, df: DataFrame, words: Iterable[str], window: int, doc_col: str = "doc_id"):
        self.words, self.window = list(words), window
        self.label_of = {w: k for k, w in enumerate(self.words)}  # the last place of a repeated word holds
        self.df = spread(documents(df, doc_col))
        self.spark = df.sparkSession

    def labels(self) -> DataFrame:
        """(word, label), one row for each distinct word."""
        return self.spark.createDataFrame(sorted(self.label_of.items(), key=lambda x: x[1]), "word string, label int")

    def counts(self) -> DataFrame:
        """(word1, word2, count) of the pairs that occur."""
        targets = F.filter(F.transform(X.split_blank(F.col("text")), lambda w, k: F.struct(k.alias("pos"), w.alias("word"))), lambda t: t["word"].isin(list(self.label_of)))
        placed = self.df.select(targets.alias("targets")).filter(F.size("targets") > 1)
        # at most ``window`` targets can follow inside the window
        later = lambda t, k: F.filter(F.slice("targets", k + 2, F.lit(max(self.window, 1))), lambda u: u["pos"] - t["pos"] <= self.window)
        pairs = F.flatten(F.transform("targets", lambda t, k: F.transform(later(t, k), lambda u: F.struct(t["word"].alias("a"), u["word"].alias("b")))))
        near = placed.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("count"))
        both = near.union(near.select("b", "a", "count")).toDF("word1", "word2", "count")
        return both.groupBy("word1", "word2").agg(F.sum("count").alias("count"))

    def triples(self) -> DataFrame:
        """(word1, word2, weight) with weight above 0."""
        counts = self.counts()
        most = counts.agg(F.max("count").alias("most"))  # one row
        return counts.join(F.broadcast(most)).select("word1", "word2", (F.col("count") / F.col("most")).alias("weight"))

    def matrix(self) -> DataFrame:
        """(row, col, word1, word2, weight) of all labels; without any pair every cell is NaN, as 0 / 0.

        A repeated target has one label, its last place; the rows of the
        earlier places are 0.
        """
        n = len(self.words)
        names = self.spark.createDataFrame(list(enumerate(self.words)), "label int, word string")
        cells = names.toDF("row", "word1").join(F.broadcast(names.toDF("col", "word2")))  # a cell for each pair of targets: the size of the result
        own = self.labels()
        known = self.triples().join(F.broadcast(own.toDF("word1", "row")), "word1").join(F.broadcast(own.toDF("word2", "col")), "word2").select("row", "col", "weight")
        some = self.triples().agg((F.count("*") > 0).alias("some"))
        filled = F.coalesce("weight", F.when(F.col("some"), F.lit(0.0)).otherwise(F.lit(float("nan"))))
        return cells.join(known, ["row", "col"], "left").join(F.broadcast(some)).select("row", "col", "word1", "word2", filled.alias("weight")) if n else cells.withColumn("weight", F.lit(0.0))

    def matrix_row(self, word: str) -> DataFrame:
        """(word, weights): the row of a word as an array; no row for an unknown one."""
        row = self.matrix().filter((F.col("word1") == word) & (F.col("row") == self.label_of.get(word, -1)))
        return row.groupBy(F.col("word1").alias("word")).agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "weight"))), lambda x: x["weight"]).alias("weights"))

    def relations(self, word: str) -> DataFrame:
        """(word, weight, label) of the words that relate to a word, by label."""
        own = self.triples().filter(F.col("word1") == word)
        return own.join(F.broadcast(self.labels().toDF("word2", "label")), "word2").select(F.col("word2").alias("word"), "weight", "label").orderBy("label")

    def relations_of(self, pairs: Iterable[tuple[str, str]]) -> DataFrame:
        """(word1, word2, weight) of the cells of pairs of words, from one pass; no row where a word is unknown."""
        cells = [(self.label_of[a], self.label_of[b]) for a, b in pairs if a in self.label_of and b in self.label_of]
        wanted = self.spark.createDataFrame(cells, "row int, col int")
        return self.matrix().join(F.broadcast(wanted), ["row", "col"]).select("word1", "word2", "weight")

    def relation(self, word1: str, word2: str) -> DataFrame:
        """(weight) of one cell; no row where a word is unknown."""
        return self.relations_of([(word1, word2)]).select("weight")

    def label(self, word: str) -> int | None:
        return self.label_of.get(word)

    def word(self, label: int) -> str | None:
        return self.words[label] if 0 <= label < len(self.words) else None
