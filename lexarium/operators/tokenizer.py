"""Tables of tokens, sentences, phrases and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarium.functions import text as X
from lexarium.operators.common import documents, spread
from lexarium.params import TokenizerParams, _at_least_one

#: Stands for a stop word; words have no blanks, so it can't be one.
_STOP = "\t"


class Tokenizer:
    """Splits texts; each method gives one row for each part, with its place from 0.

    The ``*_column`` methods give the expression for use inside other plans.
    Everything is computed within the row of the document: no shuffle.
    """

    def __init__(self, params: TokenizerParams | None = None):
        self.params = params or TokenizerParams()

    def words_column(self, text: Column) -> Column:
        return X.words(text, self.params.stop_words, self.params.punctuation)

    def sentences_column(self, text: Column) -> Column:
        """The words of each sentence, joined; a sentence of stop words alone stays, as an empty string."""
        return F.transform(X.sentences(text), lambda s: F.array_join(self.words_column(s), " "))

    def paragraphs_column(self, text: Column) -> Column:
        """The sentences of each line that isn't blank, joined."""
        return F.transform(X.lines(text), lambda line: F.array_join(self.sentences_column(line), " "))

    def phrases_column(self, text: Column, length: int | None = None) -> Column:
        """Runs of words between stop words, as arrays; cut after ``length`` words where that is given.

        Punctuation doesn't end a phrase. Stop words become a mark, so one
        join and one split find all runs in a single pass.
        """
        _at_least_one(length, "length")
        found = F.transform(F.split(self.marked_column(text), _STOP), lambda run: F.filter(F.split(run, " "), lambda w: w != ""))
        found = F.filter(found, lambda run: F.size(run) > 0)
        if length is None:
            return found
        cut = lambda run: F.transform(F.sequence(F.lit(0), F.floor((F.size(run) - 1) / length).cast("int")), lambda k: F.slice(run, k * length + 1, F.lit(length)))
        return F.flatten(F.transform(found, cut))

    def marked_column(self, text: Column) -> Column:
        """The words of a text, joined, with a mark for each stop word: all that phrases follow from."""
        p = self.params
        some = X.words(text, (), p.punctuation)
        marked = F.transform(some, lambda w: F.when(w.isin(list(p.stop_words)), F.lit(_STOP)).otherwise(w)) if p.stop_words else some
        return F.array_join(marked, " ")

    def document_column(self, text: Column) -> Column:
        """A document as TF-IDF takes it: the words of its sentences, all joined."""
        marked = F.array_join(X.sentences(text), X.CUT)
        found = F.array_join(X.words(marked, self.params.stop_words, self.params.punctuation, X.CUT), " ")
        for part, new in ((f" {X.CUT}", X.CUT), (f"{X.CUT} ", X.CUT), (X.CUT, " ")):  # as a join of the sentences has it, empty ones included
            found = F.replace(found, F.lit(part), F.lit(new))
        return found

    def lowered_column(self, text: Column) -> Column:
        """All cleaned tokens of a text, apart by blanks: what words and phrases follow from where they are counted."""
        return F.lower(X.token_text(text))

    def _exploded(self, df: DataFrame, parts: Column, place: str, part: str) -> DataFrame:
        return spread(documents(df)).select("doc_id", F.posexplode(parts).alias(place, part))

    def split_into_words(self, df: DataFrame) -> DataFrame:
        return self._exploded(df, self.words_column(F.col("text")), "pos", "word")

    def split_into_sentences(self, df: DataFrame) -> DataFrame:
        return self._exploded(df, self.sentences_column(F.col("text")), "sent_idx", "sentence")

    def split_into_paragraphs(self, df: DataFrame) -> DataFrame:
        return self._exploded(df, self.paragraphs_column(F.col("text")), "par_idx", "paragraph")

    def split_into_phrases(self, df: DataFrame, length: int | None = None) -> DataFrame:
        phrases = F.transform(self.phrases_column(F.col("text"), length), lambda p: F.array_join(p, " "))
        return self._exploded(df, phrases, "phrase_idx", "phrase")

    def process_documents(self, df: DataFrame) -> DataFrame:
        """(doc_id, text) of cleaned documents, one for each row with a text."""
        return spread(documents(df)).select("doc_id", self.document_column(F.col("text")).alias("text"))
