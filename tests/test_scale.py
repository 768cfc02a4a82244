"""Figures that have to grow no faster than the input, and to stay small."""

import cProfile
import pstats
import random
import time

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from lexarium.functions import text as X
from lexarium.operators import common
from lexarium.operators.rake import Rake
from lexarium.operators.text_rank import TextRank
from lexarium.operators.tf_idf import tf_idf
from lexarium.operators.yake import Piece, Yake
from lexarium.params import RakeParams, TextRankParams, TfIdfInput, TfIdfParams, YakeParams
from lexarium.plans.sql import QUERIES


def test_cost_of_tokens_and_sentences(spark):
    """Both patterns cost a few times what a look at each character costs, not some fifteen times."""
    line = "Words of a plain text, with marks. Others follow: café, naïve; 3.14 and U.S. too! "
    df = spark.createDataFrame([(line * 40,)] * 2000, "text string").repartition(4).cache()
    df.count()

    def seconds(column):
        best = 9e9
        for _ in range(4):
            began = time.perf_counter()
            df.select(F.size(column)).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        return best

    plain = seconds(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    assert seconds(X.tokens(F.col("text"))) < 8 * plain
    assert seconds(X.sentences(F.col("text"))) < 8 * plain


def test_ties_of_rake_phrases(docs):
    """The mean is a tie at six places, 10.1890625; added up word by word, as the SQL does, it is just below."""
    letters = "h i l the k g e j k the j the d c the d the c c the d the h k c h l h g j the g the c h h the b f c e i e l i d j l l c b b h the c h the a the g"
    text = " ".join(w if w == "the" else f"{w}q" for w in letters.split(" "))  # no stop words of the SQL
    found = Rake(docs(text), RakeParams(stop_words=["the"])).phrase_scores_text(6).first()["scores"]
    assert dict(x.split("=") for x in found.split(";"))[" ".join(f"{w}q" for w in "b f c e i e l i d j l l c b b h".split(" "))] == "10.189062"
    expected = duckdb.connect().execute(f"WITH documents AS (SELECT 1 AS doc_id, '{text}' AS text), " + QUERIES["rake_phrase_map"].removeprefix("WITH ")).fetchone()[1]
    assert found == expected


def random_texts(n, seed=3):
    r = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "the", "of", "3.14", "x's", "café", "Zoë", "日本", "a\u0001b", "NaN", "-", "--", "b", "c", "d", "É"]
    marks = [" ", " ", " ", ", ", ". ", "! ", "\n", "\n\n", " ", " "]
    return ["".join(r.choice(words) + r.choice(marks) for _ in range(r.randint(0, 60))) for _ in range(n)]


def results(df, keys=("alpha", "beta gamma", "b", "nowhere")):
    stop = {"stop_words": ["the", "of"]}
    rake, rank, yake, block = Rake(df, RakeParams(**stop)), TextRank(df, TextRankParams(**stop)), Yake(df, YakeParams(**stop)), TfIdfParams(**stop, kind=TfIdfInput.TEXT_BLOCK)
    wanted = df.select("doc_id").crossJoin(df.sparkSession.createDataFrame([(k,) for k in keys], "key string"))
    lists = [rake.word_scores(), rake.phrase_scores(), rank.word_scores(), rank.phrase_scores(), rank.graph(), yake.candidates(), yake.contexts(), yake.keyword_scores(), yake.ranked_keywords(3), rake.ranked_phrases(3), tf_idf(df, block)]
    texts = [rake.phrase_scores_text(), rank.word_scores_text(4), yake.keyword_scores_text(), yake.term_scores_text()]
    asked = [yake.keyword_score(wanted.withColumnRenamed("key", "keyword")), rake.phrase_score(wanted.withColumnRenamed("key", "phrase")), rank.word_score(wanted.withColumnRenamed("key", "word"))]
    return [sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in found.collect()) for found in lists + texts + asked]


def test_pieces_of_documents(docs, monkeypatch):
    """Whether documents are worked on together or one by one, in many batches or one, is all the same."""
    df = docs(*random_texts(60))
    together = results(df)
    monkeypatch.setattr(common, "_PIECE", 1)
    monkeypatch.setattr(common, "_FLUSH", 7)
    monkeypatch.setattr(common, "_KEYS", 1)
    assert results(df) == together


def test_texts_equal_the_lists(docs):
    """The flattened texts hold what the lists hold, by key in byte order, in every document."""
    df = docs(*random_texts(40))
    yake = Yake(df, YakeParams(stop_words=["the", "of"]))
    by_doc = {}
    for r in yake.keyword_scores().collect():
        by_doc.setdefault(r["doc_id"], {})[r["keyword"]] = r["score"]
    for r in yake.keyword_scores_text(6).collect():
        own = by_doc.get(r["doc_id"], {})
        assert r["scores"] == ";".join(f"{k}={own[k]:.6f}" for k in sorted(own, key=str.encode))


def test_lookups_join_only_what_is_asked_for(docs, spark):
    """Other keys don't reach the join."""
    df = docs(*random_texts(50))
    wanted = df.select("doc_id", F.lit("alpha").alias("keyword"))
    found = Yake(df).keyword_score(wanted)
    rows = {r["doc_id"]: r["score"] for r in found.collect()}
    all_scores = {r["doc_id"]: r["score"] for r in Yake(df).keyword_scores().filter("keyword = 'alpha'").collect()}
    assert len(rows) == 50 and all(rows[d] == all_scores.get(d, 0.0) for d in rows)
    assert Yake(df)._keywords(keys=frozenset(["alpha"])).count() == len(all_scores)


def test_work_is_not_done_word_by_word():
    """Ten times the words of a piece in about as many steps in Python, where each word was some steps."""

    def calls(times):
        text = pa.array([" ".join(t.split()) for t in random_texts(20)] * times)
        profile = cProfile.Profile()
        profile.enable()
        Piece(text, pc.utf8_lower(text), pa.array([1] * len(text), pa.int32()), YakeParams(), frozenset([""])).keywords().text(len(text), 6)
        profile.disable()
        return pstats.Stats(profile).total_calls

    calls(1)
    assert calls(50) < 2 * calls(5)
