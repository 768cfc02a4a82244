"""Hand-made rows for what the test tables don't reach; the expected values follow from the definitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexarium.functions import strings as S
from lexarium.functions import text as X
from lexarium.operators.co_occurrence import CoOccurrence
from lexarium.operators.common import ranked, spread
from lexarium.operators.rake import Rake
from lexarium.operators.text_rank import TextRank, word_rank
from lexarium.operators.tf_idf import ranked_words, tf_idf, word_score, word_scores_map
from lexarium.operators.tokenizer import Tokenizer
from lexarium.operators.yake import Yake, middle
from lexarium.params import RakeParams, TextRankParams, TextSplit, TfIdfInput, TfIdfParams, TokenizerParams, YakeParams


def words_of(docs, text, **params):
    return [r["word"] for r in Tokenizer(TokenizerParams(**params)).split_into_words(docs(text)).orderBy("pos").collect()]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Bachelor's degree, U.S.A. 3.14", "bachelor degree usa 314"),
        ("o'sullivan BACHELOR'S don't", "oullivan bachelor's don't"),
        ("__ – “x”", "__ – “ x ”"),
        ("1,000 a_b x’y café noir", "1000 a_b x’y café noir"),
        ("日本 abc", "日 本 abc"),
        ("up-to-date", "up to date"),
        ("\U0001f469\u200d\U0001f4bb\U0001f3fd ok\u2764\ufe0f", "\U0001f469\u200d\U0001f4bb\U0001f3fd ok \u2764\ufe0f"),
        ("\U0001f1e9\U0001f1ea\U0001f1eb\U0001f1f7", "\U0001f1e9\U0001f1ea \U0001f1eb\U0001f1f7"),
        ("\u0e01\u0e33\u0e25 abc", "\u0e01 \u0e33 \u0e25 abc"),
        ("\u30ab\u30bf\u30ab\u30ca\u30fc\u8a9e", "\u30ab\u30bf\u30ab\u30ca\u30fc \u8a9e"),
        ('\u05e6\u05d4"\u05dc "x"', '\u05e6\u05d4"\u05dc x'),
    ],
)
def test_words(docs, text, expected):
    assert words_of(docs, text) == expected.split(" ")


def test_sentences_of_other_scripts(docs):
    text = "\u4f60\u597d\u3002\u4e16\u754c\uff01 One. \u0928\u092e\u0938\u094d\u0924\u0947\u0964 \u0915 \u061f Two, u.s. three"
    found = docs(text).select(X.sentences(F.col("text")).alias("s")).first()["s"]
    assert [s.strip() for s in found] == ["\u4f60\u597d\u3002", "\u4e16\u754c\uff01", "One.", "\u0928\u092e\u0938\u094d\u0924\u0947\u0964", "\u0915 \u061f", "Two, u.s. three"]


@pytest.mark.parametrize("part", ["x", "a1", "a.", "1,", "_a", "'", '".'])
def test_long_tokens(docs, part):
    """Tokens of any length and of any number of parts; the engine mustn't recurse over them."""
    text = part * 100_000 + "z"
    found = Tokenizer().words_column(F.col("text"))
    words, sentences = docs(text).select(found, X.sentences(F.col("text"))).first()
    assert len("".join(sentences)) == len(text)
    assert words[-1].endswith("z") and len(words) <= 2


def test_punctuation_list(docs):
    assert words_of(docs, "a , € __", punctuation=["€", "__"]) == ["a", "__"]


def test_phrases_and_rake(docs):
    text = docs("alpha, beta. gamma the delta")
    stop = {"stop_words": ["the"]}
    rake = Rake(text, RakeParams(**stop))
    assert {r["word"]: r["score"] for r in rake.word_scores().collect()} == {"alpha": 2, "beta": 2, "gamma": 2, "delta": 0}
    assert {r["phrase"]: r["score"] for r in rake.phrase_scores().collect()} == {"alpha beta gamma": 2.0, "delta": 0.0}
    cut = Rake(text, RakeParams(**stop, phrase_length=2))
    assert {r["phrase"] for r in cut.phrase_scores().collect()} == {"alpha beta", "gamma", "delta"}
    assert {r["word"]: r["score"] for r in cut.word_scores().collect()} == {"alpha": 1, "beta": 1, "gamma": 0, "delta": 0}
    with pytest.raises(ValueError, match="phrase_length"):
        RakeParams(phrase_length=0)


def test_paragraphs_keep_empty_ones(docs):
    text = docs("The. Foo bar.\n\nthe\nBaz")
    params = TokenizerParams(stop_words=["the"])
    found = Tokenizer(params).split_into_paragraphs(text).orderBy("par_idx").collect()
    assert [r["paragraph"] for r in found] == [" foo bar", "", "baz"]
    scores = tf_idf(text, TfIdfParams(stop_words=["the"], kind=TfIdfInput.TEXT_BLOCK, split=TextSplit.PARAGRAPHS))
    assert {r["word"]: round(r["score"], 6) for r in scores.collect()} == {"foo": 0.57735, "bar": 0.57735, "baz": 0.57735}


def test_processed_documents(docs, spark):
    params = TfIdfParams(kind=TfIdfInput.PROCESSED)
    scores = {r["word"]: round(r["score"], 6) for r in tf_idf(docs("a b a", "b c"), params).collect()}
    assert scores == {"a": 0.754584, "b": 0.536893, "c": 0.377292}
    wanted = spark.createDataFrame([(0, "a"), (0, "nowhere")], "corpus int, word string")
    assert {r["word"]: round(r["score"], 6) for r in word_score(docs("a b a", "b c"), wanted, params).collect()} == {"a": 0.754584, "nowhere": 0.0}
    assert {k: round(v, 6) for k, v in word_scores_map(docs("a b a", "b c"), params).first()["scores"].items()} == scores
    assert ranked_words(docs("a b a", "b c"), 0, params).count() == 0
    assert [r["word"] for r in ranked_words(docs("a b a", "b c"), 99, params).orderBy("rank").collect()] == ["a", "b", "c"]


def matrix(co):
    n = len(co.words)
    cells = {(r["row"], r["col"]): r["weight"] for r in co.matrix().collect()}
    return [[cells[i, j] for j in range(n)] for i in range(n)]


def test_co_occurrence(docs):
    assert matrix(CoOccurrence(docs("a b a c"), ["a", "b", "c"], 1)) == [[0, 1, 0.5], [1, 0, 0], [0.5, 0, 0]]
    assert matrix(CoOccurrence(docs("a b a c"), ["a", "b", "c"], 2)) == [[1, 1, 0.5], [1, 0, 0.5], [0.5, 0.5, 0]]
    none = CoOccurrence(docs("a x", "b"), ["a", "b"], 1)
    assert all(math.isnan(x) for row in matrix(none) for x in row)
    assert none.relations("a").count() == 0 and math.isnan(none.relation("a", "b").first()["weight"])
    twice = CoOccurrence(docs("a b"), ["a", "b", "a"], 1)
    assert twice.label("a") == 2 and matrix(twice)[0] == [0, 0, 0] and matrix(twice)[2] == [0, 1, 0]


def test_text_rank(docs):
    p = TextRankParams(window_size=1)
    names, scores, steps, settled = word_rank("a b".split(), TextRankParams())
    assert names == ["a", "b"] and scores.tolist() == [1.0, 1.0] and steps == 1 and settled
    names, scores, steps, _ = word_rank("a b a c".split(), p)
    assert dict(zip(names, scores.round(6).tolist())) == pytest.approx({"a": 1.459482, "b": 0.977012, "c": 0.563506}, abs=2e-6) and steps == 61
    for text in ("a", "a a"):
        rank = TextRank(docs(text))
        assert rank.word_scores().count() == 0
        assert [r["score"] for r in rank.phrase_scores().collect()] == [0.0]


def test_nothing_but_stop_words(docs):
    params = {"stop_words": ["the"]}
    for text in ("the the", "", " \n "):
        d = docs(text)
        assert Tokenizer(TokenizerParams(**params)).split_into_words(d).count() == 0
        assert Rake(d, RakeParams(**params)).phrase_scores().count() == 0
        assert TextRank(d, TextRankParams(**params)).phrase_scores().count() == 0
        yake = Yake(d, YakeParams(**params))
        assert yake.keyword_scores().count() == yake.ranked_keywords(5).count() == 0
        assert tf_idf(d, TfIdfParams(**params)).count() == 0
    assert Tokenizer(TokenizerParams(**params)).split_into_sentences(docs("the")).first()["sentence"] == ""


def test_null_text_gives_no_rows(spark):
    d = spark.createDataFrame([(1, None), (2, "x y")], "doc_id long, text string")
    assert {r["doc_id"] for r in Tokenizer().split_into_words(d).collect()} == {2}
    assert Tokenizer().process_documents(d).count() == 1


def test_yake_medians():
    assert middle([3]) == 3 and middle([0, 4]) == 4 and middle([0, 2, 4]) == 1


def test_numbers(spark):
    found = spark.createDataFrame([(w,) for w in "1000 1e5 NaN inf -.5 3. 1d 3f e5 1_0".split()], "w string").select("w", X.is_number(F.col("w")).alias("n")).collect()
    assert {r["w"] for r in found if r["n"]} == {"1000", "1e5", "NaN", "inf", "-.5", "3."}


def test_levenshtein_ratio(spark):
    rows = [("junior rust", "junior rusts"), ("cafe\u0301s", "cafes"), ("e\u0301", "\u00e9"), ("a\U0001f469\u200d\U0001f4bb", "a"), ("", "")]
    found = [r["r"] for r in spark.createDataFrame(rows, "a string, b string").select(X.levenshtein_ratio(F.col("a"), F.col("b")).alias("r")).collect()]
    assert found[:4] == pytest.approx([11 / 12, 4 / 5, 0, 1 / 2]) and math.isnan(found[4])
    for (a, b), ratio in zip(rows[:4], found):
        a, b = S.graphemes(a), S.graphemes(b)
        assert 1 - S.distance_within(a, b, 9) / max(len(a), len(b)) == pytest.approx(ratio)


def test_bounded_distance():
    """Against the whole table, on short words of few letters."""

    def whole(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(2))
        d, longest = whole(a, b), max(len(a), len(b))
        assert all(S.distance_within(a, b, m) == (d if d <= m else None) for m in range(7))
        assert all(S.alike(a, b, t) == (longest > 0 and 1 - d / longest >= t) for t in (0.0, 0.5, 0.85, 1.0))


def test_rounding_half_up(spark):
    values = [0.0078125, 0.0000005, 0.1234565, 1 / 3, 2.0, 0.9999995, 123.4567895]
    spark_rounds = [r["r"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6).alias("r")).collect()]
    assert S.rounded(np.array(values)).tolist() == spark_rounds


def test_ranking(spark):
    scores = spark.createDataFrame([(k, 1.0) for k in ("é", "a", "Z", "B")] + [("top", 2.0)], "key string, score double")
    assert [r["key"] for r in ranked(scores, 9, "key").orderBy("rank").collect()] == ["top", "B", "Z", "a", "é"]
    assert ranked(scores, 0, "key").count() == 0
    with pytest.raises(ValueError, match="n must"):
        ranked(scores, -1, "key")


def test_lookups_and_maps(docs, spark):
    rake = Rake(docs("alpha beta the alpha"), RakeParams(stop_words=["the"]))
    wanted = spark.createDataFrame([(1, "alpha"), (1, "nowhere")], "doc_id long, word string")
    assert {r["word"]: r["score"] for r in rake.keyword_score(wanted).collect()} == {"alpha": 0.5, "nowhere": 0.0}
    assert rake.word_scores_map().first()["scores"] == {"alpha": 0.5, "beta": 1.0}


def per_document(df):
    """Every result of the operators whose unit is a document."""
    rake, rank, yake = Rake(df), TextRank(df), Yake(df)
    block = TfIdfParams(kind=TfIdfInput.TEXT_BLOCK)
    lists = [rake.word_scores(), rake.phrase_scores(), rank.word_scores(), rank.phrase_scores(), rank.graph(), rank.out_weights(), yake.candidates(), yake.contexts(), yake.term_weights(), yake.term_scores(), yake.keyword_scores(), tf_idf(df, block)]
    tops = [rake.ranked_keywords(3), rake.ranked_phrases(3), rank.ranked_words(3), rank.ranked_phrases(3), yake.ranked_keywords(3), yake.ranked_terms(3), ranked_words(df, 3, block)]
    maps = [rake.word_scores_map(), rake.phrase_scores_map(), rank.word_scores_map(), rank.phrase_scores_map(), yake.keyword_scores_map(), yake.term_scores_map(), word_scores_map(df, block)]
    return lists + tops + maps


def test_spread(spark, tmp_path):
    """A small input is dealt out, whatever its columns and folders are called; what comes out of a shuffle isn't counted."""
    path = str(tmp_path / "Exchange")
    spark.range(20).coalesce(1).selectExpr("id as doc_id", "'a Exchange b' as `Exchange `").write.parquet(path)
    df = spark.read.parquet(path)
    assert df.rdd.getNumPartitions() == 1 and spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    shuffled = df.repartition(2)
    assert spread(shuffled) is shuffled


def test_no_shuffle_of_the_text(docs):
    for found in per_document(docs(*["a b"] * 8)):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_row_is_a_document(spark):
    """The scores of a row don't depend on whether its doc_id is repeated or null."""
    text = "Alpha beta gamma. Beta delta, alpha beta! Gamma epsilon zeta"
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    many = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None), (1, "")], "doc_id long, text string").repartition(2)
    for alone, repeated in zip(per_document(one), per_document(many)):
        expected = sorted(str(r[1:]) for r in alone.collect())
        found = [(r[0], str(r[1:])) for r in repeated.collect()]
        if len(alone.columns) == 2 and "scores" in alone.columns:  # maps: a text without words has an empty one
            found = [x for x in found if x[1] != "({},)"]
        assert sorted(x for d, x in found if d is None) == expected
        assert sorted(x for d, x in found if d == 1) == sorted(expected * 2)


def test_text_rank_walk_ends_by_itself():
    words = "a b a c a d".split()  # scores swing between a and the others
    *_, steps, settled = word_rank(words, TextRankParams(window_size=1, damping=0.99))
    assert settled and steps > 200
    *_, steps, settled = word_rank(words, TextRankParams(window_size=1, damping=0.99, max_iterations=5))
    assert not settled and steps == 5
    with pytest.raises(ValueError, match="max_iterations"):
        TextRankParams(damping=1.0)


def test_phrase_scores_tell_whether_they_settled(docs):
    text = docs("a b a c d a")
    assert all(r["converged"] for r in TextRank(text).phrase_scores().collect())
    assert not any(r["converged"] for r in TextRank(text, TextRankParams(max_iterations=2)).phrase_scores().collect())


def test_sources(spark, tmp_path):
    from lexarium.sources import corpus_source, table_source, text_source, word_list

    assert [tuple(r) for r in text_source(spark, "a b").collect()] == [(0, "a b")]
    assert [tuple(r) for r in corpus_source(spark, ["x", "y"]).collect()] == [(0, "x"), (1, "y")]
    corpus_source(spark, ["x"]).selectExpr("doc_id as id", "text as body", "1 as more").write.parquet(str(tmp_path / "t"))
    assert [tuple(r) for r in table_source(spark, str(tmp_path / "t"), "id", "body").collect()] == [(0, "x")]
    words = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "word string")
    assert word_list(words) == ("a", "b")
    with pytest.raises(ValueError, match="more than 1"):
        word_list(words, most=1)


def test_split_stream(spark, tmp_path):
    from lexarium.streaming import split_stream

    spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    query = split_stream(stream, Tokenizer().words_column(F.col("text"))).writeStream.format("memory").queryName("parts").start()
    query.processAllAvailable()
    query.stop()
    assert {r["part"] for r in spark.table("parts").collect()} == {"one", "two"}
