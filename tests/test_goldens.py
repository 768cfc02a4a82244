import golden
import pytest

from lexarium.operators.co_occurrence import CoOccurrence
from lexarium.operators.rake import Rake
from lexarium.operators.text_rank import TextRank
from lexarium.operators.tf_idf import ranked_words
from lexarium.operators.tokenizer import Tokenizer
from lexarium.operators.yake import Yake
from lexarium.params import RakeParams, TextRankParams, TextSplit, TfIdfInput, TfIdfParams, TokenizerParams, YakeParams


@pytest.fixture(scope="module")
def advert(docs):
    return docs(golden.TEXT)


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*order).collect()]


def share(found, expected):
    return sum(x in set(expected) for x in found) / len(found)


STOP = {"stop_words": golden.STOP_WORDS}


def test_tokenizer(advert):
    t = Tokenizer(TokenizerParams(**STOP))
    assert column(t.split_into_words(advert), "word", "pos") == golden.WORDS
    assert column(t.split_into_sentences(advert), "sentence", "sent_idx") == golden.SENTENCES
    assert column(t.split_into_paragraphs(advert), "paragraph", "par_idx") == golden.PARAGRAPHS
    assert t.split_into_phrases(advert).count() == 63
    cut = column(t.split_into_phrases(advert, 3), "phrase", "phrase_idx")
    assert len(cut) == 73 and max(len(p.split()) for p in cut) == 3


def test_tf_idf(advert):
    top = {r["word"]: r["score"] for r in ranked_words(advert, 100, TfIdfParams(**STOP, kind=TfIdfInput.TEXT_BLOCK, split=TextSplit.PARAGRAPHS)).collect()}
    assert len(top) == 100 and share(list(top), golden.TF_IDF_WORDS) >= 0.85
    assert top["rust"] == pytest.approx(0.367288, abs=2e-6)
    assert top["development"] == top["environment"] == pytest.approx(0.222587, abs=2e-6)
    assert top["programming"] == top["team"] == pytest.approx(0.180807, abs=2e-6)


def test_co_occurrence(spark, advert):
    paragraphs = Tokenizer(TokenizerParams(**STOP)).split_into_paragraphs(advert).selectExpr("par_idx as doc_id", "paragraph as text")
    co = CoOccurrence(paragraphs, golden.CO_OCCURRENCE_WORDS, 10)
    for word, row in golden.CO_OCCURRENCE_ROWS.items():
        assert co.matrix_row(word).first()["weights"] == pytest.approx(row, abs=1e-6)
    assert [(r["word"], round(r["weight"], 4)) for r in co.relations("developer").collect()] == [("rust", 1.0), ("programming", 0.3333), ("team", 0.3333)]
    assert co.relation("rust", "work").first()["weight"] == 0.0
    assert co.relation("rust", "nowhere").count() == 0 and co.matrix_row("nowhere").count() == 0
    assert co.label("team") == 5 and co.word(5) == "team" and co.label("nowhere") is None and co.word(99) is None


def test_rake(advert):
    rake = Rake(advert, RakeParams(**STOP))
    top = column(rake.ranked_phrases(10), "phrase", "rank")
    assert share(top, golden.RAKE_PHRASES) >= 0.9
    scores = {r["phrase"]: r["score"] for r in rake.phrase_scores().collect()}
    assert len(scores) == 62
    assert scores["core rust applications write clean efficient"] == pytest.approx(4.5625)
    assert scores["version control systems preferably git strong"] == pytest.approx(4.333333)
    assert scores["title junior rust developer job description"] == pytest.approx(4.229167)
    limited = Rake(advert, RakeParams(**STOP, phrase_length=3)).ranked_phrases(10)
    assert all(len(r["phrase"].split()) <= 3 for r in limited.collect())


def test_text_rank(advert):
    rank = TextRank(advert, TextRankParams(**STOP))
    top = column(rank.ranked_words(10), "word", "rank")
    assert share(top, golden.TEXT_RANK_WORDS) >= 0.9
    scores = {r["word"]: r["score"] for r in rank.word_scores().collect()}
    assert len(scores) == 105
    assert scores["rust"] == pytest.approx(5.04943, abs=1e-4) and scores["environment"] == pytest.approx(2.78288, abs=1e-4) and scores["development"] == pytest.approx(2.75722, abs=1e-4)
    assert rank.graph().count() == 512
    of_phrases = [w for p in column(rank.ranked_phrases(5), "phrase", "rank") for w in p.split()]
    assert share(of_phrases, top) >= 0.9
    limited = TextRank(advert, TextRankParams(**STOP, phrase_length=3)).ranked_phrases(10)
    assert all(len(r["phrase"].split()) <= 3 for r in limited.collect())


def test_yake(advert):
    yake = Yake(advert, YakeParams(**STOP))
    top = column(yake.ranked_keywords(10), "keyword", "rank")
    assert share(top, golden.YAKE_KEYWORDS) >= 0.9
    scores = {r["keyword"]: r["score"] for r in yake.keyword_scores().collect()}
    assert len(scores) == 193 and yake.term_scores().count() == 105
    assert scores["developer job description"] == 1.0
    assert scores["junior rust developer"] == pytest.approx(0.57263, abs=1e-5) and scores["rust developer job"] == pytest.approx(0.27128, abs=1e-5)
    words = [w for k in top for w in k.split()]
    assert set(words) <= set(column(yake.ranked_terms(len(words)), "term", "rank"))
