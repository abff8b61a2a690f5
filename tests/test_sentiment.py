"""Scores of sentences whose results are published, and rules worked by hand."""

import math

import pytest
from pyspark.sql import functions as F

from chatterscope.operators import joins
from chatterscope.operators import sentiment as module
from chatterscope.operators.sentiment import Rules, sentiment, sentiment_words
from chatterscope.sources.lexicons import read_lexicon, seed_lexicon

LEXICON = {
    "smart": 1.7, "handsome": 2.2, "funny": 1.9, "good": 1.9, "great": 3.1, "bad": -2.5,
    "horrible": -2.5, "sux": -1.5, "kind": 2.4, "uncompelling": -0.9, ":)": 2.0, ":d": 2.3,
}


def compound(total):
    return round(total / math.sqrt(total * total + 15), 4)


def scores(spark, texts, rules=Rules()):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    lexicon = spark.createDataFrame(list(LEXICON.items()), "token string, valence double")
    found = {r.id: r.compound for r in sentiment(rows, lexicon, "id", "t", rules).collect()}
    return [found.get(i, 0.0) for i in range(len(texts))]


PUBLISHED = {
    "VADER is smart, handsome, and funny.": 0.8316,
    "VADER is smart, handsome, and funny!": 0.8439,
    "VADER is very smart, handsome, and funny.": 0.8545,
    "VADER is VERY SMART, handsome, and FUNNY.": 0.9227,
    "VADER is VERY SMART, handsome, and FUNNY!!!": 0.9342,
    "VADER is not smart, handsome, nor funny.": -0.7424,
    "The book was good.": 0.4404,
    "The book was kind of good.": 0.3832,
    "The plot was good, but the characters are uncompelling and the dialog is not great.": -0.7042,
    "A really bad, horrible book.": -0.8211,
    "At least it isn't a horrible book.": 0.431,
    ":) and :D": 0.7925,
    "": 0.0,
    "Today sux": -0.3612,
    "Today sux!": -0.4199,
    "Today SUX!": -0.5461,
}


def test_published_sentences(spark):
    assert dict(zip(PUBLISHED, scores(spark, list(PUBLISHED)))) == PUBLISHED


BY_HAND = {
    # a negation three words ahead; two apart the intensifier is damped
    "not at all good": compound(1.9 * -0.74),
    "very much good": compound(1.9 + 0.293 * 0.95),
    # "never so" raises instead of negating; "so" is an intensifier as well
    "never so good": compound((1.9 + 0.293) * 1.5),
    # "least" in front negates, unless "at least" or "very least"
    "the least good": compound(1.9 * -0.74),
    "at least good": compound(1.9),
    # a repeated word is judged where it first stands
    "good stuff here today, not good": compound(2 * 1.9),
    "not good, later in the day good": compound(2 * 1.9 * -0.74),
    # an idiom around the word replaces its valence
    "he said yeah right good": compound(-2.0),
    # marks: questions count from two on and stop at 0.96, shouts stop at four
    "good?": compound(1.9),
    "good ??": compound(1.9 + 0.36),
    "good ????": compound(1.9 + 0.96),
    "good !!!!!!": compound(1.9 + 4 * 0.292),
    # capitals count only in mixed text; a shouted intensifier adds its emphasis
    "GOOD BOOK": compound(1.9),
    "GOOD book": compound(1.9 + 0.733),
    "VERY bad": compound(-2.5 - 0.293 - 0.733),
    "kinda bad": compound(-2.5 + 0.293),
}


@pytest.mark.parametrize("fits", [[True], [False, True], [False, False]])
def test_rules_by_hand(spark, fits, monkeypatch):
    """With a lexicon that is small, small once cut down to the words that occur, or never."""
    monkeypatch.setattr(module, "fits_broadcast", lambda dim: fits[0])
    monkeypatch.setattr(joins, "fits_broadcast", lambda dim: fits[-1])
    got = dict(zip(BY_HAND, scores(spark, list(BY_HAND))))
    assert got == BY_HAND


def test_words(spark):
    text = 'I said "ok" (fine) don\'t!! :-) end.  wow!!! a. -x- no?!?'
    row = spark.createDataFrame([(text,)], "t string").select(sentiment_words(F.col("t"))).first()[0]
    assert row == ["said", '"ok"', "(fine)", "don't!!", ":-)", "end", "wow", "a.", "-x-", "no"]


def test_a_repeated_word_of_the_lexicon_counts_once(spark):
    rows = spark.createDataFrame([(1, "good")], "id int, t string")
    score = lambda words: sentiment(rows, spark.createDataFrame(words, "token string, valence double"), "id", "t").first().compound
    assert score([("good", 1.9), ("good", 1.9), ("good", 1.0)]) == score([("good", 1.9)])


def test_large_lexicon_path_has_no_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "good")], "id int, t string")
    lexicon = spark.createDataFrame(list(LEXICON.items()), "token string, valence double")
    monkeypatch.setattr(module, "fits_broadcast", lambda dim: False)
    monkeypatch.setattr(joins, "fits_broadcast", lambda dim: False)
    plan = sentiment(rows, lexicon, "id", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "lexicon.txt").write_text("good\t1.9\t0.9\t[1, 2]\n:)\t2.0\t1.1\t[2]\n\"quoted\t-1.0\t0.1\t[-1]\n")
    got = {r.token: r.valence for r in read_lexicon(spark, str(tmp_path / "lexicon.txt")).collect()}
    assert got == {"good": 1.9, ":)": 2.0, '"quoted': -1.0}
    assert seed_lexicon(spark).where("token = 'good'").first().valence == 1.9
