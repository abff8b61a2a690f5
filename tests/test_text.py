"""Text expressions against plain-Python models and hand-worked rows."""

import random
import re
import sys

import pytest
from pyspark.sql import functions as F

from chatterscope.functions import text as tx

def values(spark, texts, *functions):
    """Each function applied to a text column, row by row."""
    columns = [fn(F.col("t")) for fn in functions]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in rows.select("i", *columns).orderBy("i").collect()]


def samples(n=400):
    rng = random.Random(7)
    alphabet = "aAbBzZ09_ \t\n\x0b\x1c\x85\xa0 　.,;:!?'\"()-éÉßñçжЖ漢²٣🙂|~^"
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(n)]


def test_whitespace_is_pythons():
    ours = set(tx.WHITESPACE)
    assert ours == {c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()}


def test_strip_and_normalise_match_python(spark):
    texts = samples()
    got = values(spark, texts, tx.strip, tx.normalized)
    assert got == [(t.strip(), t.strip().lower()) for t in texts]


def test_cleaned_matches_python(spark):
    texts = samples()
    want = [re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", t.lower())).strip() for t in texts]
    assert [r[0] for r in values(spark, texts, tx.cleaned)] == want


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Don't stop! I cannot believe it's \"great\"", "Do n't stop ! I can not believe it 's `` great ''"),
        ("pay 3,000 now, or else: 5:30", "pay 3,000 now , or else : 5:30"),
        ("OK... gonna go--now", "OK ... gon na go -- now"),
        ("He left. (She stayed.)", "He left . ( She stayed . )"),
        ("the dogs' bowl", "the dogs ' bowl"),
        ("we'll WON'T they've", "we 'll WO N'T they 've"),
        ("„so“ «là» ’x", "„ so “ « là » ’ x"),
        ("", ""),
        (" \n\t ", ""),
    ],
)
def test_tokens_by_hand(spark, text, expected):
    got = values(spark, [text], lambda t: F.array_join(tx.tokens(t), " "))
    assert got == [(expected,)]


def test_guards_do_not_change_tokens(spark):
    """A text without a pattern's marks is the same with the pattern applied."""
    for marks, pattern, _ in tx.QUOTE_PATTERNS + tx.TOKEN_PATTERNS:
        for text in samples(200):
            if not any(m in text for m in marks):
                assert re.search(pattern, text) is None


def test_bigrams_by_length(spark):
    texts = ["", "a", "a b", "a b c d e f", "a b c d e f g"]
    got = [r[0] for r in values(spark, texts, lambda t: tx.leading_bigrams(tx.tokens(t)))]
    five = "a b, b c, c d, d e, e f"
    assert got == ["", "", "a b", five, five]


def test_lexical_diversity_on_the_thresholds(spark):
    seven_of_ten = "a b c d e f g a a a"
    four_of_ten = "a b c d a a a a a a"
    texts = [seven_of_ten, four_of_ten, "a b", "a a a", "", "?! ...", None, "Cannot can not"]

    def shown(t):
        ld = tx.lexical_diversity(t)
        return tx.scored(ld["score"], 2, ld["label"])

    got = [r[0] for r in values(spark, texts, shown)]
    assert got == [
        "0.70 (Moderately diverse)", "0.40 (Less diverse)", "1.00 (Highly diverse)",
        "0.33 (Less diverse)", "0.00 (No text)", "0.00 (No text)", None, "0.50 (Moderately diverse)",
    ]


def test_fixed_point_is_pythons(spark):
    rng = random.Random(3)
    numbers = [i / 10_000 for i in range(-10_000, 10_001)] + [rng.uniform(-1, 1) for _ in range(3000)]
    numbers += [0.0045, 0.0055, 0.1235, 0.125, 0.625, 0.295, -0.0001, 0.0625, 0.1875]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double")
    got = rows.select("x", tx.fixed_point(F.col("x"), 3).alias("a"), tx.fixed_point(F.col("x"), 2).alias("b")).collect()
    assert all(r.a == f"{r.x:.3f}" and r.b == f"{r.x:.2f}" for r in got)


def test_sentiment_label_thresholds(spark):
    rows = spark.createDataFrame([(x,) for x in (0.05, -0.05, 0.0499, -0.0499, 0.0)], "c double")
    got = [r[0] for r in rows.select(tx.sentiment_label(F.col("c"))).collect()]
    assert got == ["Positive", "Negative", "Neutral", "Neutral", "Neutral"]


def test_opening_tokens_are_the_first_of_all(spark):
    """However long the text, only its first words are cut; what is cut is what the whole text begins with."""
    texts = samples() + ["", None, ' "a', "a, b: 'c' (d)...", "\n\n cannot. gimme", "x" * 50 + " " + '"' * 9 + " b.\" c"]
    for text, (first, whole) in zip(texts, values(spark, texts, lambda t: tx.opening_tokens(t, 3), tx.tokens)):
        if text is None:
            assert first is None
            continue
        assert first == whole[: len(first)] and len(first) >= min(3, len(whole))
    ((long,),) = values(spark, ["a. b " * 10_000], lambda t: F.size(tx.opening_tokens(t, 4)))
    assert long == 6


def test_diversity_cuts_a_text_once(spark):
    """Projections that look into the struct do not repeat the work."""
    shown = spark.createDataFrame([("a b",)], "t string").select(tx.lexical_diversity(F.col("t")).alias("l"))
    shown = shown.select(F.col("l.score").alias("s"), tx.scored(F.col("l.score"), 2, F.col("l.label")).alias("c"))
    assert shown.first() == (1.0, "1.00 (Highly diverse)")
    assert shown._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
