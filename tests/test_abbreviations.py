"""Learned abbreviations against a slow version, and the tokens that keep them."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from chatterscope.functions import text as tx
from chatterscope.operators import abbreviations as ab

CORPUS = [
    "The U.S. policy of the U.S. held. Dr. Smith saw it, as Dr. Jones did.", "He met Dr. No at noon. The policy held.",
    "It held (the U.S. did). Policy and noon, no more... it held.", "They saw the U.S. again.\nDr. Smith left at 3. The end.", "", None,
] * 3


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, text string")


def slow(rows):
    n, k = Counter(), Counter()
    for text in rows:
        for piece in re.split(r"\s", text or ""):
            core = re.sub(r"\A[\W_]+", "", piece.lower())
            core = re.sub(r"[^\w.]+\Z", "", core)
            word = core.rstrip(".")
            if re.search(r"[^\W\d_]", word):
                n[word] += 1
                k[word] += bool(re.search(r"[^\W_]\.\Z", core))
    share = sum(k.values()) / sum(n.values())
    found = {}
    for word in n:
        if not k[word]:
            continue
        bare, rest = len(word.replace(".", "")), n[word] - k[word]

        def likelihood(p):
            return k[word] * math.log(p) + (rest * math.log(1 - p) if rest else 0)

        ratio = -2 * (likelihood(share) - likelihood(0.99))
        found[word] = (n[word], k[word], ratio * math.exp(-bare) * (word.count(".") + 1) * bare**-rest)
    return found


def scored(spark, rows):
    return {r.word: (r.n, r.stopped, r.score) for r in ab.scored_words(texts(spark, rows), "text").collect()}


def test_scores_against_a_slow_version(spark):
    rng = random.Random(5)
    words = ["etc.", "e.g.", "noon", "(cf.", "end.", "end", "a.", "a", "x...", "3.", "é.", "No.)", "--"]
    rows = CORPUS + [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(200)]
    got, want = scored(spark, rows), slow(rows)
    assert got.keys() == want.keys()
    for word in want:
        assert got[word][:2] == want[word][:2] and math.isclose(got[word][2], want[word][2], rel_tol=1e-9, abs_tol=1e-12)


def test_nothing_to_learn(spark):
    assert scored(spark, [None, "", "no period", "3. 4."]) == {} == scored(spark, [])


def test_every_word_ends_in_a_period(spark):
    """The ratio of a corpus that is all periods is defined."""
    assert all(math.isfinite(s) for *_, s in scored(spark, ["a. b.", "a."]).values())


def test_tokens_keep_learned_abbreviations(spark):
    corpus = texts(spark, CORPUS)
    known = ab.abbreviations(corpus, "text")
    assert {"u.s", "dr"} <= {r.word for r in known.collect()} and "held" not in {r.word for r in known.collect()}
    shown = [
        "U.S. policy held. Dr. Smith", "the U.S.", "the U.S. \n", 'a U.S.\n"quoted"  (U.S.) dr. x', None, "", "Dr. \ufdd0 Dr. x", "plain text here. And more.",
    ]
    rows = texts(spark, shown).withColumns({"word": F.lit("w"), "at": F.lit(1), "n": F.lit(2)})
    got = {r.id: r.tokens for r in ab.kept_tokens(rows, known, "id", "text").collect()}
    plain = {r.id: r.t for r in rows.select("id", tx.tokens(F.col("text")).alias("t")).collect()}
    assert got[0] == ["U.S.", "policy", "held", ".", "Dr.", "Smith"]
    assert got[1] == got[2] == ["the", "U.S", "."]
    assert got[3][:2] == ["a", "U.S."] and got[3][-2:] == ["dr.", "x"] and got[3].count("U.S.") == 1
    assert all(got[i] == plain[i] for i in (1, 2, 4, 5, 6, 7)) and got[0] != plain[0]
    assert got[4] is None and got[5] == []
    nothing = known.where(F.lit(False))
    assert {r.id: r.tokens for r in ab.kept_tokens(rows, nothing, "id", "text").collect()} == plain
    assert ab.kept_tokens(rows, known, "id", "text").columns == [*rows.columns, "tokens"]
