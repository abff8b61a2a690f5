"""Rule-based compound sentiment (Hutto & Gilbert, ICWSM 2014) as a relational job.

Plan: words with their neighbours are exploded inside the scan stage, a broadcast lexicon keeps
the few words that carry a valence, the rules run as column expressions on those hits, and only
hits (key, word, position, valence) are shuffled, once, by text key. Words without a valence never
leave the stage that read them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterscope.functions.text import bound, spaced
from chatterscope.operators.joins import dictionary_join, fits_broadcast

# Fixed values of the published scorer.
STEP = 0.293          # weight of an intensifier
CAPS = 0.733          # emphasis by capitals
NEGATED = -0.74       # factor of a negation
DAMPING = (1.0, 0.95, 0.9)  # intensifier weight by distance 1, 2, 3
NORMALISER = 15.0

# Intensifiers that raise, intensifiers that lower, negations, idioms.
RAISING = frozenset(
    """absolutely amazingly awfully completely considerably decidedly deeply effing enormously
    entirely especially exceptionally extremely fabulously flipping flippin fricking frickin
    frigging friggin fully fucking greatly hella highly hugely incredibly intensely majorly more
    most particularly purely quite really remarkably so substantially thoroughly totally
    tremendously uber unbelievably unusually utterly very""".split()
)
LOWERING = frozenset(
    """almost barely hardly kinda kindof kind-of less little marginally occasionally partly
    scarcely slightly somewhat sorta sortof sort-of""".split()
) | {"just enough", "kind of", "sort of"}
NEGATIONS = frozenset(
    """aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't
    didn't doesn't dont hadnt hasnt havent isnt mightnt mustnt neither don't hadn't hasn't haven't
    isn't mightn't mustn't neednt needn't never none nope nor not nothing nowhere oughtnt shant
    shouldnt uhuh wasnt werent oughtn't shan't shouldn't uh-uh wasn't weren't without wont wouldnt
    won't wouldn't rarely seldom despite""".split()
)
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "yeah right": -2.0, "cut the mustard": 2.0,
    "kiss of death": -1.5, "hand to mouth": -2.0,
}
# One of these in front of or behind a plain word is taken off it.
_MARKS = r"""(?:[.!?,;:'"-]|!!!?|\?\?\??|\?!\?!?|!\?!\??)"""
_PLAIN = r"""([^!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~ ]{2,}+)"""
MARKED_WORD = rf"(?<![^ ])(?:{_MARKS}{_PLAIN}|{_PLAIN}{_MARKS})(?![^ ])"


@dataclass(frozen=True)
class Rules:
    """Word lists of the rules; the defaults are the published ones."""

    raising: frozenset[str] = RAISING
    lowering: frozenset[str] = LOWERING
    negations: frozenset[str] = NEGATIONS
    idioms: dict[str, float] = field(default_factory=lambda: dict(IDIOMS))
    contrast: str = "but"


def sentiment_words(text: Column) -> Column:
    """Whitespace words of two or more characters, freed of one mark before or behind.

    A mark is only taken off a word that holds no other punctuation, so contractions and most
    emoticons stay whole.
    """
    freed = F.regexp_replace(spaced(text), MARKED_WORD, "$1$2")
    return F.filter(F.split(freed, " "), lambda w: F.length(w) > 1)


def _is_caps(word: Column) -> Column:
    """All cased characters are upper case, and there is at least one."""
    return (F.upper(word) == word) & (F.lower(word) != word)


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def punctuation_emphasis(text: Column) -> Column:
    """Up to four `!` at 0.292; two or three `?` at 0.18 each, more 0.96."""
    shouts, asks = _count(text, "!"), _count(text, "?")
    asked = F.when(asks > 3, 0.96).when(asks > 1, asks * 0.18).otherwise(0.0)
    return F.least(shouts, F.lit(4)) * 0.292 + asked


def _neighbourhood(texts: DataFrame, key: str, text: str, rules: Rules) -> DataFrame:
    """One row per word: the word, three before, two behind, and the facts of its text. The others are taken
    from the text's words by place, so that a broadcast lexicon looks only at the word itself."""
    words = F.col("_words")
    contrast_at = F.when(
        F.lower(F.col("_text")).contains(rules.contrast),
        F.array_position(F.transform(words, F.lower), rules.contrast),
    ).otherwise(F.lit(0))
    per_text = (
        texts.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
        .withColumn("_words", sentiment_words(F.col("_text")))
        .select(
            "_id",
            "_words",
            (F.exists(words, _is_caps) & F.exists(words, lambda w: ~_is_caps(w))).alias("_mixed"),
            contrast_at.alias("_contrast"),
            punctuation_emphasis(F.col("_text")).alias("_emphasis"),
        )
    )
    facts = ["_id", "_mixed", "_contrast", "_emphasis"]
    each = per_text.select(*facts, "_words", F.posexplode_outer("_words").alias("_pos", "w")).where(F.col("w").isNotNull())
    around = {"p1": -1, "p2": -2, "p3": -3, "x1": 1, "x2": 2}
    near = (F.get(words, F.col("_pos") + by).alias(name) for name, by in around.items())
    return each.select(*facts, "_pos", "w", *near)


def _one_of(word: str, words: Iterable[str]) -> Column:
    """Membership of a column in a fixed list. One SQL text: a call per word would dominate the
    time it takes to build the plan."""
    quoted = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in sorted(words))
    return F.expr(f"{word} in ({quoted})")


def _marks(rules: Rules) -> dict[str, Column]:
    """What each of the three words before says, computed once: `bI` weight as an intensifier, `cI`
    emphasised by capitals, `nI` negates; and whether the word itself is silent."""
    singles = {w for w in rules.raising | rules.lowering if " " not in w}
    kind_of = (F.lower("w") == "kind") & F.coalesce(F.lower("x1") == "of", F.lit(False))
    marks = {
        "c0": F.col("_mixed") & _is_caps(F.col("w")),
        "silent": _one_of("lower(w)", singles) | kind_of,
    }
    for i in (1, 2, 3):
        raised, lowered = (_one_of(f"l{i}", words) for words in (rules.raising, rules.lowering))
        marks[f"b{i}"] = F.when(raised, STEP).when(lowered, -STEP)
        marks[f"c{i}"] = F.col("_mixed") & _is_caps(F.col(f"p{i}"))
        marks[f"n{i}"] = _one_of(f"l{i}", rules.negations) | F.col(f"l{i}").contains("n't")
    return marks


def _with_idioms(v: Column, rules: Rules) -> Column:
    """An idiom around the word replaces its valence; the longest behind it counts most. A two-word
    dampener in front lowers it."""
    idioms = F.create_map(*(F.lit(x) for pair in sorted(rules.idioms.items()) for x in pair))
    behind = (("w", "x1", "x2"), ("w", "x1"))
    before = (("p1", "w"), ("p2", "p1", "w"), ("p2", "p1"), ("p3", "p2", "p1"), ("p3", "p2"))
    found = v
    if rules.idioms:
        said = (F.try_element_at(idioms, F.concat_ws(" ", *places)) for places in (*behind, *before))
        found = F.coalesce(*said, v)
    pairs = [w for w in sorted(rules.raising | rules.lowering) if " " in w]
    if not pairs:
        return found
    hedged = F.concat_ws(" ", "p3", "p2").isin(*pairs) | F.concat_ws(" ", "p2", "p1").isin(*pairs)
    return found + F.when(hedged, -STEP).otherwise(0.0)


def _apply_rules(hits: DataFrame, rules: Rules) -> DataFrame:
    """The valence of each hit from its neighbours, rule by rule (`v` starts as the lexicon value).

    Each step is a projection of its own, because each mentions the valence before it several times.
    """
    v, p1, p2, p3 = (F.col(c) for c in ("v", "p1", "p2", "p3"))
    away = F.when(v > 0, CAPS).otherwise(-CAPS)
    hits = hits.withColumns(_marks(rules)).withColumn("v", F.when(F.col("c0"), v + away).otherwise(v))
    soothing = p1.isin("so", "this")
    special = {
        2: ((p2 == "never") & soothing, 1.5),
        3: (((p3 == "never") & p2.isin("so", "this")) | soothing, 1.25),
    }
    for i, damp in enumerate(DAMPING, start=1):
        weight = F.when(v < 0, -F.col(f"b{i}")).otherwise(F.col(f"b{i}"))
        weight = weight + F.when(F.col(f"c{i}"), away).otherwise(0.0)
        factor = F.when(F.col(f"n{i}"), NEGATED).otherwise(1.0)
        if i in special:
            factor = F.when(special[i][0], special[i][1]).otherwise(factor)
        judged = (v + F.coalesce(weight, F.lit(0.0)) * damp) * factor
        if i == 3:
            # Bound, so that the phrases stay out of the generated method: beyond 8000 bytes of
            # code the JVM would no longer compile it, and this stage reads every word.
            judged = bound(judged, lambda value: _with_idioms(value, rules))
        plain = F.col(f"p{i}").isNotNull() & ~F.col(f"k{i}")
        hits = hits.withColumn("v", F.when(plain, judged).otherwise(v))
    least = (F.col("l1") == "least") & ~F.col("k1")
    spared = F.coalesce(F.col("l2").isin("at", "very"), F.lit(False))
    return hits.withColumn(
        "v", F.when(F.col("silent"), 0.0).when(least & ~spared, v * NEGATED).otherwise(v)
    )


def word_valences(
    texts: DataFrame, lexicon: DataFrame, key: str, text: str, rules: Rules = Rules()
) -> DataFrame:
    """One row per lexicon word found: `_id, w, _pos, v, _part, _emphasis`.

    `lexicon(token, valence)`: tokens lower-case; of a repeated one the largest valence counts.
    """
    known = lexicon.groupBy("token").agg(F.max(F.col("valence").cast("double")).alias("v"))
    small = fits_broadcast(known)
    place = ["_id", "_pos"]
    rows = _neighbourhood(texts, key, text, rules).withColumn("token", F.lower("w"))
    hits = dictionary_join(rows, known, "token", "inner", small, place).drop("token")
    for i in (1, 2, 3):
        other = known.select(F.col("token").alias(f"l{i}"), F.lit(True).alias(f"k{i}"))
        hits = dictionary_join(
            hits.withColumn(f"l{i}", F.lower(f"p{i}")), other, f"l{i}", "left", small, place
        ).withColumn(f"k{i}", F.coalesce(f"k{i}", F.lit(False)))
    at, here = F.col("_contrast"), F.col("_pos") + 1
    part = F.when((at == 0) | (here == at), 1.0).when(here < at, 0.5).otherwise(1.5)
    return _apply_rules(hits, rules).select("_id", "w", "_pos", "v", part.alias("_part"), "_emphasis")


def sentiment(
    texts: DataFrame, lexicon: DataFrame, key: str, text: str, rules: Rules = Rules()
) -> DataFrame:
    """`(key, compound)` for the texts with at least one lexicon word; the others score 0.0.

    A repeated word is judged by the surroundings of its first occurrence, as the scorer does. The
    sum runs in DECIMAL, so it does not depend on the order in which partitions arrive.
    """
    valences = word_valences(texts, lexicon, key, text, rules)
    per_word = (
        valences.repartition("_id")
        .groupBy("_id", "w")
        .agg(
            F.min_by("v", "_pos").alias("v"),
            F.sum("_part").alias("parts"),
            F.first("_emphasis").alias("_emphasis"),
        )
    )
    total = F.sum((F.col("v") * F.col("parts")).cast("decimal(28,12)")).cast("double")
    per_text = per_word.groupBy("_id").agg(total.alias("s"), F.first("_emphasis").alias("e"))
    s = F.when(F.col("s") > 0, F.col("s") + F.col("e")).when(F.col("s") < 0, F.col("s") - F.col("e")).otherwise(0.0)
    return per_text.select("_id", s.alias("s")).select(
        F.col("_id").alias(key), F.round(F.col("s") / F.sqrt(F.col("s") * F.col("s") + NORMALISER), 4).alias("compound")
    )
