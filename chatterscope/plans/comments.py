"""Comment analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterscope.functions import text as tx
from chatterscope.operators.duplicates import duplicate_ids, yes_no
from chatterscope.operators.entities import Tagger, as_words, entities, plugged_entities
from chatterscope.operators.joins import attach
from chatterscope.operators.sentiment import Rules, sentiment

#: What a text's measures show if its analysis failed.
ERROR = {"sentiment": "Error", "named_entities": "", "lexical_diversity": "Error", "common_bigrams": ""}


def distinct_bodies(comments: DataFrame) -> DataFrame:
    """Each non-empty stripped body once, with its digest as key."""
    body = comments.where(F.col("body").isNotNull() & (F.col("body") != "")).select(
        tx.strip(F.col("body")).alias("text")
    )
    return body.select(F.sha2("text", 256).alias("text_key"), "text").dropDuplicates(["text_key"])


def analyse_texts(
    texts: DataFrame, lexicon: DataFrame, gazetteer: DataFrame, key: str, text: str,
    rules: Rules = Rules(), tagger: Tagger | None = None,
) -> DataFrame:
    """Add `sentiment, named_entities, lexical_diversity, common_bigrams`; `key` is unique.

    Diversity and bigrams are row-local, the bigrams from the text's first words; scores and entities come back as narrow rows by key. A tagger
    takes the gazetteer's place; a text on which it fails shows `ERROR` for all four, other rows go on.
    """
    diversity = tx.lexical_diversity(F.col(text))
    local = texts.withColumns(
        {"_ld": diversity, "common_bigrams": tx.leading_bigrams(tx.opening_tokens(F.col(text)))}
    ).withColumns(
        {"_score": F.col("_ld.score"), "lexical_diversity": tx.scored(F.col("_ld.score"), 2, F.col("_ld.label"))}
    )
    joined = (
        local.drop("_ld")
        .join(sentiment(texts, lexicon, key, text, rules), key, "left")
        .join(entities(texts, gazetteer, key, text) if tagger is None else plugged_entities(texts, tagger, key, text), key, "left")
    )
    compound = F.coalesce("compound", F.lit(0.0))
    known = F.col("_score").isNotNull()
    analysed = joined.withColumns(
        {
            "sentiment": F.when(known, tx.scored(compound, 3, tx.sentiment_label(compound))),
            "named_entities": F.when(known, as_words(F.col("entities"))),
        }
    ).drop("_score", "compound", "entities")
    if tagger is None:
        return analysed
    shown = {c: F.when(F.col("failed"), F.lit(v)).otherwise(F.col(c)) for c, v in ERROR.items()}
    return analysed.withColumns(shown).drop("failed")


def _with_duplicate_flag(analysed: DataFrame, comments: DataFrame) -> DataFrame:
    marks = duplicate_ids(comments, ["body"], "comment_id").withColumn("_dup", F.lit(True))
    flag = yes_no(F.coalesce("_dup", F.lit(False)))
    return analysed.join(marks, "comment_id", "left").withColumn("is_duplicate", flag).drop("_dup")


def comment_analysis(
    comments: DataFrame, lexicon: DataFrame, gazetteer: DataFrame, rules: Rules = Rules(), tagger: Tagger | None = None
) -> DataFrame:
    """All comment columns plus the four text measures and the duplicate flag.

    Everything per text is either row-local or keyed by `comment_id`, so the wide rows are shuffled
    once, by that key (not at all from a bucketed table), and a popular body cannot skew a task.
    A null body keeps its row, with null measures.
    """
    stripped = comments.withColumn("_text", tx.strip(F.col("body")))
    analysed = analyse_texts(stripped, lexicon, gazetteer, "comment_id", "_text", rules, tagger)
    return _with_duplicate_flag(analysed.drop("_text"), comments)


def comment_analysis_per_text(
    comments: DataFrame, lexicon: DataFrame, gazetteer: DataFrame, rules: Rules = Rules()
) -> DataFrame:
    """The same result with each distinct body analysed once and the results joined back.

    Worth it when many bodies repeat: it trades repeated analysis for one more shuffle of the text.
    """
    texts = distinct_bodies(comments)
    measures = analyse_texts(texts, lexicon, gazetteer, "text_key", "text", rules).drop("text")
    keyed = comments.withColumn("text_key", F.sha2(tx.strip(F.col("body")), 256))
    # An empty body is no text to analyse; it shows what an all-blank one would.
    blank = {
        "sentiment": "0.000 (Neutral)", "named_entities": "",
        "lexical_diversity": "0.00 (No text)", "common_bigrams": "",
    }
    joined = attach(keyed, measures, ["text_key"], ["comment_id"], "left").drop("text_key")
    for column, value in blank.items():
        shown = F.when(F.col("body").isNotNull(), F.lit(value))
        joined = joined.withColumn(column, F.coalesce(column, shown))
    return _with_duplicate_flag(joined, comments)
