"""Submission analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterscope.functions import text as tx
from chatterscope.operators.duplicates import duplicate_ids
from chatterscope.operators.entities import as_brackets, entities
from chatterscope.operators.joins import attach, planned_small
from chatterscope.operators.sentiment import Rules, sentiment


def submissions_of_known_users(submissions: DataFrame, users: DataFrame) -> DataFrame:
    """Submissions whose author is a stored user (exact case).

    User names are unique, so the inner join against them is a semi join; written as one it also
    cannot fan out. A very active author is spread over many tasks.
    """
    authors = users.select(F.col("redditor").alias("author")).distinct()
    return attach(submissions, authors, ["author"], ["submission_id"], "left_semi")


def submission_analysis(
    submissions: DataFrame, lexicon: DataFrame, gazetteer: DataFrame, rules: Rules = Rules()
) -> DataFrame:
    """All submission columns plus title measures and the duplicate flag.

    Titles differ from comment bodies: the raw title is analysed, lexical diversity is the plain
    ratio over raw tokens, entities are bracketed with their label, and the flag is a boolean.
    """
    toks = tx.tokens(F.col("title"))
    scores = sentiment(submissions, lexicon, "submission_id", "title", rules)
    found = entities(submissions, gazetteer, "submission_id", "title")
    marks = duplicate_ids(submissions, ["author", "title", "url"], "submission_id").withColumn(
        "is_duplicate", F.lit(True)
    )
    compound = F.coalesce("compound", F.lit(0.0))
    known = F.col("title").isNotNull()
    return (
        submissions.withColumn("_t", toks)
        .withColumns(
            {
                "lexical_diversity": tx.distinct_ratio(F.col("_t")),
                "common_bigrams": tx.leading_bigrams(F.col("_t")),
            }
        )
        .drop("_t")
        .join(scores, "submission_id", "left")
        .join(found, "submission_id", "left")
        .join(marks, "submission_id", "left")
        .withColumns(
            {
                "sentiment": F.when(known, tx.scored(compound, 3, tx.sentiment_label(compound))),
                "named_entities": F.when(known, as_brackets(F.col("entities"))),
                "is_duplicate": F.coalesce("is_duplicate", F.lit(False)),
            }
        )
        .drop("compound", "entities")
    )


def submission_report(
    submissions: DataFrame, users: DataFrame, lexicon: DataFrame, gazetteer: DataFrame,
    rules: Rules = Rules(),
) -> DataFrame:
    """The analysis of the submissions of known users.

    Names that are planned small are broadcast, and only admitted submissions are analysed. Otherwise
    admission is decided on (id, author) alone and joined last, by id like everything else, so the
    wide rows move once. The flags are the same either way: duplicates share their author, so they
    are admitted together.
    """
    if planned_small(users.select("redditor")):
        known = submissions_of_known_users(submissions, users)
        return submission_analysis(known, lexicon, gazetteer, rules)
    authors = submissions.select("submission_id", "author")
    admitted = submissions_of_known_users(authors, users).select("submission_id")
    analysis = submission_analysis(submissions, lexicon, gazetteer, rules)
    return analysis.join(admitted, "submission_id", "left_semi")
