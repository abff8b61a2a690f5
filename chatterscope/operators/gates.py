"""Which landed rows are admitted to the tables.

`row` admits each row on its own merit (the evident intent). `group` reproduces what the loading
procedure does when run: one admitted row opens the gate for everything loaded with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterscope.operators.joins import attach

GATES = ("row", "group")


def _check(gate: str) -> None:
    if gate not in GATES:
        raise ValueError(f"gate must be one of {GATES}")


def admit_submissions(submissions: DataFrame, names: DataFrame, gate: str = "row") -> DataFrame:
    """Submissions whose author has a landed profile. `names`: one column `redditor`.

    `group`: all of them as soon as one author is known, else none.
    """
    _check(gate)
    authors = names.select(F.col("redditor").alias("author")).distinct()
    if gate == "row":
        return attach(submissions, authors, ["author"], ["submission_id"], "left_semi")
    known = submissions.select("author").distinct().join(authors, "author", "left_semi")
    return submissions.where(known.exists())


def new_comments(comments: DataFrame, stored: DataFrame) -> DataFrame:
    """Comments not stored yet; stored ones are skipped, not refreshed."""
    return comments.join(stored.select("comment_id"), "comment_id", "left_anti")


def admit_comments(
    comments: DataFrame, accepted: DataFrame, stored: DataFrame, gate: str = "row",
    group: str = "submission_id",
) -> DataFrame:
    """Comments to upsert. `accepted`: one column `redditor`, the users that were loaded.

    `row`: a new comment by an accepted author. `group`: all comments landed under a submission
    that has at least one such comment.
    """
    _check(gate)
    authors = accepted.select(F.col("redditor").alias("comment_author")).distinct()
    narrow = comments.select("comment_id", "comment_author", group)
    opening = attach(
        new_comments(narrow, stored), authors, ["comment_author"], ["comment_id"], "left_semi"
    )
    if gate == "row":
        return comments.join(opening.select("comment_id").distinct(), "comment_id", "left_semi")
    return attach(comments, opening.select(group).distinct(), [group], ["comment_id"], "left_semi")
