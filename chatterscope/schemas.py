"""Declared schemas of the stored tables and of the landed records (no inference)."""

from pyspark.sql import types as T


def _fields(kind: T.DataType, names: str) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names.split()]


_TEXT, _INT, _LONG, _REAL, _FLAG = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()

USERS = T.StructType(
    [
        *_fields(_TEXT, "redditor_id redditor"),
        *_fields(_LONG, "created_utc"),
        *_fields(_INT, "link_karma comment_karma total_karma"),
        *_fields(_FLAG, "is_employee is_mod is_gold"),
        *_fields(_INT, "dormant_days"),
        *_fields(_FLAG, "has_verified_email accepts_followers redditor_is_subscriber"),
    ]
)

SUBMISSIONS = T.StructType(
    [
        *_fields(_TEXT, "submission_id author title"),
        *_fields(_INT, "submission_score"),
        *_fields(_TEXT, "url"),
        *_fields(_LONG, "submission_created_utc"),
        *_fields(_FLAG, "over_18"),
    ]
)

COMMENTS = T.StructType(
    [
        *_fields(_TEXT, "comment_id comment_author"),
        *_fields(_LONG, "comment_created_utc"),
        *_fields(_TEXT, "body"),
        *_fields(_INT, "comment_score"),
        *_fields(_FLAG, "is_submitter edited"),
        *_fields(_TEXT, "link_id"),
    ]
)

# Landed numbers may be floats (times, floored day counts), so they are read as DOUBLE and
# narrowed on load. `user_is_moderator` belongs to the harvested profile, not to the table.
LANDED_USER = T.StructType(
    [
        *_fields(_TEXT, "redditor_id redditorname"),
        *_fields(_REAL, "created_utc link_karma comment_karma total_karma"),
        *_fields(_FLAG, "is_employee is_mod is_gold"),
        *_fields(_REAL, "dormant_days"),
        *_fields(_FLAG, "has_verified_email accept_followers redditor_is_subscriber user_is_moderator"),
    ]
)

# A comment is read as a map so that a missing key differs from a null value, and so that
# `edited` (false, or the time of the edit) keeps its text.
LANDED_SUBMISSION = T.StructType(
    [
        *_fields(_TEXT, "submission_id author title"),
        *_fields(_REAL, "submission_score"),
        *_fields(_TEXT, "url"),
        *_fields(_REAL, "submission_created_utc"),
        *_fields(_FLAG, "over_18"),
        *_fields(T.ArrayType(T.MapType(T.StringType(), T.StringType())), "comments"),
    ]
)

COMMENT_KEYS = tuple(f.name for f in COMMENTS)

PRIMARY_KEY = {"users": "redditor_id", "submissions": "submission_id", "comments": "comment_id"}
TABLES = {"users": USERS, "submissions": SUBMISSIONS, "comments": COMMENTS}
