"""Report sheets: fixed headers, checked for presence, written as Parquet or CSV."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatterscope.operators.checks import counted, require_columns

# Report headers in order, with the column each one shows.
COMMENT_HEADERS = {
    "Comment ID": "comment_id",
    "Author": "comment_author",
    "Created ON": "comment_created_utc",
    "Body": "body",
    "Comment Score": "comment_score",
    "Is Submitter": "is_submitter",
    "Edited": "edited",
    "Submission ID": "link_id",
    "Sentiment": "sentiment",
    "Named Entities": "named_entities",
    "Lexical Diversity": "lexical_diversity",
    "Common Bigrams": "common_bigrams",
    "Is Duplicate": "is_duplicate",
}
SUBMISSION_HEADERS = {
    "Submission ID": "submission_id",
    "Author": "author",
    "Title": "title",
    "Score": "submission_score",
    "URL": "url",
    "Sentiment": "sentiment",
    "Named Entities": "named_entities",
    "Lexical Diversity": "lexical_diversity",
    "Common Bigrams": "common_bigrams",
    "Is Duplicate": "is_duplicate",
}
USER_HEADERS = {
    "User ID": "redditor_id",
    "Username": "redditor",
    "Account Created": "created_utc",
    "Link Karma": "link_karma",
    "Comment Karma": "comment_karma",
    "Total Karma": "total_karma",
    "Is Employee": "is_employee",
    "Is Gold": "is_gold",
    "Dormant Days": "dormant_days",
    "Has Verified Email": "has_verified_email",
    "Accepts Followers": "accepts_followers",
    "Is Subscriber": "redditor_is_subscriber",
    "Account Age": "account_age",
    "Low Karma": "low_karma",
    "Young Account": "young_account",
    "Burst Activity": "burst_activity",
}


def _cell(df: DataFrame, column: str) -> Column:
    text = isinstance(df.schema[column].dataType, T.StringType)
    return F.coalesce(column, F.lit("")) if text else F.col(column)


def sheet(analysis: DataFrame, headers: dict[str, str]) -> DataFrame:
    """The report's columns under their headers; a missing text shows as blank."""
    require_columns(analysis, list(headers.values()))
    return analysis.select(*(_cell(analysis, c).alias(h) for h, c in headers.items()))


def write_report(analysis: DataFrame, headers: dict[str, str], path: str, fmt: str = "parquet") -> None:
    """Write one report; an empty analysis is an error, raised when the empty sheet has been written:
    rows are counted while they are written, so the analysis runs once. Row order belongs to the
    reader, so the rows are written as they are, without a global sort."""
    report, seen = counted(sheet(analysis, headers), f"report-{uuid.uuid4()}")
    writer = report.write.mode("errorifexists")
    if fmt == "csv":
        # Text cells hold line breaks and quotes: both are escaped the way spreadsheets read them.
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)
    if not seen.get["rows"]:
        raise ValueError("no rows to process")


def indented_parts(root: str) -> list[str]:
    """The folders of an object written by `write_indented`, in their order."""
    return [f"{root.rstrip('/')}/1-records", f"{root.rstrip('/')}/2-end"]


def write_indented(df: DataFrame, key: str, root: str) -> None:
    """Records as one JSON object by `key`, in the harvest's layout: indented by four spaces, each record
    ending at the first level, so that `landing.read_indented` splits it. Non-ASCII text is kept.

    The object is written by many tasks, in the order of its keys. Its text is that of all files, folders
    and files by name. What opens it belongs to its first record, and what closes it is written last: the
    object of a writer that died has no end. A null key fails the write; records of one key are all written.
    """
    named = F.when(F.col(key).isNotNull(), F.col(key).cast("string")).otherwise(F.raise_error(F.lit(f"{key} is null")))
    quoted = F.to_json(F.struct(named.alias("k")))
    quoted = F.substring(quoted, 6, F.length(quoted) - 6)
    fields = [c for c in df.columns if c != key]
    record = F.to_json(F.struct(*fields), {"pretty": "true", "ignoreNullFields": "false"}) if fields else F.lit("{ }")
    # The writer indents by two spaces a level and puts one before a colon; no text holds a raw line break.
    record = F.regexp_replace(record, r'(?m)^( *+"(?:[^"\\]++|\\.)*+") : ', "$1: ")
    record = F.regexp_replace(F.regexp_replace(record, r"(?m)^( +)", "$1$1"), r"\n", "\n    ")
    in_order = df.repartitionByRange(key).sortWithinPartitions(key).select(F.concat(F.lit("    "), quoted, F.lit(": "), record).alias("entry"))
    first = F.monotonically_increasing_id() == 0
    opened = in_order.select(F.when(first, F.concat(F.lit("{\n"), "entry")).otherwise(F.concat(F.lit(",\n"), "entry")).alias("value"))
    opening = F.count(F.when(F.col("value").startswith("{"), 1))
    text, seen = counted(opened, f"object-{uuid.uuid4()}", opening=opening)
    records, end = indented_parts(root)
    text.write.mode("errorifexists").text(records)
    rows = seen.get["rows"]
    if rows and seen.get["opening"] != 1:
        raise ValueError(f"{records} does not begin with its first record")
    spark = df.sparkSession
    spark.range(1).select(F.lit("}" if rows else "{}").alias("value")).write.mode("errorifexists").text(end)


def write_lines(df: DataFrame, path: str) -> None:
    """Landed records as newline-delimited JSON; non-ASCII text is kept as it is."""
    df.write.mode("errorifexists").json(path)
