"""Landed JSON: one object per file, keyed by user name or submission id, or one record per line.

The harvest writes its object indented by four spaces. A raw line break cannot occur inside a JSON
string, so a line break, four spaces and a closing brace always end one top-level record. Reading
with that separator makes the single object splittable: no task holds a whole file. Objects in other
layouts are split too, at a higher price (`read_objects`).

Nothing is lost without a trace: what is no record is returned by `rejected_records`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatterscope import schemas
from chatterscope.functions.text import WHITESPACE, bound
from chatterscope.operators.checks import require_keys
from chatterscope.operators.keyed import latest
from chatterscope.sources.objects import stretches

_RECORD_END = "\n    }"
#: A key that no record has.
_MARK = "end of the stretch"


def split_communities(spec: str) -> list[str]:
    """`a+b+c` names three communities."""
    return spec.split("+")


def community_paths(root: str, spec: str) -> list[str]:
    """The landing folders of the communities in `spec`, to be read together; one that is named twice is
    read twice."""
    return [f"{root.rstrip('/')}/{name}" for name in split_communities(spec)]


def read_indented(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """`(key, json, file, place)` for each top-level entry of JSON objects; see `entries`."""
    text = spark.read.option("lineSep", _RECORD_END).text(list(paths))
    return entries(_with_place(text))


def read_objects(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The same for objects in any layout; see `sources.objects`."""
    return entries(stretches(spark, paths))


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """`(json, file, place)` for newline-delimited records: the layout for large feeds."""
    return lines(_with_place(spark.read.text(list(paths))))


def _with_place(text: DataFrame) -> DataFrame:
    """`place` orders rows as they stand in the files, files by name. The running number is drawn where
    the file is read: it grows along a block, and blocks are told apart by their start."""
    start = F.coalesce(F.col("_metadata.file_block_start"), F.lit(0))
    file = F.col("_metadata.file_path")
    return text.select(
        "value", file.alias("file"),
        F.struct(file.alias("file"), start.alias("start"), F.monotonically_increasing_id().alias("row")).alias("place"),
    )


def lines(text: DataFrame) -> DataFrame:
    """`(json, file, place)` of the lines that are not blank."""
    return text.where(F.trim("value", F.lit(WHITESPACE)) != "").select(F.col("value").alias("json"), "file", "place")


def entries(text: DataFrame) -> DataFrame:
    """`(key, json, file, place)` of each entry in stretches of JSON objects (value, file, place).

    A stretch ends where the separator stood, or at the end of the file. It is closed by a mark of its
    own and parsed as one object: only if the mark is found again has all of it been read. So entries
    may be indented, compact, empty or null, and any number of them may share a stretch. A stretch that
    cannot be read whole gives one row without key, and is rejected when its records are parsed. So does one
    that is said not to be `whole`.
    """
    inner = F.regexp_replace("value", r"\A[\s\x{feff}]*[{,]?\s*", "")
    # The separator was cut off, or the file ends with the object's own brace.
    inside = F.concat(F.lit("{"), inner, F.lit(_RECORD_END), F.lit(f',"{_MARK}":1}}'))
    body = F.regexp_replace(inner, r"\s*,?\s*\}\s*\z", "")
    at_end = F.concat(F.lit("{"), body, F.when(body != "", F.lit(",")).otherwise(""), F.lit(f'"{_MARK}":1}}'))
    rest = F.regexp_replace(inner, r"[\s{}]", "") == ""
    read = lambda json: bound(
        F.map_entries(F.from_json(json, "map<string,string>")),
        lambda e: F.when(F.exists(e, lambda x: x["key"] == _MARK), F.filter(e, lambda x: x["key"] != _MARK)),
    )
    broken = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("value").alias("value")))
    nothing = F.filter(broken, lambda x: F.lit(False))
    found = F.coalesce(read(inside), read(at_end), broken)
    if "whole" in text.columns:
        found = F.when(F.col("whole"), found).otherwise(broken)
    found = F.when(rest, nothing).otherwise(found)
    each = text.select("file", "place", F.posexplode(found).alias("entry", "e"))
    return each.select(
        F.col("e.key").alias("key"), F.coalesce("e.value", F.lit("null")).alias("json"), "file",
        F.struct("place.*", "entry").alias("place"),
    )


def parsed(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Records with their fields in `_r` and, where they are no such object, the reason in `_why`."""
    with_corrupt = T.StructType([*schema, T.StructField("_corrupt", T.StringType())])
    record = F.from_json("json", with_corrupt, {"columnNameOfCorruptRecord": "_corrupt"})
    read = records.withColumn("_r", record)
    is_object = F.ltrim("json", F.lit(WHITESPACE)).startswith("{")
    why = F.when(~is_object, "not an object").when(F.col("_r").isNull() | F.col("_r._corrupt").isNotNull(), "malformed")
    if "key" in records.columns:
        why = F.when(F.col("key").isNull(), "unreadable stretch").otherwise(why)
    return read.withColumn("_why", why)


def rejected_records(records: DataFrame, schema: T.StructType) -> DataFrame:
    """`(file, json, reason)` of what could not be read as records of that schema."""
    return without_fields(parsed(records, schema))


def without_fields(records: DataFrame) -> DataFrame:
    """`(file, json, reason)` of the parsed records that could not be read."""
    return records.where("_why is not null").select("file", "json", F.col("_why").alias("reason"))


def parse_users(records: DataFrame) -> DataFrame:
    """Profile fields of landed user records, next to the record's other columns. What is no such
    record is left to `rejected_records`.

    Without a `key` column (newline-delimited records) the profile's own name is the key.
    """
    return user_fields(parsed(records, schemas.LANDED_USER))


def user_fields(records: DataFrame) -> DataFrame:
    """The fields of parsed user records."""
    found = records.where("_why is null").drop("_why")
    if "key" not in records.columns:
        found = found.withColumn("key", F.col("_r.redditorname"))
    return found.select("*", "_r.*").drop("json", "_r", "_corrupt")


def parse_submissions(records: DataFrame) -> DataFrame:
    """Submission fields of landed records; `comments` stays nested. What is no such record is left to
    `rejected_records`."""
    return submission_fields(parsed(records, schemas.LANDED_SUBMISSION))


def submission_fields(records: DataFrame) -> DataFrame:
    """The fields of parsed submission records."""
    found = records.where("_why is null").drop("_why").select("*", "_r.*").drop("json", "_r", "_corrupt")
    if "key" in records.columns:
        return found.drop("submission_id").withColumnRenamed("key", "submission_id")
    return found


def truthy(value: Column) -> Column:
    """A landed `false`, number or text as a boolean: null, false, zero and empty are false."""
    return ~F.lower(F.coalesce(value, F.lit(""))).isin("", "false", "0", "0.0", "null")


def bare_link(link_id: Column) -> Column:
    """Drop the `t3_` in front of a link id."""
    return F.when(link_id.startswith("t3_"), F.substring(link_id, 4, 2**31 - 1)).otherwise(link_id)


def flatten_comments(submissions: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per nested comment, typed; a submission without comments gives none.

    A comment that lacks a key fails the query.
    """
    required = require_keys(F.col("_c"), schemas.COMMENT_KEYS, "landed comment")
    # The outer form keeps Spark from inferring a size filter that would parse the record twice.
    nested = submissions.select("submission_id", *carry, F.explode_outer("comments").alias("_c"))
    c = nested.where(F.col("_c").isNotNull()).select("submission_id", *carry, required.alias("_c"))
    value = lambda k: F.col("_c")[k]
    return c.select(
        "submission_id",
        *carry,
        value("comment_id").alias("comment_id"),
        value("comment_author").alias("comment_author"),
        value("comment_created_utc").cast("double").cast("bigint").alias("comment_created_utc"),
        value("body").alias("body"),
        value("comment_score").cast("double").cast("int").alias("comment_score"),
        value("is_submitter").cast("boolean").alias("is_submitter"),
        truthy(value("edited")).alias("edited"),
        bare_link(value("link_id")).alias("link_id"),
    )


# The site's own accounts, compared in lower case.
SYSTEM_AUTHORS = ("automoderator", "reddit")


def written_by_people(comments: DataFrame) -> DataFrame:
    """Drop comments without an author and those by system accounts."""
    return comments.where(by_people(F.col("comment_author")))


def by_people(author: Column) -> Column:
    return author.isNotNull() & ~F.lower(author).isin(*SYSTEM_AUTHORS)


def with_author_label(submissions: DataFrame) -> DataFrame:
    return submissions.withColumn("author", F.coalesce("author", F.lit("Deleted")))


def harvestable(profiles: DataFrame) -> DataFrame:
    """Profiles worth keeping: with a creation time and link karma, not the `deleted` name, and not
    a moderator (where the profile says so itself, both marks must agree)."""
    moderates = F.col("is_mod")
    if "user_is_moderator" in profiles.columns:
        moderates = moderates & F.col("user_is_moderator")
    return profiles.where(
        F.col("created_utc").isNotNull()
        & F.col("link_karma").isNotNull()
        & (F.lower("redditorname") != "deleted")
        & ~F.coalesce(moderates, F.lit(False))
    )


def with_flag_defaults(profiles: DataFrame) -> DataFrame:
    for flag in ("has_verified_email", "accept_followers", "redditor_is_subscriber"):
        profiles = profiles.withColumn(flag, F.coalesce(flag, F.lit(False)))
    return profiles


def with_id(users: DataFrame) -> DataFrame:
    """Landed users that can be stored. The others are counted by `rejected_users`."""
    return users.where(F.col("redditor_id").isNotNull() & (F.col("redditor_id") != ""))


def rejected_users(users: DataFrame) -> DataFrame:
    return users.where(F.col("redditor_id").isNull() | (F.col("redditor_id") == ""))


def to_user_rows(users: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Rename and narrow landed users to the columns of the `users` table."""
    named = users.select(
        *carry,
        *(
            F.col({"redditor": "redditorname", "accepts_followers": "accept_followers"}.get(f.name, f.name))
            .cast(f.dataType)
            .alias(f.name)
            for f in schemas.USERS
        ),
    )
    return named


def to_submission_rows(submissions: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    return submissions.select(
        *carry, *(F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.SUBMISSIONS)
    )


def latest_submissions(submissions: DataFrame, order: Sequence[Column]) -> DataFrame:
    """One record per submission id: the last one written."""
    return latest(submissions, ["submission_id"], order)
