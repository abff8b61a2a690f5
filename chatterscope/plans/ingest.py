"""Ingest: landed records to the three stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatterscope import schemas
from chatterscope.operators.checks import counted, require_rows
from chatterscope.operators.gates import admit_comments, admit_submissions
from chatterscope.operators.keyed import latest
from chatterscope.operators.merge import upsert, upsert_users
from chatterscope.sources import landing
from chatterscope.sources.snapshots import Snapshots, Updates
from chatterscope.sources.tables import write_table


@dataclass(frozen=True)
class Tables:
    users: DataFrame
    submissions: DataFrame
    comments: DataFrame

    def publish(self, root: str) -> dict[str, int]:
        """Write a new snapshot of all three tables; the rows of each, counted while written."""
        rows = {}
        for name in ("users", "submissions", "comments"):
            table, seen = counted(getattr(self, name), f"{name}-{uuid.uuid4()}")
            write_table(table, root, name)
            rows[name] = seen.get["rows"]
        return rows


@dataclass(frozen=True)
class Landed:
    """Parsed landing records: users keyed by name, submissions with nested comments, and what could
    not be read (kind, file, json, reason)."""

    users: DataFrame
    submissions: DataFrame
    rejects: DataFrame


def parse_landing(users: DataFrame, submissions: DataFrame) -> Landed:
    """Landed records of both kinds (key where the layout has one, json, file, place), parsed."""
    rejects = (
        landing.rejected_records(records, schema).select(F.lit(kind).alias("kind"), "file", "json", "reason")
        for kind, records, schema in (
            ("user", users, schemas.LANDED_USER), ("submission", submissions, schemas.LANDED_SUBMISSION)
        )
    )
    return Landed(
        landing.parse_users(users), landing.parse_submissions(submissions), reduce(DataFrame.unionByName, rejects)
    )


def read_landing(
    spark: SparkSession, users: Sequence[str], submissions: Sequence[str], layout: str = "indented"
) -> Landed:
    """Read landed files of one or more communities (all of them, appended).

    `indented` is the harvest's own single-object layout, `objects` the same in any other layout, `lines`
    one record per line.
    """
    layouts = {"indented": landing.read_indented, "objects": landing.read_objects, "lines": landing.read_lines}
    if layout not in layouts:
        raise ValueError(f"unsupported layout: {layout}")
    read = layouts[layout]
    return parse_landing(read(spark, users), read(spark, submissions))


def landed_comments(submissions: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Comments by people under the last record of each submission, with its `place`."""
    posts = landing.latest_submissions(submissions, order)
    return landing.written_by_people(landing.flatten_comments(posts, carry=["place"]))


def accepted_names(users: DataFrame) -> DataFrame:
    """`redditor` of the users that can be stored."""
    return landing.with_id(users).select(F.col("key").alias("redditor"))


def load_counts(landed: Landed) -> DataFrame:
    """`(what, n)`: rows a load finds, accepts and rejects."""
    flat = landing.written_by_people(landing.flatten_comments(landed.submissions))
    counted_rows = {
        "users found": landed.users, "users accepted": landing.with_id(landed.users),
        "submissions found": landed.submissions, "comments kept": flat, "records rejected": landed.rejects,
    }
    # Grouped by their name, the counts need one job; a name without rows is not listed.
    named = (df.select(F.lit(what).alias("what")) for what, df in counted_rows.items())
    return reduce(DataFrame.unionByName, named).groupBy("what").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Admitted:
    """What a load puts into the tables: rows, and the order in which a key's first row stands."""

    users: DataFrame
    submissions: DataFrame
    comments: DataFrame
    order: Sequence[Column]


#: What becomes of a table, named, that several steps read.
Keep = Callable[[DataFrame, str], DataFrame]


def admit(
    landed: Landed, stored_comments: DataFrame, gate: str = "row", order: Sequence[Column] | None = None,
    keep: Keep = lambda table, name: table,
) -> Admitted:
    """The landed rows that pass the gates. There must be users and submissions to load.

    `order` ranks records of one key, the winner first; the default takes the one that stands last,
    files by name. The gates look at the comments several times: `keep` may store them.
    """
    require_rows(landed.users, "users")
    require_rows(landed.submissions, "submissions")
    order = list(order) if order else [F.col("place").desc()]
    accepted = landing.with_id(landed.users)
    names = landed.users.select(F.col("key").alias("redditor"))
    user_rows = landing.to_user_rows(latest(accepted, ["redditor_id"], order), carry=["place"])
    posts = landing.latest_submissions(landed.submissions, order)
    admitted = admit_submissions(landing.to_submission_rows(posts, carry=["place"]), names, gate)
    flat = keep(landed_comments(landed.submissions, order), "comments")
    new = admit_comments(flat, accepted_names(landed.users), stored_comments, gate)
    return Admitted(user_rows, admitted, new, [F.col("place").desc()])


def ingest(
    landed: Landed, stored: Tables, gate: str = "row", order: Sequence[Column] | None = None
) -> Tables:
    """Merge landed records into the stored tables, lazily; two ids with one name fail the users' merge when
    it is computed."""
    new = admit(landed, stored.comments, gate, order)
    return Tables(
        upsert_users(stored.users, new.users, new.order),
        upsert(stored.submissions, new.submissions, "submission_id", new.order),
        upsert(stored.comments, new.comments, "comment_id", new.order),
    )


def load(landed: Landed, stored: Snapshots, gate: str = "row", order: Sequence[Column] | None = None) -> int:
    """Merge landed records into versioned tables: only the parts that get new rows are rewritten, and all
    three tables change together or not at all. The new version. Records are parsed once, and their comments
    flattened once, however often the gates look at them: both are stored until the version is there or the
    load fails."""
    at = f"{stored.root}/staged/{uuid.uuid4().hex}"
    keep = _kept(at)
    try:
        parsed = Landed(keep(landed.users, "users"), keep(landed.submissions, "submissions"), landed.rejects)
        new = admit(parsed, stored.read("comments"), gate, order, keep)
        return stored.load({name: Updates(getattr(new, name), new.order) for name in ("users", "submissions", "comments")})
    finally:
        stored.folder.delete(at.removeprefix(f"{stored.root}/"))


def _kept(at: str) -> Keep:
    """Tables written to a folder once and read from there."""

    def keep(table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{at}/{name}")
        return table.sparkSession.read.schema(table.schema).parquet(f"{at}/{name}")

    return keep


def _staged(records: DataFrame, schema: T.StructType, at: str, **extra: Column) -> tuple[DataFrame, dict[str, int]]:
    """Records parsed and written once, and what was counted meanwhile. Each written task counts once, also
    where tasks are run again: the counts are taken in the stage that writes."""
    read = landing.parsed(records, schema)
    rejected = F.col("_why").isNotNull()
    kept = read.withColumns({"json": F.when(rejected, F.col("json")), "_r": F.when(~rejected, F.col("_r"))})
    rows, seen = counted(kept, f"staged-{uuid.uuid4()}", rejected=F.count_if(rejected), found=F.count_if(~rejected), **extra)
    rows.write.parquet(at)
    return records.sparkSession.read.schema(kept.schema).parquet(at), seen.get


def load_counted(
    users: DataFrame, submissions: DataFrame, stored: Snapshots, gate: str = "row", order: Sequence[Column] | None = None
) -> int:
    """`load` of landed records (as `parse_landing` takes them), each parsed once, however often the gates look
    at it, and counted while its fields are stored for them. The counts of `load_counts` are published
    with the version: `Snapshots.counters`. The stored fields go when the version is there or the load fails."""
    at = f"{stored.root}/staged/{uuid.uuid4().hex}"
    has_id = F.col("_r.redditor_id").isNotNull() & (F.col("_r.redditor_id") != "")
    said = F.filter("_r.comments", lambda c: c.isNotNull() & landing.by_people(c["comment_author"]))
    try:
        people, of_users = _staged(users, schemas.LANDED_USER, f"{at}/users", accepted=F.count_if(F.col("_why").isNull() & has_id))
        posts, of_posts = _staged(
            submissions, schemas.LANDED_SUBMISSION, f"{at}/submissions",
            comments=F.sum(F.when(F.col("_why").isNull() & F.col("_r.comments").isNotNull(), F.size(said)).otherwise(0)),
        )
        rejects = (
            landing.without_fields(records).select(F.lit(kind).alias("kind"), "file", "json", "reason")
            for kind, records in (("user", people), ("submission", posts))
        )
        landed = Landed(
            landing.user_fields(people), landing.submission_fields(posts), reduce(DataFrame.unionByName, rejects)
        )
        new = admit(landed, stored.read("comments"), gate, order, _kept(at))
        updates = {name: Updates(getattr(new, name), new.order) for name in ("users", "submissions", "comments")}
        counters = {
            "users found": of_users["found"], "users accepted": of_users["accepted"],
            "submissions found": of_posts["found"], "comments kept": of_posts["comments"] or 0,
            "records rejected": of_users["rejected"] + of_posts["rejected"],
        }
        return stored.load(updates, counters=counters)
    finally:
        stored.folder.delete(at.removeprefix(f"{stored.root}/"))
