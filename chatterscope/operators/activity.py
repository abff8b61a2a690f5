"""Activity over time: first activity, dormancy, and bursts after silence.

Activity rows: `redditor string, created_utc bigint (epoch seconds), kind string, item_id`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatterscope.functions.accounts import dormant_days
from chatterscope.operators.joins import attach
from chatterscope.operators.keyed import newest_per_group
from chatterscope.params import DAY

# A window partition spans this many silence-plus-burst periods of one user.
_SPANS = 8


def activity_log(comments: DataFrame, submissions: DataFrame) -> DataFrame:
    """A user's comments and submissions as one log."""
    said = comments.select(
        F.col("comment_author").alias("redditor"),
        F.col("comment_created_utc").alias("created_utc"),
        F.lit("comment").alias("kind"),
        F.col("comment_id").alias("item_id"),
    )
    posted = submissions.select(
        F.col("author").alias("redditor"),
        F.col("submission_created_utc").alias("created_utc"),
        F.lit("submission").alias("kind"),
        F.col("submission_id").alias("item_id"),
    )
    return said.unionByName(posted)


def newest_activity(activity: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The newest items of each user, comments and submissions limited separately."""
    order = [F.col("created_utc").desc(), F.col("item_id").desc()]
    if len(set(limits.values())) == 1:
        rows = activity.where(F.col("kind").isin(*limits))
        return newest_per_group(rows, ["redditor", "kind"], order, max(limits.values()), ["item_id"])
    parts = (
        newest_per_group(activity.where(F.col("kind") == kind), ["redditor"], order, n, ["item_id"])
        for kind, n in limits.items()
    )
    return reduce(DataFrame.unionByName, parts)


def first_activity(activity: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """`(redditor, first_activity)`: the oldest of each user's items, or, with `limits`, of the newest
    ones that a harvest of so many items would see."""
    seen = newest_activity(activity, limits) if limits else activity
    return seen.groupBy("redditor").agg(F.min("created_utc").alias("first_activity"))


def dormancy(
    users: DataFrame, activity: DataFrame, as_of: int, limits: dict[str, int] | None = None
) -> DataFrame:
    """Days from account creation to first activity; a user without activity counts to `as_of`."""
    seen = first_activity(activity, limits)
    joined = users.select("redditor_id", "redditor", "created_utc").join(seen, "redditor", "left")
    first = F.coalesce("first_activity", F.lit(as_of).cast("bigint"))
    return joined.select(
        "redditor_id", "redditor", first.alias("first_activity"),
        dormant_days(first, F.col("created_utc")).alias("dormant_days"),
    )


def burst_starts(activity: DataFrame, inactivity_days: int, burst_days: int) -> DataFrame:
    """`(redditor, created_utc, events)` for each activity that ends a silence of at least
    `inactivity_days`, with the events in the closed window of `burst_days` from it. A user's very
    first activity is included here, as a silence without beginning.

    A hot user is split by time. Events are first counted per second, with map-side combine; a
    window partition then covers one user and a fixed span of time, and holds at most one row per
    second of it, however many events a bot produced. Each span also sees the seconds just before
    and after it, so both frames are complete.
    """
    silence, burst = inactivity_days * DAY, burst_days * DAY
    span = _SPANS * (silence + burst)
    seconds = activity.where(F.col("redditor").isNotNull() & F.col("created_utc").isNotNull()).groupBy(
        "redditor", "created_utc"
    ).agg(F.count("*").alias("n"))
    t = F.col("created_utc")
    home = F.floor(t / span)
    offset = F.pmod(t, F.lit(span))
    seen_from = F.array_compact(
        F.array(
            home,
            F.when(offset > span - silence, home + 1),
            F.when(offset <= burst, home - 1),
        )
    )
    spread = seconds.select("redditor", "created_utc", "n", home.alias("home"), F.explode(seen_from).alias("span"))
    timeline = Window.partitionBy("redditor", "span").orderBy("created_utc")
    before = F.sum("n").over(timeline.rangeBetween(1 - silence, -1))
    following = F.sum("n").over(timeline.rangeBetween(0, burst))
    return (
        spread.withColumn("_before", before)
        .withColumn("events", following)
        .where((F.col("home") == F.col("span")) & F.col("_before").isNull())
        .select("redditor", "created_utc", "events")
    )


def bursts(activity: DataFrame, inactivity_days: int, burst_days: int, least: int = 2) -> DataFrame:
    """`(redditor, burst_count, max_burst_size)` for the users with at least one burst.

    A burst needs a silence with a beginning, so a user's first activity starts none. Starts are at
    least one silence apart, which bounds the window below by the length of the history.
    """
    starts = burst_starts(activity, inactivity_days, burst_days)
    per_user = Window.partitionBy("redditor").orderBy("created_utc")
    return (
        starts.withColumn("_earlier", F.lag("created_utc").over(per_user))
        .where(F.col("_earlier").isNotNull() & (F.col("events") >= least))
        .groupBy("redditor")
        .agg(F.count("*").alias("burst_count"), F.max("events").alias("max_burst_size"))
    )


def activity_of_users(activity: DataFrame, users: DataFrame) -> DataFrame:
    """Activity by known users only; a hot user's rows are spread over many tasks."""
    return attach(activity, users.select("redditor"), ["redditor"], ["item_id"], "left_semi")
