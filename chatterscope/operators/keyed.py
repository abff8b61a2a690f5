"""One row per key, and the newest rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterscope.operators.joins import salt, salt_count

_RANK = "_rank"


def _top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    ranked = df.withColumn(_RANK, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(_RANK) <= n).drop(_RANK)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order ("last write wins": sequence descending).

    The rank limit is applied before the shuffle as well, so each map task sends at most one row
    per key and a hot key stays small.
    """
    return _top(df, keys, order, 1)


def newest_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, row_id: Sequence[str]
) -> DataFrame:
    """The n first rows of each group.

    Up to Spark's group-limit threshold the rank is cut map-side. Above it, a first round ranks
    within (key, salt), which is exact because a row among the n first of its key is also among the
    n first of any subset of that key.
    """
    spark = df.sparkSession
    if n > int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        salted = df.withColumn("_salt", salt(row_id, salt_count(spark)))
        df = _top(salted, [*keys, "_salt"], order, n).drop("_salt")
    return _top(df, keys, order, n)


def listing(
    posts: DataFrame, community: str, method: str, limit: int,
    created: str = "submission_created_utc", score: str = "submission_score",
    row_id: str = "submission_id",
) -> DataFrame:
    """A community's listing from stored posts: `new` by time, `top` by score."""
    by = {"new": created, "top": score}
    if method not in by:
        raise ValueError(f"unsupported listing: {method}")
    order = [F.col(by[method]).desc(), F.col(row_id).asc()]
    return newest_per_group(posts, [community], order, limit, [row_id])


def profiles(sightings: DataFrame) -> DataFrame:
    """One profile per user name out of all sightings during a harvest.

    Columns: `name`, `role` ('submission' or 'comment'), `seq`, and the profile. A submission
    author's profile replaces what was there; a comment author's is only added when absent. So the
    last submission-author sighting wins, and without one the first comment-author sighting. Equal
    sightings are told apart by all their columns, so the result does not depend on partitions.
    """
    posted = F.col("role") == "submission"
    order = [
        posted.desc(),
        F.when(posted, F.col("seq")).desc(),
        F.when(~posted, F.col("seq")).asc(),
        *(F.col(c).asc() for c in sightings.columns if c not in ("name", "role", "seq")),
    ]
    return latest(sightings, ["name"], order)
