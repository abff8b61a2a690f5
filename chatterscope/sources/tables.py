"""Stored tables as Parquet snapshots, optionally bucketed by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterscope import schemas


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One snapshot with its declared schema."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{root}/{name}")


def write_table(df: DataFrame, root: str, name: str) -> None:
    """Publish a snapshot. An existing one is never replaced: each run takes a new root."""
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.TABLES[name]]
    df.select(*columns).write.mode("errorifexists").parquet(f"{root}/{name}")


def write_bucketed(df: DataFrame, table: str, name: str, buckets: int, path: str) -> None:
    """Publish as a catalog table bucketed and sorted by its key, in a folder that executors share.

    The reports join everything on that key, so they then need no exchange of the wide rows.
    """
    key = schemas.PRIMARY_KEY[name]
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet")
    writer.option("path", path).saveAsTable(table)


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """What a cleared table holds."""
    return spark.createDataFrame([], schemas.TABLES[name])


def comments_scan(comments: DataFrame) -> DataFrame:
    """All comments, whoever wrote them, by id."""
    return comments.select(*schemas.COMMENTS.names).orderBy("comment_id")


def users_scan(users: DataFrame) -> DataFrame:
    return users.select(*schemas.USERS.names).orderBy("redditor_id")


def submissions_by_author(submissions: DataFrame, author: str) -> DataFrame:
    return submissions.where(F.col("author") == author)


def comments_by_submission(comments: DataFrame, submission_id: str) -> DataFrame:
    return comments.where(F.col("link_id") == submission_id)
