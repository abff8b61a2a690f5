"""Comments as they arrive, merged into versioned tables.

A feed delivers rows again. A row that equals one delivered within the watermark's delay goes no further:
of each row seen the state holds its key and a digest, and drops them when the watermark has passed. What
is left of a batch is one load of `sources.snapshots`, under the number of the batch, so a batch that is run
again after a failure is loaded once. A row that changed since it was stored takes its place; of the rows
of one batch the last in file and row stands.

A row is late if its time is not newer than the watermark, the newest time seen less the delay, as of the batch
before its own. It is not merged; `late_rows` counts it. If none is late, the table is what the last row of
each key makes of the whole feed at once, provided that files land in the order of their names. Rows
without a key are left out; a row without a time is never late, nor known to be a repetition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chatterscope import schemas
from chatterscope.sources.snapshots import Snapshots, Updates


def comment_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Comment rows as their Parquet files land, each with its `place`."""
    rows = spark.readStream.schema(schemas.COMMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    start, row = F.col("_metadata.file_block_start"), F.col("_metadata.row_index")
    place = F.struct(F.col("_metadata.file_path").alias("file"), start.alias("start"), row.alias("row"))
    return rows.select("*", place.alias("place"))


def without_repetitions(comments: DataFrame, delay: str) -> DataFrame:
    """The stream's rows less those that equal one within the delay."""
    told = F.struct(*schemas.COMMENTS.names)
    return (
        comments.where(F.col("comment_id").isNotNull())
        .withColumn("_at", F.timestamp_seconds("comment_created_utc"))
        .withColumn("_told", F.unhex(F.sha2(F.to_json(told), 256)))
        .withWatermark("_at", delay)
        .dropDuplicatesWithinWatermark(["comment_id", "_told"])
        .drop("_at", "_told")
    )


def merge_stream(comments: DataFrame, store: Snapshots, feed: str, checkpoint: str, delay: str) -> StreamingQuery:
    """Merge all that has landed and was not merged yet, a version for each batch that holds rows.

    `feed` names this stream in the versions, and belongs to one checkpoint.
    """

    def merge(rows: DataFrame, batch: int) -> None:
        # Either way all of the batch runs, and runs once: that is what stores its state.
        if store.holds((feed, batch)):
            rows.write.format("noop").mode("overwrite").save()
        else:
            store.load({"comments": Updates(rows, [F.col("place").desc()])}, (feed, batch))

    return (
        without_repetitions(comments, delay)
        .writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that came too late, over the batches that the query's progress still names
    (`spark.sql.streaming.numRecentProgressUpdates`)."""
    states = (state for progress in query.recentProgress for state in progress["stateOperators"])
    return sum(state["numRowsDroppedByWatermark"] for state in states)
