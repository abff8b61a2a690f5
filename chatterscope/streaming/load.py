"""Landed submission records as a file stream.

Each micro-batch stores the records it has read, parsed, in a directory of its own, named by its number
and overwritten on a retry: a lost executor or a restarted query stores nothing twice. What the records
mean for the comments table depends on all of them (the last record of a submission counts, and a gate
may be opened by another batch), so `loaded` decides it over what has been stored, by the rules of
`plans.ingest`. How files fall into batches makes no difference.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from chatterscope import schemas
from chatterscope.operators.gates import admit_comments
from chatterscope.operators.merge import upsert
from chatterscope.plans.ingest import landed_comments
from chatterscope.sources import landing

_PLACE = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("row", T.LongType())]
)
_STORED = T.StructType([*schemas.LANDED_SUBMISSION, T.StructField("place", _PLACE)])
_REJECTED = T.StructType([T.StructField(name, T.StringType()) for name in ("file", "json", "reason")])


def landed_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """`(value, file, start)` of newline-delimited records as they land."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    start = F.coalesce(F.col("_metadata.file_block_start"), F.lit(0))
    return lines.select("value", F.col("_metadata.file_path").alias("file"), start.alias("start"))


def store_batch(text: DataFrame, root: str, batch: int) -> None:
    """Write the records of one batch, and what could not be read as one."""
    place = F.struct("file", "start", F.monotonically_increasing_id().alias("row")).alias("place")
    records = landing.lines(text.select("value", "file", place))
    posts = landing.parse_submissions(records).select(*schemas.LANDED_SUBMISSION.names, "place")
    posts.write.mode("overwrite").parquet(f"{root}/records/batch={batch}")
    rejects = landing.rejected_records(records, schemas.LANDED_SUBMISSION)
    rejects.write.mode("overwrite").parquet(f"{root}/rejects/batch={batch}")


def load_stream(
    spark: SparkSession, landing_path: str, root: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Store all landed files that were not stored yet. `root` must exist."""
    return (
        landed_stream(spark, landing_path, files_per_batch)
        .writeStream.foreachBatch(lambda df, batch: store_batch(df, root, batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def records(spark: SparkSession, root: str) -> DataFrame:
    """All stored submission records. The schema is declared, so none read as none."""
    return spark.read.schema(_STORED).parquet(f"{root}/records")


def rejects(spark: SparkSession, root: str) -> DataFrame:
    """`(file, json, reason)` of what the stream could not read."""
    return spark.read.schema(_REJECTED).parquet(f"{root}/rejects")


def loaded(
    spark: SparkSession, root: str, accepted: DataFrame, stored: DataFrame, gate: str = "row",
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """The comments table after the records stored so far: `stored` as it was before the stream began,
    and the admitted comments. `accepted`: one column `redditor`."""
    order = list(order) if order else [F.col("place").desc()]
    new = admit_comments(landed_comments(records(spark, root), order), accepted, stored, gate)
    return upsert(stored, new, "comment_id", [F.col("place").desc()])


def checkpoint_folder(spark: SparkSession, name: str, default: str | None = None) -> str:
    """A stream's own folder inside the shared one the cluster names for checkpoints; `default` is
    taken only where it names none, and must be shared by driver and executors too. `name` must belong
    to one stream: it holds its progress."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or default
    if not shared:
        raise ValueError("spark.checkpoint.dir is not set")
    return f"{shared.rstrip('/')}/{name}"
