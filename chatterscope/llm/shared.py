"""Helpers that the operators share: the shared folder, column hygiene, batches of text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a vectorised kernel works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session, whose executors are the driver's own threads, may leave it unset.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="llm-"))
    return f"file://{_own[0]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it from there.

    Cuts the lineage: what follows reads files that outlive any executor, and ids drawn while
    writing stay as they are. The files stay until they are released or the folder is emptied by its owner.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    for made in _made:
        made.append(found)
    return found


#: Spark removes a query's shuffle files when it ends, not when the driver happens to collect its garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The tables stored since each running function that releases them began.
_made: list[list[DataFrame]] = []


def release(table: DataFrame) -> None:
    """Delete a table that `stored` gave and that nothing to come reads; one made otherwise has no files."""
    if not hasattr(table, "stored_at"):
        return
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def releases(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For a function whose result is a stored table: the others that it stored on the way are released."""

    @wraps(fn)
    def run(*args, **named) -> DataFrame:
        made: list[DataFrame] = []
        _made.append(made)
        try:
            result = fn(*args, **named)
        finally:
            _made[:] = [m for m in _made if m is not made]
        for table in made:
            if table.stored_at != result.stored_at:
                release(table)
        return result

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id, divisor: int, remainder: int):
    """Whether crc32 of the decimal doc_id leaves `remainder`; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor == remainder


def steps(texts: list[bytes], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [first, last) of texts whose bytes stay near `limit`."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def text_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """A column's strings; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def bytes_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A column's strings in UTF-8; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def unused(df: DataFrame, name: str) -> str:
    """`name`, or a variant of it that is no column of `df` in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Values (of some 20 bytes) of a measured table up to which a join broadcasts it; beyond, both sides are
#: shuffled.
BROADCAST_VALUES = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """`df`, a stored narrow table, marked for broadcast if it was counted and is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_VALUES else df
