"""Duplicate flags: every member of a group that holds more than one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterscope.functions.text import normalized

#: Keys that are broadcast on the way back: the most frequent ones, 32 bytes each.
HOT_KEYS = 1000


def digest(*keys: Column) -> Column:
    """A fixed-width stand-in for the normalised key texts; null as soon as one key is null.

    Shuffling 32 bytes instead of whole bodies keeps the wide text out of the exchange. Each part
    is hashed first, so that parts cannot run into each other.
    """
    parts = [F.unhex(F.sha2(normalized(k), 256)) for k in keys]
    return parts[0] if len(parts) == 1 else F.unhex(F.sha2(F.concat(*parts), 256))


def duplicate_ids(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """Ids of the rows that share their normalised key with another row.

    Counting combines map-side, so a hot key sends one row per task. On the way back the most
    frequent keys, a fixed number of them, are broadcast: their rows are known to be duplicates, and
    look for a value of their own among the counts, which spreads them. No key that is left holds
    more than one row in `HOT_KEYS`.
    """
    rows = df.select(row_id, digest(*(F.col(k) for k in keys)).alias("_key")).where(F.col("_key").isNotNull())
    counted = rows.groupBy("_key").agg(F.count("*").alias("_n"))
    repeated = counted.where(F.col("_n") > 1)
    hot = repeated.orderBy(F.col("_n").desc(), "_key").limit(HOT_KEYS).select("_key", F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(hot), "_key", "left")
    sought = F.when(F.col("_hot"), F.unhex(F.sha2(F.col(row_id).cast("string"), 512))).otherwise(F.col("_key"))
    marked = marked.withColumn("_key", sought)
    found = marked.join(repeated.select("_key", F.lit(True).alias("_found")), "_key", "left")
    return found.where("_hot or _found").select(row_id)


def flag_duplicates(
    df: DataFrame, keys: Sequence[str], row_id: str, name: str = "is_duplicate"
) -> DataFrame:
    """Add a boolean flag. Rows with a null key are never duplicates."""
    marks = duplicate_ids(df, keys, row_id).withColumn(name, F.lit(True))
    return df.join(marks, row_id, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").otherwise("No")
