"""Joins that hold at scale: size-checked broadcasts, and salting for hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast up to so many rows and up to this share of an executor's memory.
BROADCAST_ROW_LIMIT = 1_000_000
BROADCAST_SHARE = 1 / 16
#: Up to this share where the size is the one planned.
PLANNED_SHARE = 1 / 64
_SALT = "_salt"


def salt_count(spark: SparkSession) -> int:
    """As many salts as shuffle partitions: a hot key then fills the cluster."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def salt(row_id: Sequence[str], salts: int) -> Column:
    """A salt that depends on the row only, so a recomputed task gives the same one."""
    return F.pmod(F.xxhash64(*row_id), F.lit(salts)).cast("int")


def executor_bytes(spark: SparkSession) -> int:
    said = spark.conf.get("spark.executor.memory", "1g").strip().lower().removesuffix("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    return int(said[:-1]) * unit[said[-1]] if said[-1] in unit else int(said) << 20


def measured(dim: DataFrame, *more: Column) -> tuple[bool, tuple]:
    """Whether a side may be broadcast, by its rows and text bytes, and further aggregates of it, all
    in one pass."""
    widths = (F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in dim.columns)
    size = F.sum(reduce(Column.__add__, widths))
    rows, total, *rest = dim.agg(F.count("*"), size, *more).first()
    limit = executor_bytes(dim.sparkSession) * BROADCAST_SHARE
    return rows <= BROADCAST_ROW_LIMIT and (total or 0) <= limit, tuple(rest)


def fits_broadcast(dim: DataFrame) -> bool:
    return measured(dim)[0]


def planned_small(dim: DataFrame) -> bool:
    """Whether a side may be broadcast, without running it: by the optimizer's size of its plan, which
    starts from the bytes of the files read. Files are compressed, hence the smaller share."""
    planned = int(str(dim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return planned <= executor_bytes(dim.sparkSession) * PLANNED_SHARE


def dictionary_join(
    rows: DataFrame, dim: DataFrame, on: str, how: str, small: bool, row_id: Sequence[str]
) -> DataFrame:
    """Look words up in a dictionary table keyed by `on` (unique in `dim`).

    Measured small: broadcast, so the exploded words are never shuffled. Otherwise the dictionary is
    first cut down to the words that occur, which combine map-side; where those are few enough they
    are broadcast. Else both sides are shuffled on (word, salt), with the words that occur repeated
    once per salt, because word frequencies are always skewed.
    """
    if small:
        return rows.join(F.broadcast(dim), on, how)
    dim = dim.join(rows.select(on).distinct(), on, "left_semi")
    if fits_broadcast(dim):
        return rows.join(F.broadcast(dim), on, how)
    salts = salt_count(rows.sparkSession)
    copies = dim.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn(_SALT, salt(row_id, salts)).join(copies, [on, _SALT], how).drop(_SALT)


def attach(
    left: DataFrame, right: DataFrame, on: Sequence[str], row_id: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join `right` (unique on `on`) to `left`, whose keys may be arbitrarily hot.

    Nothing runs while the plan is built. A right side that is planned small is broadcast, and `left` is
    neither shuffled nor read twice. Otherwise: the keys present on the left are reduced to distinct (key, salt) pairs, at most `salts` per
    key, and only those meet `right` on the bare key. The wide rows are then shuffled once, on
    (key, salt), so a key holding a third of all rows is spread over `salts` tasks.
    `how`: inner, left, left_semi or left_anti.
    """
    on = list(on)
    needed = right.select(*on) if how in ("left_semi", "left_anti") else right
    if planned_small(needed):
        return left.join(F.broadcast(needed), on, how)
    salts = salt_count(left.sparkSession)
    salted = left.withColumn(_SALT, salt(row_id, salts))
    pairs = salted.select(*on, _SALT).distinct()
    if how in ("left_semi", "left_anti"):
        known = pairs.join(right.select(*on), on, "left_semi")
        return salted.join(known, [*on, _SALT], how).drop(_SALT)
    known = pairs.join(right, on, "inner")
    return salted.join(known, [*on, _SALT], how).drop(_SALT)
