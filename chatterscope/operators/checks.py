"""Data checks and counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Values of `key` held by more than one row (nulls do not clash)."""
    return (
        df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    )


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """Fail when two rows share a non-null `key`. Runs one aggregation with map-side combine."""
    clash = duplicate_keys(df, key).first()
    if clash is not None:
        raise ValueError(f"{key} is not unique: {clash[key]!r} occurs {clash['n']} times")
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what} to process")
    return df


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def require_keys(record: Column, keys: Sequence[str], what: str) -> Column:
    """Pass a map through, failing the query when one of the keys is absent (null is allowed)."""
    absent = F.array_except(F.array(*map(F.lit, keys)), F.map_keys(record))
    return F.when(F.size(absent) == 0, record).otherwise(
        F.raise_error(F.concat(F.lit(f"{what} lacks "), F.array_join(absent, ", ")))
    )


def counted(df: DataFrame, name: str, **extra: Column) -> tuple[DataFrame, Observation]:
    """Count rows (and extra aggregates) while the frame is being written anyway."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in extra.items())), seen
