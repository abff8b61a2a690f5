"""Snapshot merge: upsert as a pure DataFrame function, published to a new directory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterscope.operators.keyed import latest

_STORED, _CLASH = "_stored", "_clash"


def upsert(
    target: DataFrame, updates: DataFrame, key: str, order: Sequence[Column]
) -> DataFrame:
    """Replace or add rows by key; a key repeated in the batch keeps its first row in `order`.

    Stored and new rows are ranked together, new ones first, so each side is computed once and both
    are shuffled once, by key. `key` is unique in `target` and not null.
    """
    both = target.withColumn(_STORED, F.lit(True)).unionByName(
        updates.withColumn(_STORED, F.lit(False)), allowMissingColumns=True
    )
    return latest(both, [key], [F.col(_STORED).asc(), *order]).select(*target.columns)


def upsert_users(target: DataFrame, updates: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Upsert by id; computing the result fails when two ids carry one name."""
    return with_unique(upsert(target, updates, "redditor_id", order), "redditor", "redditor_id")


def with_unique(df: DataFrame, column: str, key: str) -> DataFrame:
    """`df`, which fails when computed if two of its rows share a non-null value of `column`.

    The check is part of the plan: nothing is computed before, and nothing twice. Rows without a value are
    spread by their key, so that they never meet in one task.
    """
    value = F.col(column)
    same = Window.partitionBy(value, F.when(value.isNull(), F.col(key)))
    clash = F.concat(F.lit(f"{column} is not unique: "), value)
    several = value.isNotNull() & (F.count(F.lit(1)).over(same) > 1)
    return df.withColumn(_CLASH, several).where(F.when(F.col(_CLASH), F.raise_error(clash)).otherwise(True)).drop(_CLASH)
