"""Account measures as column functions. `as_of` is always a parameter, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatterscope.params import DAY


def whole_days(start: Column, end: Column) -> Column:
    """Floored days between two epoch-second values; negative gaps floor downwards."""
    return F.floor((end - start) / DAY)


def account_age(created_utc: Column, as_of: int) -> Column:
    """Age in years: whole days since creation over 365.25; null when creation is unknown."""
    return whole_days(created_utc.cast("double"), F.lit(as_of)) / F.lit(365.25)


def low_karma(total_karma: Column, threshold: int) -> Column:
    return F.coalesce(total_karma < threshold, F.lit(False))


def young_account(age_years: Column, threshold: float) -> Column:
    return F.coalesce(age_years <= threshold, F.lit(False))


def account_flags(low: Column, young: Column) -> Column:
    """The criteria met, as a list of labels."""
    return F.array_compact(F.array(F.when(low, "Low Karma"), F.when(young, "Young Account Age")))


def dormant_days(first_activity: Column, created_utc: Column) -> Column:
    """Days between account creation and the first activity seen."""
    return whole_days(created_utc, first_activity).cast("int")
