"""User analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterscope.functions import accounts as ac
from chatterscope.operators.activity import bursts
from chatterscope.params import Thresholds


def account_measures(users: DataFrame, limits: Thresholds, as_of: int) -> DataFrame:
    """Account age, the two flags, and the criteria met. Row-local."""
    return (
        users.withColumn("account_age", ac.account_age(F.col("created_utc"), as_of))
        .withColumn("low_karma", ac.low_karma(F.col("total_karma"), limits.karma))
        .withColumn("young_account", ac.young_account(F.col("account_age"), limits.account_age_years))
        .withColumn("flags", ac.account_flags(F.col("low_karma"), F.col("young_account")))
    )


def user_analysis(
    users: DataFrame, activity: DataFrame, limits: Thresholds, as_of: int
) -> DataFrame:
    """All user columns plus account measures and burst activity.

    The burst side is reduced to users with a burst before it meets `users`.
    """
    found = bursts(activity, limits.inactivity_days, limits.burst_days)
    return (
        account_measures(users, limits, as_of)
        .join(found, "redditor", "left")
        .withColumn("burst_activity", F.col("burst_count").isNotNull())
        .withColumn("burst_count", F.coalesce("burst_count", F.lit(0)))
        .withColumn("max_burst_size", F.coalesce("max_burst_size", F.lit(0)))
    )
