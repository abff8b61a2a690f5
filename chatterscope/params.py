"""Settings, passed as plain parameters (no global configuration)."""

from __future__ import annotations

from dataclasses import dataclass

DAY = 86_400


@dataclass(frozen=True)
class Thresholds:
    """Limits of the account measures.

    The field defaults are the fall-backs used when a setting is absent. ``karma`` has no
    fall-back, so it is required. ``REPORT_PRESET`` holds the values the reports run with.
    """

    karma: int
    account_age_years: float = 1.0
    inactivity_days: int = 3
    burst_days: int = 1
    comments_limit: int = 250
    submissions_limit: int = 100

    def __post_init__(self):
        if self.inactivity_days <= 0 or self.burst_days < 0:
            raise ValueError("inactivity_days must be positive and burst_days not negative")


def parse_limit(value, when_absent: int, when_unreadable: int) -> int:
    """A row limit from a settings value: absent and unreadable have their own fall-back."""
    if value is None:
        return when_absent
    try:
        return int(value)
    except (TypeError, ValueError):
        return when_unreadable


# The settings template of the reports.
REPORT_PRESET = Thresholds(
    karma=500,
    account_age_years=0.5,
    inactivity_days=3,
    burst_days=1,
    comments_limit=250,
    submissions_limit=250,
)
