"""Calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_ending_friday(day: Column) -> Column:
    """The Friday that closes the Saturday-to-Friday week holding ``day``."""
    return F.next_day(F.date_sub(day, 1), "FRI")
