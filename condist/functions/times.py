"""Epoch arithmetic on TIMESTAMP_NTZ columns that hold UTC; independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def micros(column: str) -> Column:
    """Microseconds since the epoch."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {column})")


def moment(column: str) -> Column:
    """The timestamp of microseconds since the epoch."""
    return F.expr(f"timestampadd(MICROSECOND, {column}, {EPOCH})")


def window_end(us: str, interval: int) -> Column:
    """End of the right-closed window of ``interval`` microseconds that holds ``us``: itself if aligned, else the next multiple."""
    return F.expr(f"({us} + {interval} - 1) div {interval} * {interval}")
