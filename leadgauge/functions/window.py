"""The rolling window that ends at `as_of`.

Bounds take the type of the column they are compared with, so the comparison needs no cast on the column and reaches
the Parquet scan as a pushed filter.
"""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AsOf = datetime | str


class Clock:
    """Moments derived from `as_of`, typed like one timestamp column of a table."""

    def __init__(self, df: DataFrame, column: str, as_of: AsOf, months: int) -> None:
        zoned = isinstance(df.schema[column].dataType, T.TimestampType)
        self._type = "timestamp" if zoned else "timestamp_ntz"
        self._column = F.col(column)
        self._months = months
        if not isinstance(as_of, datetime):
            as_of = datetime.fromisoformat(as_of)
        if as_of.tzinfo is not None:
            # One moment for all columns: the session's wall clock, which a column without zone is read by.
            zone = ZoneInfo(df.sparkSession.conf.get("spark.sql.session.timeZone"))
            as_of = as_of.astimezone(zone).replace(tzinfo=None)
        self.now = F.lit(as_of.isoformat(sep=" ")).cast(self._type)

    @property
    def month_ago(self) -> Column:
        """Calendar months; a day past the end of the earlier month becomes its last day."""
        return self.now - F.make_ym_interval(F.lit(0), F.lit(self._months))

    @property
    def today(self) -> Column:
        """Midnight at the start of the day of `as_of`."""
        return self.now.cast("date").cast(self._type)

    @property
    def month_ago_midnight(self) -> Column:
        return self.month_ago.cast("date").cast(self._type)

    @property
    def tomorrow(self) -> Column:
        return F.date_add(self.now.cast("date"), 1).cast(self._type)

    def between(self, low: Column | str) -> Column:
        """From `low` to `as_of`, both included."""
        return self._column.between(F.lit(low).cast(self._type), self.now)

    def in_window(self) -> Column:
        """The rolling window, both ends included."""
        return self.between(self.month_ago)


def in_window(df: DataFrame, column: str, as_of: AsOf, months: int) -> Column:
    return Clock(df, column, as_of, months).in_window()
