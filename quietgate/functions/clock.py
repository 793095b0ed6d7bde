"""Time as whole microseconds, whatever timestamp type a table uses."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp column; no session time zone is involved for NTZ."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01'"), F.col(column))
    return F.unix_micros(column)


def instant(df: DataFrame, column: str, value) -> Column:
    """A time literal of the column's own type, so that the comparison reaches the scan.

    Left to itself a literal is zoned; comparing it with an unzoned column casts the column,
    and a cast column is not pushed down.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType) and isinstance(value, dt.datetime):
        # Spelled out, so that neither Python's nor the session's time zone shifts it.
        return F.lit(value.isoformat(sep=" ")).cast(kind)
    return F.lit(value).cast(kind)
