"""Time expressions.

Driver timestamps load as ``timestamp_ntz``. ``CAST(ntz AS DOUBLE)`` is
refused, so every epoch conversion goes through these helpers; with the
session zone pinned to UTC the NTZ → TIMESTAMP cast is exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 as DOUBLE, fractions kept (DuckDB ``epoch``)."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)


def epoch_whole_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 as BIGINT, fractions dropped (``unix_timestamp``)."""
    return F.unix_seconds(ts.cast("timestamp"))


def parse_timestamp(text: Column) -> Column:
    """String → timestamp; unparsable text → NULL (pandas ``errors='coerce'``)."""
    return F.try_to_timestamp(text)


def parse_double(text: Column) -> Column:
    """String → DOUBLE; unparsable text → NULL; NaN → NULL."""
    cast = text.try_cast("double")
    return F.when(~F.isnan(cast), cast)
