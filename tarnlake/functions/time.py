"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    seconds = F.unix_date(ts.cast("date")).cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("bigint")
