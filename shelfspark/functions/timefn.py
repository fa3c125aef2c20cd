"""Timestamp texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.text import trim_text


def parse_timestamp(col: Column) -> Column:
    """ISO date or date-time text; without a zone it is read as UTC (session time zone)."""
    text = trim_text(col)
    full = text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$")
    return F.when(full, text.try_cast("timestamp"))
