"""Small helpers for building columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use) -> Column:
    """``use(x)`` with ``value`` worked out once, however often ``x`` appears."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def texts(*values: str) -> Column:
    """Array literal of texts."""
    return F.array(*[F.lit(v) for v in values])


def empty_texts() -> Column:
    return F.array().cast("array<string>")
