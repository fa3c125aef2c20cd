"""Incremental jobs as Structured Streaming; each gives the rows of its batch operator.

Jobs that keep a state of their own per key are in ``keyed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.monitoring import alert_rows


def alert_events(observations: DataFrame, rules: DataFrame, event_time: str, keep: str = "30 days") -> DataFrame:
    """Alert events of a stream of observations, one per dedupe key.

    Rules are static. A key that comes again within ``keep`` of event time is dropped.
    """
    timed = observations.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, keep)
    raised = alert_rows(timed, rules)
    return raised.dropDuplicatesWithinWatermark(["dedupe_key"])


def new_snapshot_stream(snapshots: DataFrame, event_time: str, keep: str = "365 days") -> DataFrame:
    """Snapshots whose (source, artifact, digest) was not seen within ``keep`` of event time."""
    timed = snapshots.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, keep).dropDuplicatesWithinWatermark(["source_id", "artifact_ref", "digest"])
