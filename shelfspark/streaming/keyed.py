"""Keyed state of the incremental jobs: only the keys of a batch are read and written.

State lives in the state store of the query (RocksDB), its checkpoints in the folder of the
query. It is read back as a table with ``state_table``; nothing else keeps versions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

STORE = "spark.sql.streaming.stateStore.providerClass"
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Times are microseconds, so no time zone of a worker takes part.
HEALTH = (
    "last_at bigint, last_id bigint, last_fetch_status string, last_error_code string, "
    "ok_at bigint, ok_id bigint, last_error_at bigint"
)
JOB = "heartbeat_at bigint, status string, stale boolean"


# ----------------------------------------------------------------- source health
def _whole(value) -> int | None:
    return None if pd.isna(value) else int(value)


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per Arrow batch and source one row: newest attempt, newest success, and the failures after it."""
    for rows in batches:
        out = []
        for source, own in rows.sort_values(["at", "attempt_id"], kind="stable").groupby("source_id", dropna=False, sort=False):
            good = own["fetch_status"].eq("success").to_numpy()
            times, ids = own["at"].tolist(), own["attempt_id"].tolist()
            ok = int(good.nonzero()[0][-1]) if good.any() else -1
            bad = int((~good).nonzero()[0][-1]) if not good.all() else -1
            out.append((
                source, times[-1], ids[-1], own["fetch_status"].iloc[-1], own["error_code"].iloc[-1],
                times[ok] if ok >= 0 else None, ids[ok] if ok >= 0 else None, times[bad] if bad >= 0 else None,
                times[ok + 1 :], ids[ok + 1 :]))
        if out:
            yield pd.DataFrame(out, columns=[
                "source_id", "last_at", "last_id", "last_fetch_status", "last_error_code", "ok_at", "ok_id", "last_error_at",
                "failed_at", "failed_id"]).astype({"ok_at": "Int64", "ok_id": "Int64", "last_error_at": "Int64"})


class Health(StatefulProcessor):
    """Last states and failures since the last success of a source, late attempts included.

    The failures since the last success are kept by (time, id), so a success that arrives
    late still takes away exactly the failures before it, and an attempt that arrives twice
    counts once. A success empties the list; a source unheard of for ``keep_days`` is
    forgotten by the store's time to live.
    """

    def __init__(self, keep_days: int):
        self.keep = keep_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.health = handle.getValueState("health", HEALTH + ", consecutive_failures bigint", self.keep)
        self.failures = handle.getListState("failures", "failed_at bigint, failed_id bigint", self.keep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.health.get() if self.health.exists() else (None,) * 7 + (0,)
        last, ok, error_at, count = tuple(known[:4]), tuple(known[4:6]), known[6], known[7]
        known_ok, fresh = ok, set()
        for part in rows:
            for r in part.itertuples(index=False):
                if last[0] is None or (r.last_at, r.last_id) >= last[:2]:
                    last = (int(r.last_at), int(r.last_id), r.last_fetch_status, r.last_error_code)
                success, failure = (_whole(r.ok_at), _whole(r.ok_id)), _whole(r.last_error_at)
                if success[0] is not None and (ok[0] is None or success > ok):
                    ok = success
                if failure is not None and (error_at is None or failure > error_at):
                    error_at = failure
                fresh.update(zip(map(int, r.failed_at), map(int, r.failed_id)))
        fresh = {f for f in fresh if ok[0] is None or f > ok}
        if fresh or ok != known_ok:
            kept = {tuple(f) for f in self.failures.get()} if count else set()
            fresh |= {f for f in kept if ok[0] is None or f > ok}
            if fresh != kept:
                self.failures.put(sorted(fresh)) if fresh else self.failures.clear()
            count = len(fresh)
        code = None if last[2] == "success" or pd.isna(last[3]) else last[3]
        self.health.update((*last[:3], code, *ok, error_at, count))
        yield pd.DataFrame({"source_id": [key[0]], "last_fetch_status": [last[2]], "consecutive_failures": [count]})

    def close(self) -> None:
        pass


def health_stream(attempts: DataFrame, keep_days: int = 400) -> DataFrame:
    """Changed sources of every batch of (source_id, attempt_id, captured_at, fetch_status, error_code).

    Each task first brings its rows down to one row per source, so a hot source comes to its
    state as few rows: its newest success drops all failures before it already there.
    """
    narrow = attempts.select(
        F.col("source_id").cast("bigint").alias("source_id"), F.col("attempt_id").cast("bigint").alias("attempt_id"),
        F.unix_micros(F.col("captured_at").cast("timestamp")).alias("at"), "fetch_status", "error_code")
    partial = narrow.mapInPandas(_partial, f"source_id bigint, {HEALTH}, failed_at array<bigint>, failed_id array<bigint>")
    return partial.groupBy("source_id").transformWithStateInPandas(
        Health(keep_days), "source_id bigint, last_fetch_status string, consecutive_failures bigint",
        "update", "ProcessingTime")


def health_now(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Health of all sources after the last batch."""
    time = lambda c: F.timestamp_micros(c).alias(c.replace("ok_at", "last_success_at"))
    return state_table(spark, checkpoint, "health").select(
        "source_id", "last_fetch_status", "last_error_code", time("ok_at"), time("last_error_at"), "consecutive_failures")


def escalations(health: DataFrame, threshold: int = 2) -> DataFrame:
    """Sources whose failures since the last success reached the threshold."""
    return health.where((F.col("consecutive_failures") >= threshold) & (F.col("last_fetch_status") != "success"))


# -------------------------------------------------------------------- stale jobs
class Heartbeats(StatefulProcessor):
    """Newest heartbeat of a job, and a timer that goes off when it has been silent for too long."""

    def __init__(self, minutes: dict[str, int], default: int):
        self.minutes, self.default = minutes, default

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", JOB)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = max(max(zip(part["at"].tolist(), part["status"].tolist())) for part in rows)
        known = self.job.get() if self.job.exists() else None
        if known and tuple(known[:2]) >= best:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        at, status = best
        self.job.update((at, status, False))
        if status == "running":
            # Timers count whole milliseconds, as the watermark does.
            self.handle.registerTimer(at // 1000 + self.minutes.get(key[1], self.default) * 60_000)
        if known and known[2]:
            yield self._row(key, at, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, status, _ = self.job.get()
        self.job.update((at, status, True))
        yield self._row(key, at, True)

    def _row(self, key, at, stale):
        return pd.DataFrame({"job_id": [key[0]], "job_type": [key[1]], "heartbeat_us": [at], "stale": [stale]})

    def close(self) -> None:
        pass


def stale_job_stream(jobs: DataFrame, minutes: dict[str, int], default: int = 60, late: str = "0 seconds") -> DataFrame:
    """Jobs that turn stale, and stale ones that are heard of again, as (job_id, job_type, heartbeat_us, stale).

    A running job turns stale when the newest heartbeat of all jobs, less ``late``, has passed
    its own by the minutes its type allows; that takes no row of its own. Heartbeats that
    come later than ``late`` behind the newest one of earlier batches are not looked at.
    """
    timed = jobs.select(
        F.col("job_id").cast("bigint").alias("job_id"), "job_type", "status",
        F.col("heartbeat_at").cast("timestamp").alias("heartbeat_at")
    ).withColumn("at", F.unix_micros("heartbeat_at"))
    return timed.withWatermark("heartbeat_at", late).groupBy("job_id", "job_type").transformWithStateInPandas(
        Heartbeats(minutes, default), "job_id bigint, job_type string, heartbeat_us bigint, stale boolean",
        "update", "EventTime")


def stale_jobs_now(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Jobs that are stale after the last batch."""
    return state_table(spark, checkpoint, "job").where("stale").select(
        "job_id", "job_type", F.timestamp_micros("heartbeat_at").alias("heartbeat_at"))


# ------------------------------------------------------------------------ running
def run_keyed(changes: DataFrame, out: str, checkpoint: str, idle_batches: bool, once: bool = True) -> StreamingQuery:
    """Start the query: changes go to ``out`` as one folder per batch, state stays in the checkpoint.

    ``idle_batches`` lets batches without rows run, which timers of event time need and a
    time to live does not. The same folders start the query again where it ended; a batch
    that runs again writes its folder anew.
    """
    spark = changes.sparkSession
    wanted = {STORE: ROCKSDB, IDLE: str(idle_batches).lower()}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        writer = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(
            lambda rows, number: rows.write.mode("overwrite").parquet(f"{out}/batch={number}"))
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def state_table(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """A value state of an ended query as a table: its key columns and its values."""
    found = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    value = "value.value.*" if "ttlExpirationMs" in found.schema["value"].dataType.fieldNames() else "value.*"
    return found.select("key.*", value)
