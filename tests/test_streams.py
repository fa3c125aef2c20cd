"""Keyed streams against their batch operators: many batches, late rows, restarts, timers."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import monitoring as O
from shelfspark.operators import registry as R
from shelfspark.streaming import keyed as K


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture
def attempts(spark):
    rng = random.Random(5)
    data = [(i, rng.randrange(6) if i % 3 else 0, f"2024-01-{1 + i // 60:02d} 00:{i % 60:02d}:00", rng.choice(["success", "failed", "skipped"]))
            for i in range(300)]
    # Source 6 never succeeds, source 7 always does.
    data += [(300 + i, 6 + i % 2, f"2024-01-{1 + i // 6:02d} 01:00:{i:02d}", "success" if i % 2 else "failed") for i in range(30)]
    return spark.createDataFrame(data, "attempt_id int, source_id int, captured_at string, fetch_status string").withColumns(
        {"captured_at": F.col("captured_at").cast("timestamp"), "error_code": F.when(F.col("fetch_status") == "failed", "E")})


HEALTH = ["source_id", "last_fetch_status", "last_error_code", "consecutive_failures", "last_success_at", "last_error_at"]


def run_health(spark, folder, schema, files=1):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    query = K.run_keyed(K.health_stream(stream), f"{folder}/out", f"{folder}/cp", idle_batches=False)
    query.awaitTermination()
    return query


@pytest.mark.parametrize("order", [(0, 1, 2, 3, 4), (3, 0, 4, 2, 1)])
def test_health_equals_the_batch_operator_also_for_late_rows(spark, tmp_path, attempts, order):
    for n in order:
        attempts.where(F.dayofmonth("captured_at") == n + 1).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run_health(spark, tmp_path, attempts.schema)  # every run starts where the last one ended
    want = rows(R.source_health(attempts), *HEALTH)
    assert rows(K.health_now(spark, f"{tmp_path}/cp"), *HEALTH) == want
    assert rows(K.escalations(K.health_now(spark, f"{tmp_path}/cp")), "source_id") == [
        (w[0],) for w in want if w[3] >= 2 and w[1] != "success"]


def test_health_touches_the_keys_of_a_batch_only_and_counts_a_row_once(spark, tmp_path, attempts):
    attempts.coalesce(1).write.parquet(f"{tmp_path}/in")
    run_health(spark, tmp_path, attempts.schema)
    attempts.where("source_id = 6").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = run_health(spark, tmp_path, attempts.schema)
    changed = spark.read.parquet(f"{tmp_path}/out/batch={query.lastProgress['batchId']}")
    assert rows(changed, "source_id", "consecutive_failures") == [(6, 15)]
    assert rows(K.health_now(spark, f"{tmp_path}/cp"), *HEALTH) == rows(R.source_health(attempts), *HEALTH)


def beats(spark, data):
    return spark.createDataFrame(data, "job_id int, job_type string, status string, heartbeat_at string").withColumn(
        "heartbeat_at", F.col("heartbeat_at").cast("timestamp"))


def run_jobs(spark, folder, frame, **how):
    frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{folder}/in")
    query = K.run_keyed(K.stale_job_stream(stream, {"slow": 600}, **how), f"{folder}/out", f"{folder}/cp", idle_batches=True)
    query.awaitTermination()
    return rows(K.stale_jobs_now(spark, f"{folder}/cp"), "job_id")


def test_a_job_turns_stale_in_a_batch_without_its_row(spark, tmp_path):
    first = [(1, "x", "running", "2024-01-01 10:00:00"), (2, "slow", "running", "2024-01-01 10:00:00"),
             (3, "x", "succeeded", "2024-01-01 10:00:00"), (4, "x", "running", "2024-01-01 10:30:00")]
    assert run_jobs(spark, tmp_path, beats(spark, first)) == []
    assert run_jobs(spark, tmp_path, beats(spark, [(9, "x", "queued", "2024-01-01 11:00:00")])) == [(1,)]
    # Job 1 is heard of again, job 4 has been silent for an hour, job 2 has ten.
    assert run_jobs(spark, tmp_path, beats(spark, [(1, "x", "running", "2024-01-01 11:30:00")])) == [(4,)]
    assert run_jobs(spark, tmp_path, beats(spark, [(1, "x", "failed", "2024-01-01 20:00:00")])) == [(2,), (4,)]


def test_stale_jobs_equal_the_batch_operator(spark, tmp_path):
    rng = random.Random(3)
    data = [(rng.randrange(40), "slow" if rng.random() < 0.3 else "x", rng.choice(["running", "running", "queued", "failed"]),
             f"2024-01-0{1 + i // 150} {rng.randrange(24):02d}:{rng.randrange(60):02d}:0{rng.randrange(2)}") for i in range(300)]
    data = [(job * 2 + (kind == "slow"), kind, status, at) for job, kind, status, at in data]
    frame = beats(spark, data)
    last = frame.groupBy("job_id", "job_type").agg(
        F.max_by("status", F.struct("heartbeat_at", "status")).alias("status"), F.max("heartbeat_at").alias("heartbeat_at"))
    clock = frame.agg(F.max("heartbeat_at").alias("x")).first()["x"]
    want = rows(O.stale_jobs(last, F.lit(clock), {"slow": 600}, 60), "job_id")
    for when in ("heartbeat_at < '2024-01-01 12:00:00'", "heartbeat_at >= '2024-01-01 12:00:00'"):
        got = run_jobs(spark, tmp_path, frame.where(when))
    assert got == want
