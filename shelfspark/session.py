"""Session settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Runtime SQL settings. Hot join keys are split by the adaptive skew join, also when
# the split costs one more shuffle downstream.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by the cluster.

    Only a local session (tests, bench) may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="shelfspark-")


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps reread the table instead of working it out again."""
    path = f"{shared_dir(df.sparkSession)}/shelfspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, part: str) -> DataFrame:
    """``df`` written to the shared folder, one folder for each value of the integer column ``part``, and read back."""
    path = f"{shared_dir(df.sparkSession)}/shelfspark-{uuid.uuid4().hex}"
    df.write.partitionBy(part).parquet(path)
    # Partition columns come last when a table is read.
    fields = [f for f in df.schema.fields if f.name != part] + [df.schema[part]]
    return df.sparkSession.read.schema(StructType(fields)).parquet(path)


def local_session(app: str = "shelfspark", cpus: str | int | None = None) -> SparkSession:
    """Single-machine session for tests and the bench."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
