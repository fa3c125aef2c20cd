import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("BENCH_CPUS", "4")
    session = local_session("tests")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
    return session


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of literals."""

    def run(column, **values):
        frame = spark.range(1)
        from pyspark.sql import functions as F

        for name, value in values.items():
            frame = frame.withColumn(name, F.lit(value))
        return frame.select(column.alias("x")).first()["x"]

    return run
