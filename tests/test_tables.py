"""Stored tables: merges touch few partitions, can be cut off and run again."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import catalog as C
from shelfspark.operators import registry as R
from shelfspark.sources.tables import KeyedTable


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/rows/*/*.parquet")}


def urls(spark, n, status="active"):
    return spark.range(n).select(
        F.col("id").alias("url_id"), F.lit(status).alias("status"), (F.col("id") % 3).cast("int").alias("failure_count"),
        F.lit(None).cast("string").alias("last_error"))


def checks(spark, ids):
    return spark.createDataFrame([(i, "failed", f"HTTP {i}") for i in ids], "url_id bigint, result string, message string")


def state(table):
    return {r.url_id: (r.status, r.failure_count, r.last_error) for r in table.read().collect()}


def test_a_merge_rewrites_the_touched_partitions_only(spark, tmp_path):
    table = KeyedTable.create(urls(spark, 500), f"{tmp_path}/t", ["url_id"], parts=16)
    before, want = files(f"{tmp_path}/t"), state(table)
    assert len(before) == 16
    touched = table.merge("first", checks(spark, [7, 8]), R.apply_url_checks)
    after = files(f"{tmp_path}/t")
    assert 1 <= len(touched) <= 2
    assert {f for f in after if f in before} == {f for f in before if int(f.split("_part=")[1].split("/")[0]) not in touched}
    for i in (7, 8):
        want[i] = ("broken", i % 3 + 1, f"HTTP {i}")
    assert state(table) == want


def test_a_merge_runs_once_however_often_it_is_called(spark, tmp_path):
    table = KeyedTable.create(urls(spark, 50), f"{tmp_path}/t", ["url_id"], parts=4)
    table.merge("day 1", checks(spark, [3]), R.apply_url_checks)
    kept = files(f"{tmp_path}/t")
    again = KeyedTable(spark, f"{tmp_path}/t")
    assert again.merge("day 1", checks(spark, [3]), R.apply_url_checks) == []
    assert files(f"{tmp_path}/t") == kept and state(again)[3][1] == 1
    again.merge("day 2", checks(spark, [3]), R.apply_url_checks)
    assert state(again)[3][1] == 2 and again.applied() == {"day 1", "day 2"}


@pytest.mark.parametrize("step", ["before", "after"])
def test_a_merge_that_was_cut_off_is_applied_once(spark, tmp_path, monkeypatch, step):
    """Cut off after staging, or after the partitions were replaced but before the log was written."""
    table = KeyedTable.create(urls(spark, 50), f"{tmp_path}/t", ["url_id"], parts=4)
    whole = KeyedTable._replace

    def cut(self, staged, touched):
        if step == "after":
            whole(self, staged, touched)
        raise OSError("lost")

    monkeypatch.setattr(KeyedTable, "_replace", cut)
    with pytest.raises(OSError):
        table.merge("m", checks(spark, [0, 1, 2]), R.apply_url_checks)
    monkeypatch.setattr(KeyedTable, "_replace", whole)
    table.merge("m", checks(spark, [0, 1, 2]), R.apply_url_checks)
    assert [state(table)[i][1] for i in range(4)] == [1, 2, 3, 0]


def test_upserts_and_emptied_partitions(spark, tmp_path):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "model string, name string, seq int")
    table = KeyedTable.create(old, f"{tmp_path}/t", ["model"], parts=8)
    new = spark.createDataFrame([("b", "z", 3), ("c", "w", 4)], "model string, name string, seq int")
    table.merge("add", new, C.upsert_by_model)
    assert sorted(map(tuple, table.read().collect())) == [("a", "x", 1), ("b", "z", 3), ("c", "w", 4)]
    table.merge("drop", new, lambda stored, gone: stored.join(gone, "model", "left_anti"))
    assert sorted(map(tuple, table.read().collect())) == [("a", "x", 1)]
