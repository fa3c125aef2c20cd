"""Deep pages and stored snapshots: same rows as the plain way, few files read."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import catalog as C
from shelfspark.operators import paging as P
from shelfspark.operators import snapshots as S


@pytest.fixture
def uncoalesced(spark):
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)


@pytest.mark.parametrize("sort_by,down", [(None, False), ("price", False), ("price", True), ("name", True)])
def test_every_page_is_the_plain_page(uncoalesced, sort_by, down):
    rng = random.Random(1)
    rows = [(i, rng.choice(["b", "A", "a", "", None]), rng.choice([1.0, 2.5, None, 7.0])) for i in range(300)]
    df = uncoalesced.createDataFrame(rows, "product_id int, name string, price double")
    pages = P.PagedResult(df, C.catalog_order(sort_by, down), ranges=12)
    assert pages.total == 300 and pages.pages(40) == 8
    for number in range(1, 10):
        want = C.catalog_page(df, number, 40, sort_by, down).collect()
        assert pages.page(number, 40).collect() == want
    assert P.PagedResult(df.where("false"), C.catalog_order(sort_by, down)).page(1, 10).collect() == []


def test_a_deep_page_reads_as_little_as_the_first(uncoalesced):
    df = uncoalesced.range(20_000).select(F.col("id").cast("int").alias("product_id"))
    pages = P.PagedResult(df, C.catalog_order(None), ranges=20)
    assert len(pages.ranges) >= 15

    for number in (1, 400):
        found = pages.page(number, 50)
        assert [r.product_id for r in found.collect()] == list(range((number - 1) * 50, number * 50))
        assert found.select(F.input_file_name().alias("f")).distinct().count() <= 2


def test_seek_behind_the_last_row(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(20)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, day int")
    keys, seen, last = [("day", True), ("id", False)], [], (10**6, 0)
    while page := P.after(df, keys, last, 30).collect():
        seen += [(r.id, r.day) for r in page]
        last = (page[-1].day, page[-1].id)
    assert seen == sorted(rows, key=lambda r: (-r[1], r[0]))


def products(spark, rows):
    return spark.createDataFrame(rows, "model string, name string")


def test_one_changed_row_opens_one_leaf(spark, tmp_path):
    rows = [(f"{i:06d}", f"n{i}") for i in range(400)]
    S.store_snapshot(products(spark, rows), f"{tmp_path}/s", leaves=32, fan=4)
    assert S.differing_leaves(products(spark, rows[::-1]), f"{tmp_path}/s") == []
    changed = [(m, "new" if m == "000007" else n) for m, n in rows]
    assert len(S.differing_leaves(products(spark, changed), f"{tmp_path}/s")) == 1
    got = {r.model: r.state for r in S.verify_stored(products(spark, changed), f"{tmp_path}/s").collect()}
    assert got == {m: "changed" if m == "000007" else "same" for m, _ in rows}
    plan = S.verify_stored(products(spark, changed), f"{tmp_path}/s")._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({S.LEAF}" in plan or "PartitionFilters: [" in plan


def test_added_removed_and_repeated_models(spark, tmp_path):
    old = [("a", "1"), ("b", "1"), ("b", "2"), ("c", "1"), ("d", "1"), ("d", "1")]
    S.store_snapshot(products(spark, old), f"{tmp_path}/s", leaves=4)
    new = [("a", "1"), ("b", "1"), ("b", "3"), ("d", "1"), ("e", "1")]
    got = {r.model: r.state for r in S.verify_stored(products(spark, new), f"{tmp_path}/s").collect()}
    assert got == {"a": "same", "b": "changed", "c": "removed", "d": "changed", "e": "added"}
    assert S.stored_root(spark, f"{tmp_path}/s").first().row_count == 6


def test_empty_snapshots(spark, tmp_path):
    some, none = products(spark, [("a", "1")]), products(spark, [("a", "1")]).where("false")
    S.store_snapshot(some, f"{tmp_path}/some")
    S.store_snapshot(none, f"{tmp_path}/none")
    assert [tuple(r) for r in S.verify_stored(none, f"{tmp_path}/some").collect()] == [("a", "removed")]
    assert [tuple(r) for r in S.verify_stored(some, f"{tmp_path}/none").collect()] == [("a", "added")]
    assert S.verify_stored(none, f"{tmp_path}/none").collect() == []
