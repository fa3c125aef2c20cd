"""Grouping helpers that stay balanced when one key holds much of the data.

None of them brings a whole group into one task:

* ``first_row`` is an aggregate, so every map task hands on one row per key.
* ``top_rows`` filters on ``row_number() <= n``; Spark cuts each group to n rows
  before the shuffle (group limit below the exchange).
* ``exact_rank`` numbers whole groups by sorted ranges of all rows; a large group lies in
  many ranges, and each range is numbered by its own task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import written


def _pick(df, keys, order, columns, choose) -> DataFrame:
    names = [c for c in (columns or df.columns) if c not in keys]
    # All value columns take part in the order, so ties are settled the same way every run,
    # and the chosen struct carries the values itself.
    ranked = F.struct(
        *[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(f"`{c}`").alias(c) for c in names]
    )
    picked = df.groupBy(*keys).agg(choose(ranked).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in names])


def first_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per key: the smallest by ``order`` (ascending, NULL first)."""
    return _pick(df, keys, order, columns, F.min)


def last_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per key: the largest by ``order`` (NULL counts as smallest)."""
    return _pick(df, keys, order, columns, F.max)


def top_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank_col: str = "rank",
) -> DataFrame:
    """The first ``n`` rows per key with their rank from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def exact_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], rank_col: str = "rank") -> DataFrame:
    """Number all rows of every group from 1 by the ascending columns ``order``.

    ``order`` must identify a row within its group, or equal rows are numbered in any order.
    The rows are dealt to ranges of keys and order and written once, so a large group lies in
    as many ranges as its rows fill, one after the other, however large it is. Each range
    numbers its own rows; those of a group that began in an earlier range add the group's
    rows there. The input is read once.
    """
    dealt = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    ranged = written(dealt)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    skipped = (
        ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_skip", F.sum("_n").over(earlier)).where("_skip IS NOT NULL")
        .select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_part").alias("_in"), "_skip")
    )
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    within = Window.partitionBy("_part", *keys).orderBy(*order)
    return (
        ranged.withColumn("_pos", F.row_number().over(within))
        .join(skipped, same & (F.col("_part") == F.col("_in")), "left")
        .withColumn(rank_col, (F.col("_pos") + F.coalesce(F.col("_skip"), F.lit(0))).cast("bigint"))
        .select(*df.columns, rank_col)
    )


def multiset_hash(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Order-free fingerprint of a set of rows, equal when the rows are equal.

    The SHA-256 of each row is read as four 60-bit numbers that are added up, so the
    work is a plain aggregate and the rows are never collected or sorted.
    """
    # Unit separator between fields; a lone NUL stands for a missing value.
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    digest = F.sha2(F.concat_ws("\x1f", *fields), 256)
    parts = [
        F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
        for i in range(4)
    ]
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sha2(
            F.concat_ws(
                ":",
                F.count(F.lit(1)).cast("string"),
                *[F.coalesce(F.sum(p), F.lit(0)).cast("string") for p in parts],
            ),
            256,
        ).alias("content_hash"),
    )
