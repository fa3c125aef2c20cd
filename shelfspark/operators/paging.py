"""Deep pages of an ordered result: sorted ranges with their row counts, kept once and read in part."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.session import written_by

RANGE = "_range"


class PagedResult:
    """An ordered result whose pages cost alike, however deep they lie.

    The rows are dealt to ranges of the order and written once, sorted, one folder a range.
    The counts of the ranges, one number each, tell which ranges hold a page's rows; only those are
    read. ``order`` must tell all rows apart.
    """

    def __init__(self, rows: DataFrame, order: Sequence[Column], ranges: int | None = None):
        self.order = list(order)
        dealt = rows.repartitionByRange(ranges, *self.order) if ranges else rows.repartitionByRange(*self.order)
        self.columns = rows.columns
        self.rows = written_by(dealt.withColumn(RANGE, F.spark_partition_id()).sortWithinPartitions(*self.order), RANGE)
        counts = self.rows.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n")).orderBy(RANGE).collect()
        self.ranges = [(r[RANGE], r["n"]) for r in counts]
        self.total = sum(n for _, n in self.ranges)

    def slice(self, offset: int, limit: int) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` in order."""
        before, inside, skipped = 0, [], 0
        for number, n in self.ranges:
            if before + n <= offset:
                skipped = before + n
            elif before < offset + limit:
                inside.append(number)
            before += n
        part = self.rows.where(F.col(RANGE).isin(inside) if inside else F.lit(False))
        return part.orderBy(RANGE, *self.order).offset(max(0, offset - skipped)).limit(limit).select(*self.columns)

    def page(self, number: int, size: int) -> DataFrame:
        return self.slice((number - 1) * size, size)

    def pages(self, size: int) -> int:
        return math.ceil(self.total / size)


def after(rows: DataFrame, keys: Sequence[tuple[str, bool]], last: Sequence, limit: int) -> DataFrame:
    """The next ``limit`` rows behind the row with the key values ``last``, by a filter that reaches the scan.

    ``keys``: column and whether it descends; together they tell rows apart and hold no missing values.
    """
    value = [F.lit(v) for v in last]
    beyond = [F.col(c) < v if down else F.col(c) > v for (c, down), v in zip(keys, value)]
    equal = [F.col(c) == v for (c, _), v in zip(keys, value)]
    steps = [reduce(Column.__and__, equal[:i], F.lit(True)) & beyond[i] for i in range(len(keys))]
    # The first key alone bounds the rows, which a scan can use.
    first = F.col(keys[0][0]) <= value[0] if keys[0][1] else F.col(keys[0][0]) >= value[0]
    order = [F.col(c).desc() if down else F.col(c).asc() for c, down in keys]
    return rows.where(first & reduce(Column.__or__, steps)).orderBy(*order).limit(limit)
