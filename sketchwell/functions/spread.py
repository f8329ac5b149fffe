"""Joins of many rows to a table of few, without the rows of a key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a small side is repeated to, at most: so many tasks share the work.
SLOTS = 64


def spread(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner", by: tuple[str, ...] = ("item",), counted: DataFrame | None = None) -> DataFrame:
    """rows joined to small, at most one row for each value of `on`. Fewer rows than SLOTS are repeated up to that many,
    and rows are dealt over the copies by a hash of `by`; a larger table is joined as it is.

    counted: a table (n) of one row with the number of rows of small, where that is cheaper than to count them.
    """
    n = small.agg(F.count("*").alias("n")) if counted is None else counted
    times = F.broadcast(n.select(F.greatest(F.lit(1), F.floor(F.lit(SLOTS) / F.greatest("n", F.lit(1)))).cast("int").alias("_times")))
    left = rows.crossJoin(times).withColumn("_copy", F.pmod(F.xxhash64(*by), F.col("_times")).cast("int")).drop("_times")
    right = small.crossJoin(times).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_times") - 1))).drop("_times")
    return left.join(right, [*on, "_copy"], how).drop("_copy")
