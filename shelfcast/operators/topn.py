"""Exact top-n per group without sending a whole group to one task.

Rows are first ranked inside ``(group, salt)`` buckets and only each bucket's
best ``n`` survive; the final rank then runs over at most ``n x buckets`` rows
per group. The salt is that of the task that reads a row, so Spark's limit on
ranked windows (``WindowGroupLimit``) leaves at most ``n`` rows of a group in
each task before anything is shuffled. Every row of a group's true top ``n``
is also in the top ``n`` of its own task and bucket, so the result is exact,
and a group holding a large share of all rows is split ``buckets`` ways.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int,
          buckets: int = 32, rank_col: str = "rank") -> DataFrame:
    """Rows with ``rank <= n`` per ``group`` under ``order`` (a total order)."""
    salt = F.spark_partition_id() % buckets
    first = Window.partitionBy(*group, "_salt").orderBy(*order)
    pre = (df.withColumn("_salt", salt)
             .withColumn("_r", F.row_number().over(first))
             .filter(F.col("_r") <= n).drop("_r", "_salt"))
    final = Window.partitionBy(*group).orderBy(*order)
    return pre.withColumn(rank_col, F.row_number().over(final)).filter(F.col(rank_col) <= n)
