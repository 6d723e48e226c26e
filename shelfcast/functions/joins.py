"""Joining fanned-out rows to small per-scope tables without a hot task.

After the fan-out to scope levels, the ``('*', '*')`` scope carries a quarter
of all rows under one key, and a one-store chain or a dominant segment can
carry a third of the rest. A plain equi-join on the scope keys would send
each of those keys to one task. The large side gets a salt from a hash of
its row, the small side is repeated once per salt value, and the join runs on
``keys + salt``: every row still meets exactly its one partner row, and a hot
key is spread over ``buckets`` tasks. If AQE finds the small side under the
broadcast threshold at run time it broadcasts it instead, which is also exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT_BUCKETS = 32


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner",
                buckets: int = SALT_BUCKETS) -> DataFrame:
    """Equi-join ``big`` to ``small`` (at most one row per key) on ``keys``."""
    salt = F.pmod(F.xxhash64(*big.columns), F.lit(buckets)).cast("int")
    b = big.withColumn("_salt", salt)
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return b.join(s, [*keys, "_salt"], how).drop("_salt")

