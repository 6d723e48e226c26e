"""Blocks of vectors, and how blocks of queries meet blocks of candidates.

A block holds vectors of whole numbers vertically, one run of values per
dimension. Queries are a stated set and meet all candidates, block against
block: every pair of blocks has a task of its own share, by (slice, chunk) of
an equi-join, so that neither side passes through one task as the tables grow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Query blocks that one copy of a candidate block meets.
CHUNK = 32
#: Most partitions of a meeting; beyond it a partition holds several pairs of keys.
PARTITIONS = 20_000


def usable(vector: str) -> Column:
    """No null and no non-finite component."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole_matrix(vectors: list, scale: float) -> np.ndarray:
    """Columns ``floor(scale * v)``, shorter ones padded with zeros; doubles hold every floor exactly."""
    matrix = np.zeros((max(map(len, vectors), default=0), len(vectors)))
    for i, v in enumerate(vectors):
        matrix[:len(v), i] = v
    return np.nan_to_num(np.floor(scale * matrix))


def stored(matrix: np.ndarray) -> tuple[int, str, bytes]:
    """(dims, kind, values): the narrowest type that holds all values; a double beyond 53 bits is whole already."""
    top = np.abs(matrix).max(initial=0)
    kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
    return len(matrix), kind, np.ascontiguousarray(matrix).astype(kind).tobytes()


def read_matrix(dims: int, kind: str, values: bytes, n: int) -> np.ndarray:
    return np.frombuffer(values, kind, dims * n).reshape(dims, n).astype(np.float64) if dims * n else np.zeros((dims, n))


def padded(matrix: np.ndarray, dims: int) -> np.ndarray:
    return matrix if len(matrix) == dims else np.vstack([matrix, np.zeros((dims - len(matrix), matrix.shape[1]))])


def meet(queries: DataFrame, candidates: DataFrame, search: Callable[[Iterator[tuple]], Iterator[tuple]], schema: pa.Schema) -> DataFrame:
    """Rows that ``search`` yields for every pair of a candidate block and a query block.

    ``queries``: a written table with a block number ``query_group`` from 0;
    ``candidates``: a written table with a block number ``slice`` from 0.
    ``search`` gets (candidate columns, query columns), without the numbers.
    """
    n_groups = 1 + (queries.agg(F.max("query_group")).first()[0] or 0)
    n_slices = 1 + (candidates.agg(F.max("slice")).first()[0] or 0)
    chunks = -(-n_groups // CHUNK)
    partitions = min(PARTITIONS, n_slices * chunks)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    c = [x for x in candidates.columns if x != "slice"]
    q = [x for x in queries.columns if x != "query_group"]
    sent = candidates.withColumn("chunk", every(chunks)).repartition(partitions, "slice", "chunk")
    asked = (queries.select(F.expr(f"query_group div {CHUNK}").alias("chunk"), *[F.col(x).alias(f"q_{x}") for x in q])
             .withColumn("slice", every(n_slices)).repartition(partitions, "slice", "chunk"))
    met = sent.join(asked.hint("merge"), ["slice", "chunk"])
    return map_rows(met.select(*c, *[f"q_{x}" for x in q]), search, schema, slice_rows=1)
