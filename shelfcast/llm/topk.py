"""Exact top-k by inner product: columnar branch and bound (operator 8).

Components are turned into integers ``floor(scale * x)``. Vectors are gathered
in blocks of a fixed number of rows and stored vertically, one run of values
per dimension, the dimensions of greatest mass first. A block of queries meets
a block of candidates: scores grow by one block of dimensions at a time, and a
candidate stays only while its score so far plus the largest share that its
remaining mass allows (Cauchy-Schwarz on the dimensions to come) reaches the
query's k-th best score. Survivors are compacted before the next dimensions.

Candidates are dealt out evenly into slices of about ``ROWS`` rows, one block
each, and queries into groups of about ``QUERIES`` by a hash. Every pair of a
slice and a group meets by an equi-join on both numbers (``blocks.meet``), so
neither side is broadcast, the pairs are spread over tasks of their own, and a
task holds one block of each side. Results per pair (k rows per query) are
merged by a ranked window.

Defined cases: vectors that are null, or hold null or non-finite components,
and rows with a null vec_id take no part; shorter vectors count as padded with
zeros, and an empty vector scores 0; a row is never a candidate of a query with
the same vec_id; equal scores go by the smaller vec_id, and repeated rows are
candidates of their own, but one query; with fewer candidates than k, all are returned; extra
columns are not read; an empty table gives an empty table. Scores are exact
while they fit in a long; beyond it they saturate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import meet, padded, read_matrix, stored, usable, whole_matrix
from .common import Shared, map_rows

#: Rows of a candidate block and of a query block; dimensions added between two compactions.
ROWS, QUERIES, DIMS = 8192, 2048, 16
LONG = 1 << 63

VECTORS = [("vec_ids", pa.binary()), ("dims", pa.int32()), ("kind", pa.string()), ("values", pa.binary())]
SLICE = pa.schema([("slice", pa.int64()), *VECTORS])
ASKED = pa.schema([("query_group", pa.int64()), ("tags", pa.binary()), *VECTORS])
HITS = pa.schema([("query_id", pa.int64()), ("tag", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _ids(rows: list, at: int) -> bytes:
    return np.array([r[at] for r in rows], "<i8").tobytes()


def candidate_blocks(rows: DataFrame, n: int, scale: float) -> DataFrame:
    """One block per task of the rows (vec_id, v), dealt out evenly over n tasks."""
    def pack(source):
        from pyspark import TaskContext

        held = list(source)
        if held:
            yield (TaskContext.get().partitionId(), _ids(held, 0), *stored(whole_matrix([r[1] for r in held], scale)))
    return map_rows(rows.select("vec_id", "v").repartition(n), pack, SLICE, slice_rows=1024)


def query_blocks(asked: DataFrame, groups: int, scale: float) -> DataFrame:
    """One block per group of the queries (vec_id, v, tag, query_group)."""
    def pack(source):
        held: dict[int, list] = {}
        for row in source:
            held.setdefault(row[3], []).append(row)
        for group, rows in held.items():
            yield (group, _ids(rows, 2), _ids(rows, 0), *stored(whole_matrix([r[1] for r in rows], scale)))
    return map_rows(asked.select("vec_id", "v", "tag", "query_group").repartition(groups, "query_group"), pack, ASKED, slice_rows=1024)


def block_top_k(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, dims_at_once: int = DIMS):
    """(number of the query, vec_id, score) of the k best rows of one candidate block for each query; columns are vectors."""
    dims = max(len(queries), len(rows), 1)
    queries, rows = padded(queries, dims), padded(rows, dims)
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * dims
    if top >= 2.0**53:
        yield from _exact_top_k(query_ids, queries, ids, rows, k)
        return
    # dimensions of greatest mass first, so that the rest bounds the score early
    order = np.argsort(-((rows * rows).sum(1) * (queries * queries).sum(1)), kind="stable")
    queries, rows = queries[order], rows[order]
    cuts = list(range(0, dims, dims_at_once))
    # remaining mass after each block of dimensions, per vector
    rest_q = [np.sqrt((queries[c + dims_at_once:] ** 2).sum(0)) for c in cuts]
    rest_r = [np.sqrt((rows[c + dims_at_once:] ** 2).sum(0)) for c in cuts]
    first = queries[:dims_at_once].T @ rows[:dims_at_once]
    for j, query_id in enumerate(query_ids):
        alive = np.flatnonzero(ids != query_id)
        score = first[j, alive]
        if not len(alive):
            continue
        # the k most promising rows, scored in full, give the first threshold
        kth = -np.inf
        if len(alive) > k:
            bound = score + rest_q[0][j] * rest_r[0][alive]
            seeds = alive[np.argpartition(-bound, k - 1)[:k]]
            kth = float((queries[:, j] @ rows[:, seeds]).min())
        for b, c in enumerate(cuts):
            if b:
                score = score + queries[c:c + dims_at_once, j] @ rows[c:c + dims_at_once, alive]
            # half a unit covers the rounding of the bound; scores are whole numbers
            keep = score + rest_q[b][j] * rest_r[b][alive] * (1 + 1e-9) + 0.5 >= kth
            if not keep.all():
                alive, score = alive[keep], score[keep]
        best = np.lexsort((ids[alive], -score))[:k]
        for i in best:
            yield j, int(ids[alive[i]]), int(score[i])


def _exact_top_k(query_ids, queries, ids, rows, k):
    """The same for numbers beyond 53 bits, in whole numbers of any size."""
    whole_rows = [[int(x) for x in rows[:, i]] for i in range(rows.shape[1])]
    for j, query_id in enumerate(query_ids):
        query = [int(x) for x in queries[:, j]]
        scored = sorted((-min(LONG - 1, max(-LONG, sum(a * b for a, b in zip(query, r)))), int(v))
                        for v, r in zip(ids, whole_rows) if v != query_id)
        for score, vec_id in scored[:k]:
            yield j, vec_id, -score


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0,
          vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best rows by integer inner product."""
    if k < 1:
        raise ValueError("k must be at least 1")
    store = Shared(vectors.sparkSession, "topk")
    rows = (vectors.where(F.col(key).isNotNull() & usable(vector))
            .select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asked")))
    n = rows.agg(F.count("*").alias("rows"), F.count(F.when(F.col("asked"), 1)).alias("asked")).first()
    groups = max(1, -(-n["asked"] // QUERIES))
    asked = (rows.where("asked").dropDuplicates(["vec_id", "v"]).withColumn("tag", F.xxhash64("vec_id", "v"))
             .withColumn("query_group", F.pmod(F.col("tag"), F.lit(groups)).cast("long")))
    blocks = store.write(candidate_blocks(rows, max(1, -(-n["rows"] // ROWS)), scale), "candidates")
    queries = store.write(query_blocks(asked, groups, scale), "queries")

    def search(source):
        for vec_ids, dims, kind, values, q_tags, q_ids, q_dims, q_kind, q_values in source:
            ids, query_ids, tags = (np.frombuffer(x, "<i8") for x in (vec_ids, q_ids, q_tags))
            found = block_top_k(query_ids, read_matrix(q_dims, q_kind, q_values, len(query_ids)), ids, read_matrix(dims, kind, values, len(ids)), k)
            for j, vec_id, score in found:
                yield int(query_ids[j]), int(tags[j]), vec_id, score
    rank = F.row_number().over(Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id"))
    hits = store.write(meet(queries, blocks, search, HITS).withColumn("rank", rank).where(F.col("rank") <= k), "hits")
    store.drop("candidates", "queries")
    return hits.select("query_id", "rank", "vec_id", "score")
