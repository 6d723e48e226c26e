import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import topk
from shelfcast.llm.topk import block_top_k, top_k

SCHEMA = "vec_id long, embedding array<double>, query_id string, v string, score string"


def brute(rows, k=5):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in usable:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in usable if j != i)
            out |= {(i, r + 1, j, s if abs(s) < 2**63 else (1 << 63) - 1) for r, (s, j) in enumerate((-s, j) for s, j in scored[:k])}
    return sorted(out)


def run(spark, rows, k=5):
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return sorted(map(tuple, top_k(frame, F.col("vec_id") % 50 == 0, k).collect()))


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 64)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(64)]) for i in range(300)]
    rows += [(400 + i, rows[50][1]) for i in range(40)]  # ties
    rows += [(None, [1.0] * 64), (500, None), (501, [None] + [0.1] * 63), (502, [float("nan")] * 64), (503, [float("inf")] * 64),
             (504, []), (550, []), (505, [0.5] * 3), (506, [-0.5] * 70), (600, [0.25] * 80)]
    assert run(spark, rows) == brute(rows)


def test_every_pair_of_blocks_has_a_task_of_its_own(spark, monkeypatch):
    """Candidate blocks and query groups meet in as many tasks as there are pairs of them, about."""
    from pyspark.sql import Row

    from shelfcast.llm import blocks
    monkeypatch.setattr(blocks, "CHUNK", 2)
    candidates = spark.createDataFrame([Row(slice=i, c=i) for i in range(6)])
    queries = spark.createDataFrame([Row(query_group=i, q=i) for i in range(5)])
    import pyarrow as pa

    def pairs(source):
        from pyspark import TaskContext
        for c, q in source:
            yield c, q, TaskContext.get().partitionId()
    met = blocks.meet(queries, candidates, pairs, pa.schema([("c", pa.int64()), ("q", pa.int64()), ("task", pa.int64())])).collect()
    assert sorted((r.c, r.q) for r in met) == [(c, q) for c in range(6) for q in range(5)]
    per_task = {t: sum(r.task == t for r in met) for t in {r.task for r in met}}
    assert len(per_task) > 6 and max(per_task.values()) <= 8  # 18 keys of at most 2 pairs


def test_few_and_repeated_rows(spark):
    rows = [(0, [1.0, 2.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0])]
    assert run(spark, rows) == [(0, 1, 3, 65536), (0, 2, 3, 65536)]
    assert run(spark, [(0, [1.0]), (0, [1.0])]) == []
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        run(spark, rows, k=0)


def test_large_numbers_stay_exact(spark):
    rows = [(0, [2.0**30 + 0.5, 1.0]), (1, [2.0**10, 3.0]), (2, [2.0**10, 2.0]), (3, [1e30, 1.0]), (4, [-1e30, 1.0])]
    got = run(spark, rows)
    want = brute(rows[:3])
    assert [r for r in got if r[2] in (1, 2)] == [(0, r[1] + 1, r[2], r[3]) for r in want]
    assert got[0] == (0, 1, 3, (1 << 63) - 1) and got[-1] == (0, 4, 4, -(1 << 63))


def test_bounds_prune_and_keep_ties():
    rng = np.random.default_rng(1)
    rows = np.floor(256 * rng.normal(0, 0.1, (32, 500)))
    rows[:, 100:140] = rows[:, [7]]
    queries = rows[:, [7, 9]] + 3
    ids = rng.permutation(500)
    got = list(block_top_k(np.array([-1, -2]), queries, ids, rows, 5, dims_at_once=4))
    for j in range(2):
        s = queries[:, j] @ rows
        best = np.lexsort((ids, -s))[:5]
        assert [(v, x) for q, v, x in got if q == j] == [(ids[i], s[i]) for i in best]
