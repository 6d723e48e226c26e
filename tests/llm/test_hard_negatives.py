import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import blocks
from shelfcast.llm.hard_negatives import Codebooks, Slice, hard_negatives, mine_noisy_labels, walk

SCHEMA = "vec_id long, embedding array<double>, label int, tag string, query_group string, rank string"


def brute(rows, move=True, low=50, high=95):
    fine = [(i, (y + 1) % 10 if move and i % 7 == 0 else y, [math.floor(256 * x) for x in v]) for i, v, y in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, q in {(i, y, tuple(v)): (i, y, v) for i, y, v in fine if i % 50 == 0}.values():
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, z) for j, z, v in fine if j != i)
        for p, j, _ in [s for s in scored if s[2] == y][:5]:
            inside = [(s, n) for s, n, z in scored if z != y and low * -p <= 100 * -s <= high * -p]
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n) in enumerate(inside[:3])]
    return sorted(out)


def run(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    if not options:
        return sorted(map(tuple, mine_noisy_labels(frame).collect()))
    return sorted(map(tuple, hard_negatives(frame, F.col("vec_id") % 50 == 0, **options).collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    centre = [[rng.gauss(0, 0.2) for _ in range(24)] for _ in range(10)]
    out = [(i, [x + rng.gauss(0, 0.15) for x in centre[i % 13 % 10]], i % 13 % 10) for i in range(420)]
    out += [(1000 + i, out[50][1], i % 2) for i in range(30)]  # ties on both sides
    out += [(None, [1.0] * 24, 1), (2000, None, 1), (2001, [0.1] * 24, None), (2002, [None] + [0.1] * 23, 1), (2003, [float("nan")] * 24, 1),
            (2004, [float("-inf")] * 24, 1), (2050, [], 3), (2005, [0.5] * 3, 2), (2006, [-0.5] * 30, 2), (2100, [0.25] * 40, 2)]
    return out


def test_equals_brute_force(spark, rows):
    want = brute(rows)
    assert len(want) > 60 and run(spark, rows) == want


def test_small_slices_and_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(blocks, "CHUNK", 2)
    got = run(spark, rows, values_per_slice=40 * 60, anchors_per_block=2, words=3, sample=50, low=40, high=99)
    assert got == brute(rows, move=False, low=40, high=99)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 1)]) == []
    assert run(spark, [(50, [], 1), (3, [], 1), (4, [], 2)]) == [(50, 3, 1, 4, 0, 0)]  # empty vectors score 0, the window of 0
    assert run(spark, [(50, [1.0], 1), (50, [1.0], 1), (3, [1.0], 1), (3, [1.0], 1), (8, [0.75], 2), (8, [0.75], 2)]) == [
        (50, 3, r, 8, 65536, 49152) for r in (1, 1, 2, 2)]
    assert run(spark, [(50, [-1.0], 1), (3, [1.0], 1), (8, [0.75], 2)]) == []  # no window under 0


def test_large_numbers(spark):
    rows = [(50, [2.0**21, 1.0], 1), (3, [2.0**21, 3.0], 1), (5, [2.0**21, 4.0], 1), (8, [2.0**20 + 2.0, 2.0], 2), (9, [2.0**20 + 2.0, 1.0], 2), (10, [1.0, 1.0], 2)]
    assert run(spark, rows) == brute(rows) and len(brute(rows)) == 4


def test_cells_come_in_order_and_bounds_hold():
    rng = np.random.default_rng(3)
    vectors = np.floor(256 * rng.normal(0, 0.2, (600, 16)))
    books = Codebooks(vectors[:200], 5)
    cells, radii = books.index(vectors)
    anchors = np.floor(256 * rng.normal(0, 0.2, (8, 16)))
    first, second = books.bounds(anchors, radii)
    for j in range(8):
        steps = list(walk(first[j], second[j]))
        assert sorted(c for _, c in steps) == list(range(25))
        assert all(a >= b for (a, _), (b, _) in zip(steps, steps[1:]))
        limit = dict((c, b) for b, c in steps)
        assert all(limit[c] >= s - 1e-6 for c, s in zip(cells, vectors @ anchors[j]))


def test_walk_stops_early_on_clustered_vectors(monkeypatch):
    from shelfcast.llm import hard_negatives as module
    monkeypatch.setattr(module, "AT_ONCE", 32)
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 400, (16, 8))
    vectors = np.floor(np.repeat(centres, 100, 0) + rng.normal(0, 5, (1600, 8)))
    labels, ids = np.arange(1600) % 3, np.arange(1600)
    books = Codebooks(vectors, 16)
    cells, radii = books.index(vectors)
    order = np.argsort(cells, kind="stable")
    here = Slice(books, ids[order], labels[order], vectors[order], cells[order], radii)
    seen, scores = [], here.scores
    monkeypatch.setattr(here, "scores", lambda a, rows: seen.append(len(rows)) or scores(a, rows))
    first, second = books.bounds(vectors[:1], radii)
    best = here.best_of_label(0, 0, vectors[0], first[0], second[0], 5)
    full = sorted((-int(s), int(i)) for s, i, y in zip(vectors @ vectors[0], ids, labels) if y == 0 and i)[:5]
    assert best == full and sum(seen) < 800
