import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfcast.llm.mixing import mix_digest, mix_sources, repeated_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_version(rows, weights=(5, 2, 1), share=1.5):
    """(source, size, target) by passes of resharing, and the sequential sample of one source after another."""
    sizes = [(i, s, len(WORD.findall(t or "")), t or "") for i, t, s in rows]
    names = sorted({s for _, s, _, _ in sizes if s is not None}) + ([None] if any(s is None for _, s, _, _ in sizes) else [])
    words = {s: sum(x[2] for x in sizes if x[1] == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_ = {}, min(share, 2) * sum(words.values()), set(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > 2 * words[s]}
        for s in full or open_:
            target[s] = 2.0 * words[s] if full else unit * weight[s]
            left -= target[s] if full else 0
        open_ = open_ - full if full else set()
    taken = []
    for s in names:
        mine = [(i, n, t) for i, x, n, t in sizes if x == s]
        def copies(rate, n):
            return min(2.0, rate * max(1, n.bit_length()))
        low, high = 0.0, 4.0  # bisection for the rate
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(copies(mid, n) * n for _, n, _ in mine) < target[s] else (low, mid)
        rest = target[s] - sum(math.floor(copies(high, n) + 1e-9) * n for _, n, _ in mine)
        ranked = []
        for i, n, t in mine:
            e = copies(high, n)
            p = e - math.floor(e + 1e-9)
            h = hashlib.md5(f"42:{'' if i is None else i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()
            u = (int(h[:12], 16) + 0.5) / 2**48
            ranked.append((u / (1 - u) / (p / (1 - p)) if p > 1e-9 and n else math.inf, n, math.floor(e + 1e-9) if n else 0))
        at = 0
        for odds, n, whole in sorted(ranked):
            more = 0
            if odds < math.inf and rest > 0 and at < rest:
                more, at = (1 if at + n - rest <= rest - at else 0), at + n
            taken.append((s, n, (whole + more) * n))
    return words, target, sorted(taken, key=str)


@pytest.fixture
def make(spark):
    def build(rows):
        return spark.createDataFrame([(i, t, s, "x", "y", 3) for i, t, s in rows], "doc_id long, text string, source string, src string, rank string, size int")
    return build


def random_rows(n=700):
    rng = random.Random(7)
    out = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "c", "ä", "Z", None, "tiny"])
        words = 3 if source == "tiny" else int(rng.lognormvariate(3, 1.2))
        out.append((i, " ".join("w" for _ in range(words)), source))
    return out + [(9000, None, "b"), (9001, "", None), (9002, " \t", "empty"), (None, "no id here", "c"), (9003, "x " * 20_000, "Z")]


def test_equals_plain_version(make):
    rows = random_rows()
    words, target, taken = plain_version(rows)
    got = mix_sources(make(rows), carry=["doc_id", "source"]).select("doc.doc_id", "doc.source", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(rows)
    assert {(r.source, r.source_size) for r in got} == set(words.items())
    assert all(math.isclose(r.target, target[r.source], rel_tol=1e-12) for r in got)
    assert sorted(((r.source, r.size, r.taken) for r in got), key=str) == taken
    for s in words:
        total = sum(r.taken for r in got if r.source == s)
        assert abs(total - target[s]) <= max(r.size for r in got if r.source == s) / 2
    assert all(r.taken <= 2 * r.size for r in got)


def test_reruns_and_partitions_agree(make):
    frame = make(random_rows(300))
    runs = [sorted(map(tuple, mix_digest(x).collect()), key=str) for x in (frame, frame, frame.repartition(7), frame.orderBy(F.desc("doc_id")).coalesce(1))]
    assert all(r == runs[0] for r in runs)


def test_one_document_repeated(make):
    """A row that makes up most of a source is taken in the number of copies that the target asks for."""
    rows = [(1, "one two three four", "z")] * 900 + [(i, "w " * (i % 9 + 1), "z") for i in range(2, 100)] + [(i, "b " * 40, "b") for i in range(200, 400)]
    _, target, _ = plain_version(rows)
    runs = []
    for frame in (make(rows), make(rows).repartition(5)):
        got = mix_sources(frame, carry=["doc_id", "source"]).select("doc.*", "taken", "copies").collect()
        for s in ("b", "z"):
            assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= 20
        runs.append(sorted((r.doc_id, r.taken) for r in got))
        assert len({r.copies for r in got if r.doc_id == 1}) == 2
    assert runs[0] == runs[1]


def test_longer_documents_come_more_often(make):
    rows = [(i, "w " * (4 if i % 2 else 64), f"s{i % 3}") for i in range(3000)]
    got = mix_sources(make(rows), share=0.5).select("size", "copies").groupBy("size").avg("copies").collect()
    share = {r[0]: r[1] for r in got}
    assert 1.8 < share[64] / share[4] < 2.9  # bit lengths 7 and 3
    flat = mix_sources(make(rows), share=0.5, importance=F.lit(1)).groupBy("size").avg("copies").collect()
    flat = {r[0]: r[1] for r in flat}
    assert 0.85 < flat[64] / flat[4] < 1.15


def test_mix_itself(make):
    rows = random_rows(80)
    frame = make(rows)
    want = {r.doc_id: r.copies for r in mix_sources(frame).select("doc.doc_id", "copies").collect()}
    mix = repeated_documents(frame)
    assert mix.columns == frame.columns
    got = defaultdict(int)
    for r in mix.collect():
        got[r.doc_id] += 1
    assert got == {i: n for i, n in want.items() if n}


def test_empty_tables(make):
    assert mix_digest(make([])).collect() == []
    assert [tuple(r) for r in mix_digest(make([(1, None, None), (2, " ", "a")])).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
