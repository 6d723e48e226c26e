"""Quality rules and k-d sharding (DataFrame functions only)."""

import collections
import random
import re
import zlib
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from shelfcast.llm import kd_sharding, quality_rules
from shelfcast.llm.kd_sharding import leaf_cells, shard_by_bytes, within
from shelfcast.llm.quality_rules import binomial_tail, choose_cutoffs, keep_good, quality_verdicts, text_counts, with_strata

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts_and_base_rules(make_docs, make_labels, odd_rows):
    rows = odd_rows + [(20, "a b c d e a b c d e f g h i j"), (21, "x\nx\n\n \nx y"), (22, "a$b <c> #|& 100%"),
                       (23, "w " * 30), (24, "one two\x0bthree\x0cfour\x1cfive six seven eight nine ten eleven"), (25, " ")]
    got = quality_verdicts(make_docs(rows, extra=True), make_labels([])).collect()
    want = []
    for doc_id, text in rows:
        c = brute_counts(text)
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        want.append((doc_id, *c, failed, not failed))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert quality_verdicts(make_docs([]), make_labels([])).count() == 0


@pytest.mark.parametrize("n,k,rate", [(1, 0, 0.01), (300, 0, 0.01), (300, 2, 0.01), (5000, 40, 0.01), (10, 1, 0.2), (200_000, 1900, 0.01)])
def test_binomial_tail_is_exact(spark, n, k, rate):
    got = spark.createDataFrame([(n, k)], "n long, k long").select(binomial_tail(F.col("n"), F.col("k"), rate)).first()[0]
    p = Fraction(rate)
    terms = [comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)] if n <= 5000 else None
    if terms is None:  # by logarithms
        from math import exp, lgamma, log
        want = sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(rate) + (n - i) * log(1 - rate)) for i in range(k + 1))
    else:
        want = float(sum(terms))
    assert got == pytest.approx(want, rel=1e-7)


def test_tail_cut_is_an_upper_bound(spark, monkeypatch):
    frame = spark.createDataFrame([(200_000, 1900)], "n long, k long")
    whole = frame.select(binomial_tail(F.col("n"), F.col("k"), 0.01)).first()[0]
    monkeypatch.setattr(quality_rules, "TAIL_TERMS", 200)
    cut = frame.select(binomial_tail(F.col("n"), F.col("k"), 0.01)).first()[0]
    assert whole * (1 - 1e-12) <= cut <= whole * 1.001


def test_cutoffs_limit_false_rejection(spark, make_docs, make_labels):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(3000):
        good = i % 3 > 0
        words = [f"w{rng.randrange(10**6)}" + ("" if good or rng.random() < 0.3 else "$%") for _ in range(30)]
        if good and i % 2000 == 1:  # a few good ones look bad
            words = [w + "$$" for w in words]
        rows.append((i, " ".join(words), "en" if i % 5 else "xx"))
        labels.append((i, int(good), 0))
    docs, labels = make_docs(rows, extra=True), make_labels(labels + [(None, 1, 0), (1, None, 0)])
    counted, strata = with_strata(text_counts(docs.select("doc_id", "lang", "text")), labels, 1000)
    assert strata == 2
    chosen = {(r.stratum, r.rule): r.cutoff for r in choose_cutoffs(counted, labels, 0.05, 0.05, 0.0, strata).collect()}
    assert ("en", "symbols") in chosen
    # 400 good documents of the small stratum can't show a rate of 1 % at that level
    assert not [k for k in chosen if k[0] == "other"]
    kept = {r.doc_id for r in keep_good(docs, labels, alpha=0.05).select("doc_id").collect()}
    good = [i for i in range(3000) if i % 3 and i % 5]
    assert sum(i not in kept for i in good) <= 0.01 * len(good)
    assert sum(i in kept for i in range(3000) if i % 3 == 0 and i % 5) < 300
    assert keep_good(docs, labels).columns == docs.columns


def test_shards(make_docs, odd_rows):
    rng = random.Random(2)
    rows = [(i, "x" * int(rng.paretovariate(1.2) * 20) + str(i) + ("é" * (i % 7) if i % 3 else "")) for i in range(100, 3000)]
    rows += [(5000 + i, "a copy that many documents share") for i in range(300)] + [r for r in odd_rows if r[0] not in (7, 8)]
    got = shard_by_bytes(make_docs(rows, extra=True), 8).collect()
    size = {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r.size
    assert len(size) == 8 and max(size.values()) < 1.05 * min(size.values())
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows if i is not None)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    places = {}
    for r in got:
        places.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(p) == 1 for p in places.values())
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_a_giant_group_is_dealt_out(make_docs):
    rows = [(i, "the same text in a third of all bytes, and more") for i in range(4000)] + [(10_000 + i, f"text {i} " * 3) for i in range(4000)]
    got = shard_by_bytes(make_docs(rows), 8).collect()
    size = collections.Counter()
    for r in got:
        size[r.shard] += r.size
    assert max(size.values()) < 1.1 * min(size.values())


@pytest.mark.parametrize("n", [1, 3, 5, 8])
def test_any_number_of_shards(make_docs, n):
    got = shard_by_bytes(make_docs([(i, f"text {i}") for i in range(500)]), n).collect()
    size = collections.Counter()
    for r in got:
        size[r.shard] += r.size
    assert sorted(size) == list(range(n)) and max(size.values()) < 1.05 * min(size.values())


def test_tree_equals_plain_weighted_medians(spark):
    """Every cut against a sort of its cell: the widest dimension, and the key nearest to the wanted weight."""
    rng = random.Random(6)
    rows = []
    for i in range(700):
        dims = int(rng.paretovariate(1.1) * 30), rng.choice([0, 0, rng.randrange(10**6)])
        rows.append((*[(d << 32) + rng.getrandbits(32) for d in dims], dims[0] + 1, *dims))
    points = spark.createDataFrame(rows, "key_0 long, key_1 long, w long, dim_0 long, dim_1 long")
    load = dict.fromkeys(leaf_cells(8), 0) | {8: 900, 13: 400}
    got = kd_sharding.build_tree(points, 8, 2, load)
    cells, scale, want = {1: (rows, 8)}, None, []
    while any(n > 1 for _, n in cells.values()):
        level, below = {}, {}
        for c, (mine, n) in cells.items():
            if n == 1:
                below[c] = mine, n
                continue
            widths = [max(r[3 + d] for r in mine) - min(r[3 + d] for r in mine) for d in (0, 1)]
            scale = scale or [max(w, 1) for w in widths]
            d = max((0, 1), key=lambda i: widths[i] / scale[i])
            heavy = {x: sum(w for leaf, w in load.items() if within(leaf, x)) for x in (c, 2 * c)}
            left = (sum(r[2] for r in mine) + heavy[c]) * (n // 2) / n - heavy[2 * c]
            best, at = None, 0
            for r in sorted(mine, key=lambda r: r[d]):
                if at + r[2] >= left:
                    best = r[d] if at + r[2] - left <= left - at else r[d] - 1
                    break
                at += r[2]
            level[c] = d, best
            below[2 * c] = [r for r in mine if r[d] <= best], n // 2
            below[2 * c + 1] = [r for r in mine if r[d] > best], n - n // 2
        want.append(level)
        cells = below
    for a, b in zip(got, want):
        assert {c: d for c, (d, _) in a.items()} == {c: d for c, (d, _) in b.items()}
        for c, (d, cut) in a.items():  # cuts that part the rows alike
            assert {r for r in rows if r[d] <= cut} == {r for r in rows if r[d] <= b[c][1]}


def test_slots_of_one_repeated_row_are_spread(make_docs, monkeypatch):
    """A document that repeats is numbered in many windows, and slots stay gapless."""
    monkeypatch.setattr(kd_sharding, "SLOT_ROWS", 50)
    got = shard_by_bytes(make_docs([(1, "the same")] * 1500 + [(i, f"text {i}") for i in range(2, 500)]), 3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(doc_id" in plan and "row#" in plan
    rows = got.collect()
    for s in range(3):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_shards_of_nothing(make_docs):
    assert shard_by_bytes(make_docs([]), 8).count() == 0
    assert shard_by_bytes(make_docs([(1, None)]), 8).count() == 1


def test_cells():
    assert leaf_cells(4) == [4, 5, 6, 7] and leaf_cells(3) == [2, 6, 7]
    assert within(6, 3) and within(3, 3) and not within(2, 3) and not within(3, 6)
    assert kd_sharding.place_heavy([], [1], 10.0) == ([], {1: 0})


def test_penalty_is_a_parameter(make_docs, make_labels):
    """A cutoff that rejects half of the bad and 0.3 % of the good documents, certified at a risk of 1 % a rule only."""
    clean = " ".join(f"w{i}" for i in range(20))
    rows = [(i, clean + (" ###########" if i < 12 else "")) for i in range(4000)]
    rows += [(4000 + i, clean + (" ###########" if i < 50 else "")) for i in range(100)]
    docs, labels = make_docs(rows), make_labels([(i, int(i < 4000), 0) for i, _ in rows])
    kept = lambda **k: {r.doc_id for r in keep_good(docs, labels, **k).collect()}
    assert len(kept()) == 4100
    assert len(kept(alpha=0.05)) == 4100 - 62
    assert len(kept(alpha=0.05, penalty=200.0)) == 4100


def test_strata_come_from_the_labelled_documents(make_docs, make_labels):
    """Any language with enough good documents is a stratum of its own; the rest share one, and a null language is of it."""
    good, bad = " ".join(f"w{i}" for i in range(20)), " ".join(f"w{i}####" for i in range(20))
    langs = ["it"] * 1200 + ["pt"] * 1100 + ["xx"] * 30 + [None] * 30
    rows = [(i, bad if i % 10 == 0 else good, lang) for i, lang in enumerate(langs)]
    docs, labels = make_docs(rows), make_labels([(i, int(i % 10 > 0), 0) for i, _, _ in rows])
    counted, strata = with_strata(text_counts(docs.select("doc_id", "lang", "text")), labels, 900)
    assert strata == 3 and {r.stratum for r in counted.select("stratum").distinct().collect()} == {"it", "pt", "other"}
    kept = [r.lang for r in keep_good(docs, labels, alpha=0.05, min_good=900).collect()]
    assert [kept.count(x) for x in ("it", "pt", "xx", None)] == [1080, 990, 30, 30]
    assert with_strata(counted.drop("stratum"), labels, 5000)[1] == 1 and keep_good(docs, make_labels([])).count() == len(rows)
