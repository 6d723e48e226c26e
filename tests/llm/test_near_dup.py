import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brute import brute_components  # noqa: E402

from shelfcast.llm.near_dup import drop_near_duplicates, matches_for, near_duplicates, shingle_set, signature, _spread


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    base = [[word() for _ in range(rng.choice([3, 6, 40, 120]))] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base:  # copies with a few changed words: on both sides of the similarity
        for changes in (0, 1, 2, 4, 8):
            c = list(b)
            for _ in range(changes):
                c[rng.randrange(len(c))] = word()
            texts.append(" ".join(c).upper() if changes == 1 else "\t".join(c))
    chain = [word() for _ in range(200)]  # each close to the next one only
    for k in range(25):
        texts.append(" ".join(chain))
        for j in range(3):
            chain[(k * 3 + j) * 2 % 200] = word()
    passage = " ".join(word() for _ in range(60))  # shared by many, no near copies
    texts += [passage + " " + " ".join(word() for _ in range(25)) for _ in range(60)]
    rng.shuffle(texts)
    return [(i * 3 % 1009, t) for i, t in enumerate(texts)]


def test_components_equal_brute_force(make_docs, rows, odd_rows):
    table = rows + [(i, t) for i, t in odd_rows if i != 4] + [(4, "one two three"), (4, "one two three")]
    ids = [i for i, _ in rows]
    table = [(i if n < len(rows) or i is None else i + 5000, t) for n, (i, t) in enumerate(table)]
    assert len(set(ids)) == len(ids)
    got = near_duplicates(make_docs(table, extra=True)).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(table)


def test_dropping(make_docs, rows):
    docs = make_docs(rows + [(None, "no id"), (None, "no id"), (7000, None)], extra=True)
    got = drop_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = [r.doc_id for r in got.collect()]
    assert sorted(i for i in kept if i is not None) == [i for i, _, _, k in sorted(brute_components(rows)) if k] + [7000]
    assert kept.count(None) == 2
    assert drop_near_duplicates(make_docs([])).count() == 0


def test_signatures_estimate_the_similarity():
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    a, b = shingle_set(" ".join(words), 5), shingle_set(" ".join(words[:1700] + words[:100]), 5)
    scale, shift = _spread(2048, 1), _spread(2048, 2)
    same = float(np.mean(signature(a, scale, shift) == signature(b, scale, shift)))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(same - true) < 0.04


def test_slices_of_a_long_text_give_the_same_signature(monkeypatch):
    from shelfcast.llm import near_dup
    found = shingle_set(" ".join(f"w{i * 7919 % 10007}" for i in range(3000)), 5)
    scale, shift = _spread(8, 1), _spread(8, 2)
    whole = signature(found, scale, shift)
    monkeypatch.setattr(near_dup, "SLICE", 100)
    assert (signature(found, scale, shift) == whole).all()


def test_matches():
    assert matches_for(85, 48, 1e-7) == 26 and matches_for(80, 48, 1e-7) == 22 and matches_for(1, 4, 0.5) == 1


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_bitmap_lets_every_key_through(spark, bits):
    from pyspark.sql import functions as F

    from shelfcast.llm.common import may_contain
    keys = spark.range(0, 3000, 30)
    table = spark.range(-100, 5000)
    got = {r.id for r in table.where(may_contain(keys, "id", F.col("id"), bits)).collect()}
    assert set(range(0, 3000, 30)) <= got and (bits == 64 or len(got) < 200)
    assert bits == 64 or table.where(may_contain(keys.limit(0), "id", F.col("id"), bits)).count() == 0


def test_rows_of_one_doc_id_are_one_document(make_docs):
    """Different texts under one doc_id are linked, in whatever order the rows come."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, b), (2, b), (3, a + " c"), (4, "other words of its own here"), (5, b + " d"), (0, "words alone that link with nothing")]
    want = [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 1, False)]
    for table in (rows, rows[::-1], [rows[1], rows[0], *rows[2:]]):
        got = near_duplicates(make_docs(table)).collect()
        assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == want


def edited(rng, base, places, word):
    out = list(base)
    for k in rng.sample(range(len(out)), places):
        out[k] = word()
    return out


def near_group(rng, n, vocabulary, places=(3, 4, 5)):
    """An origin of 150 words and n copies with a few changed words: mostly just under 85 % of it."""
    base = [f"b{i}" for i in range(150)]
    return [" ".join(base)] + [" ".join(edited(rng, base, rng.choice(places), lambda: f"v{rng.randrange(vocabulary)}")) for _ in range(n)]


@pytest.mark.parametrize("vocabulary", [3, 40, 10**6])
def test_a_group_around_a_centre_equals_brute_force(make_docs, vocabulary):
    """Changed words in common (few of them to choose from) or not, and copies of copies."""
    rng = random.Random(vocabulary)
    texts = near_group(rng, 90, vocabulary, (1, 2, 3, 4, 5, 7))
    texts += [" ".join(edited(rng, rng.choice(texts[-40:]).split(), 2, lambda: f"v{rng.randrange(vocabulary)}")) for _ in range(60)]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    for percent in (80, 85):
        got = near_duplicates(make_docs(rows), percent).collect()
        assert sorted(map(tuple, got), key=str) == brute_components(rows, percent)


def open_members_of(spark, texts):
    """What the second pass starts from, for one group around texts[0]: (sets, near_dup module)."""
    from shelfcast.llm import near_dup
    sets = [shingle_set(t, 5) for t in texts]
    linked = [0 if 100 * len(np.intersect1d(s, sets[0])) >= 85 * len(np.union1d(s, sets[0])) else i for i, s in enumerate(sets)]
    rows = [(i, c, 0, s.astype(np.int64).tolist(), np.setxor1d(s, sets[0]).astype(np.int64).tolist()) for i, (c, s) in enumerate(zip(linked, sets))]
    schema = "rep long, component long, centre long, shingles array<long>, residual array<long>"
    return spark.createDataFrame(rows, schema), near_dup, sets, linked


@pytest.mark.parametrize("vocabulary", [10**9, 20_000])
def test_join_rows_grow_with_the_group_not_its_square(spark, vocabulary):
    """Most members are under the similarity to the centre; a few of them share a change by chance (the second case)."""
    from shelfcast.llm.common import Shared
    for n in (400, 800, 1600):
        sets, near_dup, _, linked = open_members_of(spark, near_group(random.Random(9), n, vocabulary, (1, 2, 3, 3, 3, 4, 5)))
        assert len(set(linked)) > n / 2
        store = Shared(spark, "test-growth")
        lists = near_dup.residual_lists(sets, 85, store)
        rows = lists.count(), near_dup.within_centres(lists, 85).count(), near_dup.between_centres(sets, 85).count()
        assert rows[0] <= (n if vocabulary == 20_000 else 0) and rows[1:] == (0, 0), (n, rows)


def test_residual_pairs_lose_no_link(spark):
    from shelfcast.llm.common import Shared
    rng = random.Random(4)
    sets, near_dup, shingles, linked = open_members_of(spark, near_group(rng, 250, 2, (2, 3, 4, 6)))
    for percent in (80, 85):
        lists = near_dup.residual_lists(sets, percent, Shared(spark, "test-residual"))
        got = {(r.a, r.b) for r in near_dup.within_centres(lists, percent).collect()}
        want = {(a, b) for b in range(len(shingles)) for a in range(b) if linked[a] != linked[b]
                and 100 * len(np.intersect1d(shingles[a], shingles[b])) >= percent * len(np.union1d(shingles[a], shingles[b]))}
        assert want and want <= got


def test_groups_of_different_centres_meet_by_blocks(spark):
    """Two groups that share shingles: pairs between them only, never inside one."""
    from pyspark.sql import functions as F

    from shelfcast.llm import near_dup
    n = 400
    rows = [(i, i, 0, [*range(100), 1000 + i], []) for i in range(n)] + [(n, n, None, [*range(95), *range(2000, 2005)], None),
                                                                      (n + 1, n + 1, None, [*range(5000, 5100)], None)]
    sets = spark.createDataFrame(rows, "rep long, component long, centre long, shingles array<long>, residual array<long>")
    for percent in (80, 85):
        want = {(i, n) for i in range(n)}  # 95 of 106 common
        assert {(r.a, r.b) for r in near_dup.between_centres(sets, percent).collect()} == want
    first = sets.select(F.explode("shingles").alias("shingle"), F.coalesce("centre", -1 - F.col("component")).alias("block"),
                        F.pmod(F.xxhash64("rep"), F.lit(near_dup.PARTS)).alias("part"))
    assert near_dup.meetings(first).groupBy("shingle").count().agg(F.max("count")).first()[0] <= near_dup.PARTS
