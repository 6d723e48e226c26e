"""Personal data, toxicity and compression quality."""

import hashlib
import math
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brute import brute_spans  # noqa: E402

from shelfcast.llm import compression_quality, pii, toxicity
from shelfcast.llm.common import held_out
from shelfcast.llm.compression_quality import score_quality
from shelfcast.llm.labelled import labelled_sample
from shelfcast.llm.pii import KINDS, Field, Graph, base_spans, find_spans, learn_field, loose_spans, mask_pii, masked, pii_spans
from shelfcast.llm.toxicity import LexiconAutomaton, Scanner, choose_terms, drop_toxic, score_toxicity

PII = ["write a.b@x.example.com, or +1 (269) 555-3296 from 16.195.23.156", "card 4524 1322 6465 2876 and 4524132264652876",
       "300.1.1.1 1.2.3.4.5.6.7.8 0255.0.0.01", "a@b a@@b.c x@y.z@w.v", "+12 345", "4524132264652877", "٣.٣.٣.٣ 1.2.3.4"]


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    texts = PII + ["".join(rng.choice("ab@@..--+ 0123456789()11.%\n٣é") for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    for text in texts:
        assert base_spans(text) == brute_spans(text), text


@pytest.mark.parametrize("text", ["a@" * 50_000, "1" * 200_000, "+1" * 50_000, "1." * 50_000, "a.b@" * 30_000, "(at)" * 30_000, "+1 " + "(" * 100_000])
def test_long_runs_are_searched_in_linear_time(text):
    find_spans(text, None, 0.9)


REPEATED = "Card 4524132264652876 was used. " + "Nothing else here. " * 30 + "Again 4524/1322/6465/2876 and a.b(at)x(dot)com, a.b@x.com."


def fitted():
    counts = {}
    for i in range(200):
        graph = Graph(f"card 4524132264652876 and 4524132264652876, mail u{i}@x.com u{i}@x.com, host 10.0.0.{i} phone +1 (269) 555-3{i:03d} ref 9{i:014d}")
        label = [n[2] for n in graph.nodes]
        for b, l in zip(graph.bits, label):
            counts["unary", b, max(l, 0)] = counts.get(("unary", b, max(l, 0)), 0) + 1
        counts["same", 1, 0] = counts.get(("same", 1, 0), 0) + 2
    return Field(counts)


def test_field_adds_distant_lookalikes_of_observed_spans():
    field = fitted()
    base, spans = find_spans(REPEATED, field, 0.8)
    assert base == brute_spans(REPEATED) and set(base) <= set(spans)
    assert [REPEATED[a:b] for k, a, b in spans if k == "card"] == ["4524132264652876", "4524/1322/6465/2876"]
    assert [REPEATED[a:b] for k, a, b in spans if k == "email"] == ["a.b(at)x(dot)com", "a.b@x.com"]
    # repeated lookalikes alone stay out
    alone = "ref 8782024158507601 and 8782024158507601 and 8782024158507601"
    assert find_spans(alone, field, 0.9) == ([], [])


def exhaustive_marginals(field, graph):
    """Marginals of the joint distribution, summed over all labellings."""
    import itertools

    own, known = field.unary(graph.bits), graph.observed_labels()
    links = [(a, b, field.chain) for a, b in graph.chain] + [(a, b, field.skip[k]) for k in ("same", "similar") for a, b in getattr(graph, k)]
    for i, (_, _, label) in enumerate(graph.nodes):
        for y in range(5):
            if label >= 0:
                own[i, y] = 0.0 if y == label else -50.0
            elif y and y not in known[i]:
                own[i, y] -= field.unseen
    total = np.zeros((len(graph.nodes), 5))
    for labels in itertools.product(range(5), repeat=len(graph.nodes)):
        p = np.exp(sum(own[i][l] for i, l in enumerate(labels)) + sum(t[labels[a], labels[b]] for a, b, t in links))
        for i, l in enumerate(labels):
            total[i, l] += p
    return total / total.sum(1, keepdims=True)


def test_marginals_of_a_tree_are_exact():
    """Without loops message passing gives the marginals of the joint distribution."""
    field = fitted()
    graph = Graph("a 45241322646528 b 7777777 c 10.0.0.1")
    assert graph.chain and not graph.same and not graph.similar
    assert np.allclose(field.marginals(graph, 200), exhaustive_marginals(field, graph), atol=1e-4)


@pytest.mark.parametrize("text", [
    "card 4524132264652876 then 4524/1322/6465/2876 then 4524 1322 6465 2876.",
    "a 8782024158507601 b 8782024158507601 c 8782024158507601 d 10.0.0.7",
    "mail a.b@x.com or a.b(at)x(dot)com or a.b(at)x(dot)com, ref 452413226465287 and 452413226465287",
    "phone +1 (269) 555-3296 or (269) 555-3296 or 269/555/3296, host 10.0.0.1",
])
def test_marginals_on_cycles_are_close_to_exact(text):
    """Chain and skip links make loops: loopy messages settle near the marginals of the joint distribution, and decide alike."""
    field, graph = fitted(), Graph(text)
    assert len(graph.chain) + len(graph.same) + len(graph.similar) >= len(graph.nodes)  # a cycle
    got, want = field.marginals(graph, 300), exhaustive_marginals(field, graph)
    assert (got.argmax(1) == want.argmax(1)).all()
    assert ((got >= 0.9) == (want >= 0.9)).all() and np.abs(got - want).max() < 0.1
    base, spans = find_spans(text, field, 0.9)
    decided = [(pii.LABELS[y.argmax()], a, b) for (a, b, label), y in zip(graph.nodes, want) if label < 0 and y.argmax() and y.max() >= 0.9]
    assert sorted(spans) == sorted(base + decided)


def test_the_field_decides_not_a_gate():
    """A shape that is all but certain becomes a span without an observed repetition, if its doubt is small."""
    field, text = fitted(), "card 8782024158507601 used"
    assert find_spans(text, field, 0.9) == ([], [])
    field.unseen = -20.0
    assert [k for k, _, _ in find_spans(text, field, 0.9)[1]] != []


def test_memory_of_many_mentions_is_bounded():
    """Links of a kind share one table: about 1 KB a mention at the peak."""
    import tracemalloc
    graph = Graph(" ".join(f"{i:07d} and 10.0.0.{i % 250} or" for i in range(6000)))
    field = fitted()
    tracemalloc.start()
    field.marginals(graph, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(graph.nodes) == 12_000 and peak < 1500 * len(graph.nodes)


def test_loose_spans_touch_no_base_span():
    base = base_spans(REPEATED)
    assert all(b <= x or a >= y for a, b in loose_spans(REPEATED, base) for _, x, y in base)


def test_pii_rows(make_docs, odd_rows):
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(PII)] + [(200, REPEATED)]
    got = {(r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone): r.spans for r in pii_spans(make_docs(rows, extra=True)).collect()}
    for doc_id, text in rows:
        base = brute_spans(text or "")
        key = (doc_id, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest(),
               *[sum(k == x for x, _, _ in base) for k in KINDS])
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(got[key].split(","))  | {""}
    assert pii_spans(make_docs(rows)).count() == len(rows)
    assert pii_spans(make_docs([])).count() == 0
    assert learn_field(make_docs([(1, "no digit")]), 10) is None


def test_masking(make_docs):
    assert masked("a 1.2.3.4 b", [("ip", 2, 9)]) == "a [IP] b"
    assert masked("0123456789", [("card", 1, 5), ("phone", 3, 8)]) == "0[CARD]89"
    docs = make_docs([(1, "to a@b.cd now"), (2, None), (3, "clean")], extra=True)
    got = {r.doc_id: r for r in mask_pii(docs).collect()}
    assert mask_pii(docs).columns == docs.columns
    assert got[1].text == "to [EMAIL] now" and got[1].n_chars == 14
    assert got[2].text is None and got[3].text == "clean"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distances():
    rng = random.Random(2)
    words, stems = ["abcab", "bbcc", "aabbccabc", "cacabacbab", "cab"], ["bcab", "cccaaab"]
    automaton = LexiconAutomaton(words, stems)
    for _ in range(20_000):
        text = "".join(rng.choice("abcx") for _ in range(rng.randint(0, 12)))
        near = [e for w in words if (e := edits(text, w)) <= LexiconAutomaton.word_edits(w)]
        near += [e for s in stems for k in range(len(text) + 1) if (e := edits(text[:k], s)) <= LexiconAutomaton.stem_edits(s)]
        assert automaton.match(text) == min(near, default=-1), text


def test_lexicon_prefers_words_and_stems_that_cover():
    rows = [("idio", True, 50, 0), ("idiot", True, 50, 0), ("idiot", False, 49, 0),
            ("lowe", True, 40, 0), ("lowei", True, 40, 0), ("loweia", False, 9, 0), ("loweib", False, 9, 0), ("bad", False, 30, 0)]
    assert choose_terms(rows) == (["bad", "idiot", "loweia", "loweib"], ["lowei"])


def test_words_keep_their_edits_beside_a_stem():
    rows = [("idiot", True, 100, 0), ("idiot", False, 40, 0), ("idiots", False, 30, 0), ("idiotic", False, 30, 0)]
    scanner = Scanner(*choose_terms(rows))
    # a letter for another is one edit; two letters that changed places are two, which terms of nine letters allow
    assert [w for w in "idi0t iidiot idoit id1otic idiotics id1ots unrelated idea".split() if scanner.matches([w])] == [
        "idi0t", "iidiot", "id1otic", "idiotics", "id1ots"]


def plain_features(text, words, stems):
    """Features by edit distances of every token to every term, without an automaton."""
    tokens = text.split()

    def best(t):
        found = [e for w in words if (e := edits(t, w)) <= LexiconAutomaton.word_edits(w)]
        found += [e for s in stems for k in range(len(t) + 1) if (e := edits(t[:k], s)) <= LexiconAutomaton.stem_edits(s)]
        return min(found, default=-1)
    hits = [(i, e) for i, w in enumerate(tokens) if (e := best(toxicity.token(w))) >= 0]
    counts, context = {"exact": 0, "fuzzy": 0, "quoted": 0}, 0.0
    for i, e in hits:
        around = {toxicity.token(w) for w in tokens[max(0, i - 8):i + 9]}
        in_quotes = Scanner.quoted(tokens, i)
        places = [j for j, _ in hits]
        near = any(0 < i - j <= 8 for j in places) + any(0 < j - i <= 8 for j in places)
        context += max(0.0, 1 - 0.6 * in_quotes - 0.2 * bool(around & toxicity.REPORTING) + 0.5 * bool(around & toxicity.SECOND_PERSON) + 0.25 * near)
        counts["quoted" if in_quotes else "fuzzy" if e else "exact"] += 1
    n = max(len(tokens), 1)
    return [math.log1p(counts["exact"]), math.log1p(counts["fuzzy"]), math.log1p(counts["quoted"]), math.log1p(context), float(counts["exact"] > 0),
            math.log1p(100 * len(hits) / n), math.log(n)]


def test_toxicity_scores_equal_a_plain_scan(make_docs, make_labels):
    """The query's scores against a scan of every token and term, on misspelled, quoted and clean texts."""
    rows, labels = toxic_table()
    rng = random.Random(12)
    rows = rows[:300] + [(i, t.replace("scumbag", rng.choice(["scumbag", "scunbag", "scumbagg", '"scumbag"', "you scumbag"]))) for i, t in rows[300:600]]
    docs, marks = make_docs(rows), make_labels(labels[:600])
    lexicon, model = toxicity.learn(docs, marks, lambda c: ~held_out(c, 4, 2), 4000, 32 << 10, 5000)
    assert lexicon[0] and lexicon[1]
    got = {r.doc_id: r.score for r in score_toxicity(docs, marks).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(float(model(np.array([plain_features(t, *lexicon)]))[0]), abs=1e-12)


def test_lexicon_size_is_a_parameter(make_docs, make_labels):
    rows, labels = toxic_table()
    few = toxicity.learn(make_docs(rows), make_labels(labels), lambda c: ~held_out(c, 4, 2), 4000, 32 << 10, 2)
    assert sum(map(len, few[0])) <= 2


def test_sample_is_bounded_by_rows(spark, make_docs, make_labels):
    """A labelled document that makes up most rows is one row of the sample."""
    rows = [(1, f"copy {i % 7}") for i in range(3000)] + [(i, f"text {i}") for i in range(2, 40)]
    sample = labelled_sample(make_docs(rows), make_labels([(i, 1, i % 2) for i in range(40)]), "toxic", lambda c: c > 0, 5, 1000)
    got = sample.collect()
    assert len(got) <= 10 and len({r.doc_id for r in got}) == len(got)
    everything = labelled_sample(make_docs(rows), make_labels([(1, 1, 0)]), "toxic", lambda c: c > 0, 5, 1000).collect()
    assert [(r.doc_id, r.text, r.label) for r in everything] == [(1, "copy 0", 0)]


def test_quotation_scores_below_abuse():
    scanner = Scanner(["idiot"], [])
    abuse = scanner.features("you are an idiot and a fool")
    quote = scanner.features('he said "what an idiot indeed" to the press')
    assert abuse[3] > quote[3] and abuse[2] == 0 and quote[2] > 0
    assert scanner.matches("an id1ot!".split()) == [(1, 1)]


def toxic_table():
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1200):
        words = [f"w{rng.randrange(3000):x}"[:8].replace("0", "o") for _ in range(60)]
        toxic = i % 4 == 1
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["scumbag", "worthless", "lowei" + rng.choice(["sa", "to", "mi", "ra"])])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(make_docs, make_labels, odd_rows):
    rows, labels = toxic_table()
    rows += [(5000, "such a w0rthless thing, and a scumbagg too, scumbag"), (5001, None)]
    docs, labels_ = make_docs(rows + [(9000 + (r[0] or 0), r[1]) for r in odd_rows], extra=True), make_labels(labels + [(None, 0, 1), (1, 0, None)])
    got = {r.doc_id: r for r in score_toxicity(docs, labels_).collect()}
    held = [i for i, _, _ in labels if got[i].held_out]
    assert 200 < len(held) < 400
    assert sum(got[i].predicted == int(i % 4 == 1) for i in held) >= 0.97 * len(held)
    assert got[5000].predicted == 1 and 0 <= got[5001].score < 0.3
    left = drop_toxic(docs, labels_)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, r in got.items() if not r.predicted}
    assert score_toxicity(make_docs([]), labels_).count() == 0
    assert {r.score for r in score_toxicity(docs, make_labels([])).collect()} == {0.0}


def test_toxicity_learns_nothing_from_held_out_rows(make_docs, make_labels):
    rows, labels = toxic_table()
    docs = make_docs(rows)
    held = {r.doc_id for r in score_toxicity(docs, make_labels([])).where("held_out").collect()}
    turned = [(i, q, 1 - t if i in held else t) for i, q, t in labels]
    first = score_toxicity(docs, make_labels(labels)).orderBy("doc_id").collect()
    assert score_toxicity(docs, make_labels(turned)).orderBy("doc_id").collect() == first


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHE", 10)
    scanner = Scanner(["idiot"], [])
    assert scanner.matches([f"w{i}" for i in range(100)] + ["idiot"]) == [(100, 0)]
    assert len(scanner.cache) <= 10


def test_compression_quality(make_docs, make_labels, odd_rows):
    rng = random.Random(9)
    good = ["".join(rng.choice(["ta", "re", "mi", "so", "ne"]) for _ in range(rng.randint(1, 4))) for _ in range(500)]
    rows, labels = [], []
    for i in range(800):
        bad = i % 5 == 2
        words = [rng.choice(good) + (rng.choice(["$$$", "%%%", "###"]) if bad else "") for _ in range(rng.randint(20, 200))]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), 0))
    docs = make_docs(rows + [(9000 + (r[0] or 0), r[1]) for r in odd_rows], extra=True)
    scored = score_quality(docs, make_labels(labels))
    got = {r.doc_id: r for r in scored.collect()}
    held = [i for i, _, _ in labels if got[i].held_out]
    assert sum(got[i].predicted == int(i % 5 != 2) for i in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    turned = make_labels([(i, 1 - q if i in set(held) else q, t) for i, q, t in labels])
    assert score_quality(docs, turned).orderBy("doc_id").collect() == scored.orderBy("doc_id").collect()
    assert score_quality(make_docs([]), make_labels(labels)).count() == 0
    assert {r.score for r in score_quality(docs, make_labels([])).collect()} == {0.5}
    assert {r.score for r in score_quality(docs, make_labels([(1, 1, 0), (3, 1, 0)])).collect()} == {1.0}


def test_quality_scores_equal_plain_compression(make_docs, make_labels):
    """The query's scores against chunk sizes compressed here, with compressors of this test's own."""
    import zstandard
    docs = make_docs([(i, " ".join(random.Random(i).choices(["ta", "remi", "sone", "$$" if i % 3 == 0 else "la"], k=30 + i % 900))) for i in range(240)] + [(900, None), (901, "")])
    labels = make_labels([(i, int(i % 3 > 0), 0) for i in range(240)])
    books, model = compression_quality.fit(docs, labels, lambda c: ~held_out(c, 5, 0), 3000, 32 << 10, 64 << 10, 3)
    got = {r.doc_id: r.score for r in score_quality(docs, labels).collect()}

    def total(data, book):
        out = 0
        for at in range(0, max(len(data), 1), 1024):
            packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(book), write_content_size=False,
                                              write_checksum=False, write_dict_id=False)
            out += len(packer.compress(data[at:at + 1024]))
        return out
    for r in docs.collect():
        data = (r.text or "").encode()
        bad, good = (total(data, b) for b in books)
        n, diff = max(len(data), 1), (good - bad) / max(good, bad)
        x = [diff, diff**2, good / n, (good / n)**2, math.log(good / n), math.log(bad / n), math.log(n), diff * math.log(n), diff * math.log(good / n)]
        assert got[r.doc_id] == pytest.approx(float(model(np.array([x]))[0]), abs=1e-9)


def test_held_out_rule(make_docs):
    import zlib

    rows = make_docs([(i, "") for i in range(50)] + [(None, "")]).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_field_counts_every_document(make_docs, monkeypatch):
    """A kind that only one document holds, the last by hash among more than 20,000, has a fitted model."""
    plain = make_docs([(i, f"host 10.0.0.{i % 200}") for i in range(20_050)])
    last = plain.orderBy(F.xxhash64("doc_id").desc()).first().doc_id
    docs = plain.withColumn("text", F.when(F.col("doc_id") == last, "card 4524132264652876").otherwise(F.col("text")))
    seen = []
    monkeypatch.setattr(pii, "Field", lambda tallies: seen.append(tallies) or Field(tallies))
    mask_pii(docs)
    assert sum(n for k, n in seen[0].items() if k[0] == "unary") == 20_050
    assert sum(n for (part, _, label), n in seen[0].items() if part == "unary" and label == 1 + KINDS.index("card")) == 1


def test_skip_weights_are_rates_of_agreement():
    """They follow the share of agreeing pairs, not the number of documents."""
    def weight(agree, other):
        return Field({("unary", 1, 1): 1, ("same", 1, 0): agree, ("same", 0, 0): other}).skip["same"][0, 0]
    assert abs(weight(10**6, 0) - weight(10**9, 0)) < 0.01
    assert abs(weight(9 * 10**6, 10**6) - weight(9 * 10**9, 10**9)) < 0.01
    assert weight(0, 10**6) < 0 < weight(1, 0) < weight(10**6, 0)
