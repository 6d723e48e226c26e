"""Byte BPE, rANS token files and packing."""

import array
import os
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brute import sequential_best_fit  # noqa: E402

from shelfcast.llm import rans
from shelfcast.llm.bpe import Encoder
from shelfcast.llm.common import Shared
from shelfcast.llm.packing import cut, pack_documents, pack_runs

FILES = [str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(FILES[0])
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_both_engines_agree_on_every_code_point_of_the_fast_range():
    encode = Encoder(*FILES)
    for c in map(chr, range(0x250)):
        for text in (c, c * 3, f"a{c}b", f" {c} x", f"1{c}2", f"{c}\n{c}", f".{c}.", f"'{c}", f"x {c}{c} y", f"{c} {c}  {c}"):
            assert list(encode(text)) == encode.library.encode(text, add_special_tokens=False).ids, text
    assert not encode.beyond.search("ɏ") and encode.beyond.search("ɐ")


@pytest.mark.parametrize("n", [1, 5, rans.LANES - 1, rans.LANES, rans.LANES + 1, 50_000, 300_001])
def test_block_round_trip_and_checkpoints(n):
    random_ = np.random.default_rng(n)
    ids = np.minimum(random_.zipf(1.3, n), 70_000).astype(np.uint32)
    found, counts = np.unique(ids, return_counts=True)
    table = rans.FrequencyTable(found, counts)
    assert table.freq.sum() == 1 << rans.SCALE and table.freq.min() >= 1
    payload, state, steps, words, saved = rans.encode_block(table, ids)
    slots = table.slots()
    assert (rans.decode_block(table, slots, payload, state, n) == ids).all()
    raw = payload.tobytes()
    row = {"start": 0, "n_tokens": n, "payload": raw, "payload_crc32": zlib.crc32(raw), "state": state.tobytes(),
           "check_step": steps, "check_word": words, "check_state": saved.tobytes()}
    assert len(steps) == max(0, -(-n // rans.LANES) - 1) // (rans.CHECKPOINT // rans.LANES)
    for a, b in ((0, n), (n // 2, n), (n - 1, n), (min(n - 1, 270_000), min(n, 270_010))):
        assert (rans.decode_range(table, slots, row, a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        rans.decode_range(table, slots, row | {"payload": raw[:-1] + b"\0" if raw else b"x", "payload_crc32": zlib.crc32(raw) ^ 1}, 0, n)


def test_size_is_near_the_entropy():
    ids = np.random.default_rng(1).choice(64, 400_000, p=np.arange(1, 65) / 2080).astype(np.uint32)
    found, counts = np.unique(ids, return_counts=True)
    p = counts / counts.sum()
    payload = rans.encode_block(rans.FrequencyTable(found, counts), ids)[0]
    # the last states hold up to 32 bits per lane as well
    assert payload.nbytes * 8 < 1.01 * len(ids) * -(p * np.log2(p)).sum()


def test_token_files(spark, make_docs, odd_rows, library, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK", 2000)
    path = Shared(spark, "test-files").path
    rans.write_token_files(make_docs(odd_rows, extra=True), path, *FILES, 2)
    got = sorted(rans.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in odd_rows), key=lambda i: -1 if i is None else i)
    texts = {}
    for doc_id, text in odd_rows:
        texts.setdefault(doc_id, []).append(library(text))
    at = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids) and ids in texts[r.doc_id]
        at += len(ids)
    digests = {r.start: r.ids_crc32 for r in rans.read_token_digests(spark, path).collect()}
    assert digests == {r.start: zlib.crc32(r.ids) for r in got}


def test_token_files_of_an_empty_table(spark, make_docs):
    path = Shared(spark, "test-files").path
    rans.write_token_files(make_docs([]), path, *FILES, 2)
    assert rans.read_token_digests(spark, path).count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_sequential_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 10, 64, 1024])
    lengths = [rng.randint(1, capacity if rng.random() < 0.5 else max(1, capacity // 8)) for _ in range(rng.randint(0, 500))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = pack_runs(counts, capacity)
    filled = {}
    for n, count in counts.items():
        rows = [r for r in plan if r[0] == n]
        for k in range(count):
            _, first, each, sequence, offset = [r for r in rows if r[1] <= k][-1]
            filled.setdefault(sequence + (k - first) // each, []).append((offset + (k - first) % each * n, n))
    for places in filled.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= capacity
    assert len(filled) == sequential_best_fit(lengths, capacity)


def test_cut():
    assert cut(1024, 1024) == [(0, 1024)]
    assert cut(2048, 1024) == [(0, 1024), (1024, 1024)]
    assert cut(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)]


def test_packing(make_docs, odd_rows, library):
    got = pack_documents(make_docs(odd_rows, extra=True), *FILES, 2).collect()
    want = []
    for doc_id, text in odd_rows:
        ids = array.array("I", library(text))
        want += [(doc_id, i, a, n, zlib.crc32(ids[a:a + n].tobytes())) for i, (a, n) in enumerate(cut(len(ids), 1024))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= 1024
    assert len(sequences) == sequential_best_fit([w[3] for w in want], 1024)
    assert pack_documents(make_docs([]), *FILES, 2).count() == 0


ADDED = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|", " <|endoftext|>\n日本", "plain text"]


def test_added_tokens_get_the_ids_of_the_library_as_loaded(spark, make_docs, monkeypatch):
    """In the encoder and in the queries, with and without the ranks file."""
    import corpus_pipeline
    from shelfcast.llm import registry
    loaded = Tokenizer.from_file(FILES[0])
    want = {i: loaded.encode(t, add_special_tokens=False).ids for i, t in enumerate(ADDED)}
    assert want[0] == [50256] and want[1][2:3] == [50256] and 50256 in want[4] and 50256 not in want[3]
    for encode in (Encoder(*FILES, True), Encoder(FILES[0], None, True)):
        assert {i: list(encode(t)) for i, t in enumerate(ADDED)} == want
    docs = make_docs(list(enumerate(ADDED)))
    monkeypatch.setattr(registry, "read_table", lambda *_: docs)
    crc = {i: zlib.crc32(array.array("I", ids + [2]).tobytes()) for i, ids in want.items()}
    assert sorted(r.ids_crc32 for r in registry.op4_rans_files(spark, "").collect()) == sorted(crc.values())
    for packed in (registry.op7_packing(spark, ""), corpus_pipeline.packing(spark, docs, "")):
        assert {r.doc_id: r.ids_crc32 for r in packed.collect()} == crc
