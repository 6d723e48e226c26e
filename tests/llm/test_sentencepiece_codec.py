import hashlib
import struct

import public_tokenizers
import pytest
import sentencepiece

from shelfcast.llm.sentencepiece_codec import CharacterMap, OffsetCodec, encode_decode, encode_decode_digest

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))


def double_array(mapping):
    """A compiled character map: double-array trie of the keys, then NUL-ended replacements."""
    texts, values = b"", {}
    for key, value in sorted(mapping.items()):
        values[key] = len(texts)
        texts += value + b"\0"
    units, used, bases = {0: 0}, {0}, set()

    def place(node, prefix):
        labels = sorted({k[len(prefix)] for k in values if k.startswith(prefix) and len(k) > len(prefix)})
        final = prefix in values
        base = 1
        while base in bases or any(base ^ c in used for c in [*labels, *([0] if final else [])]):
            base += 1
        bases.add(base)
        units[node] |= (base ^ node) << 10 | final << 8
        used.update(base ^ c for c in labels)
        if final:
            used.add(base)
            units[base] = 1 << 31 | values[prefix]
        for c in labels:
            units[base ^ c] = c
        for c in labels:
            place(base ^ c, prefix + bytes([c]))
    place(0, b"")
    size = (max(units) | 255) + 1
    trie = struct.pack(f"<{size}I", *(units.get(i, 0) for i in range(size)))
    return struct.pack("<I", len(trie)) + trie + texts


MAPPING = {"ﬁ".encode(): b"fi", "Ａ".encode(): b"A", "é".encode(): "é".encode(), "　".encode(): b" ", b"\t": b" ",
           b"ab": b"X", b"abc": b"YZ", b"q": b"", "½".encode(): b"1/2"}


def model_with(charsmap, squeeze, prefix):
    with open(PATH, "rb") as file:
        model = file.read()
    size = len(charsmap)
    varint = b""
    while True:
        varint += bytes([size & 127 | (128 if size > 127 else 0)])
        size >>= 7
        if not size:
            break
    spec = b"\x12" + varint + charsmap + bytes([0x18, prefix, 0x20, squeeze])
    size, varint = len(spec), b""
    while True:
        varint += bytes([size & 127 | (128 if size > 127 else 0)])
        size >>= 7
        if not size:
            break
    return model + b"\x1a" + varint + spec


TEXTS = ["", " ", "   ", "  two  blanks ", "ﬁne Ａbc abc abd ab q", "é½　x\ty", "qqq", "q a q", "日本語 ﬁ", "abcabcab", "▁ x", "a\nb  c"]


@pytest.mark.parametrize("squeeze", [0, 1])
@pytest.mark.parametrize("prefix", [0, 1])
def test_normalisation_equals_the_library(squeeze, prefix):
    model = model_with(double_array(MAPPING), squeeze, prefix)
    ours, library = OffsetCodec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in TEXTS:
        ids, starts, ends = ours.encode(text)
        assert ids == library.encode(text, add_eos=True), text
        assert all(a <= b for a, b in zip(starts, ends))
        assert all(starts[i] >= starts[i - 1] for i in range(1, len(starts)))


def test_longest_prefix_wins():
    found = CharacterMap(double_array(MAPPING))
    assert found.longest(b"abcd", 0) == (3, b"YZ")
    assert found.longest(b"abd", 0) == (2, b"X")
    assert found.longest(b"a", 0) is None


def test_spans_are_the_source_bytes():
    with open(PATH, "rb") as file:
        codec = OffsetCodec(file.read())
    text = "Hello wörld 日本 😀"
    data = text.encode()
    ids, starts, ends = codec.encode(text)
    assert b"".join(data[a:b] for a, b in zip(starts, ends)) == data
    pieces = [codec.library.id_to_piece(i) for i in ids]
    for piece, a, b in zip(pieces, starts, ends):
        if not piece.startswith("<"):
            assert piece.replace("▁", " ").strip() == data[a:b].decode().strip()


def test_query_rows(make_docs, odd_rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = encode_decode_digest(make_docs(odd_rows, extra=True), PATH).collect()
    want = []
    for doc_id, text in odd_rows:
        ids = library.encode(text or "", add_eos=True)
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest(), len((text or "").encode())))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert encode_decode_digest(make_docs([]), PATH).count() == 0


def test_lists(make_docs):
    row = encode_decode(make_docs([(1, "ab cd")]), PATH).first()
    assert len(row.ids) == len(row.span_start) == len(row.span_end) and row.decoded == "ab cd"
