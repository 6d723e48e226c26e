"""Offset-preserving SentencePiece encoding and decoding (operator 1).

Normalisation is done here: a longest-prefix match through the model's compiled
character map (a double-array trie) rewrites the text and records, for every
byte of the normalised text, the byte of the source it came from. The library
then segments the normalised text with an identity normaliser, and every piece
is projected to a byte span of the source through that alignment.

Defined cases: a null or empty text gives no piece but the end id and decodes
to the empty text; rows are independent, so ties, repeated rows and extra
columns have no effect; an empty table gives an empty table; the length of a
text is bounded only by one worker's memory.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, per_worker

SPACE = "▁".encode()

ENCODED = pa.schema([
    ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("span_start", pa.list_(pa.int64())),
    ("span_end", pa.list_(pa.int64())), ("decoded", pa.string())])
DIGEST = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
    ("decoded_sha256", pa.string()), ("span_bytes", pa.int64())])


def _varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of a protobuf message; fixed-width values come as bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at:at + size], at + size
        yield tag >> 3, value


class CharacterMap:
    """The compiled character map: UTF-8 prefixes to replacements, longest prefix first."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.texts = blob[4 + size:]
        # first bytes that lead anywhere: the others are copied without a walk
        starts = bytes(b for b in range(256) if self._step(0, b) is not None)
        self.candidates = re.compile(b"[" + re.escape(starts) + b"]") if starts else None

    def _step(self, node: int, byte: int):
        child = node ^ self._offset(self.units[node]) ^ byte
        if child >= len(self.units) or self.units[child] & 0x800000FF != byte:
            return None
        return child

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that starts at ``at``."""
        node, best = 0, None
        for end in range(at, len(data)):
            node = self._step(node, data[end])
            if node is None:
                break
            if self.units[node] >> 8 & 1:
                best = end + 1 - at, self.units[node ^ self._offset(self.units[node])] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.texts[best[1]:self.texts.index(b"\0", best[1])]


class Normalizer:
    """Model normalisation with source alignment."""

    def __init__(self, charsmap: bytes, dummy_prefix: bool, squeeze: bool, escape: bool, suffix: bool, fixed: list[bytes]):
        self.map = CharacterMap(charsmap) if charsmap else None
        self.dummy_prefix, self.squeeze, self.escape, self.suffix = dummy_prefix, squeeze, escape, suffix
        # user-defined symbols are copied as they are, the longest first
        self.fixed = re.compile(b"|".join(map(re.escape, sorted(fixed, key=len, reverse=True)))) if fixed else None

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Text after the character map, and the source byte of each of its bytes."""
        if self.map is None or self.map.candidates is None:
            return data, np.arange(len(data), dtype=np.int64)
        out, source, done, at = [], [], 0, 0
        while found := self.map.candidates.search(data, at):
            at = found.start()
            if data[at] & 0xC0 == 0x80:  # inside a character
                at += 1
                continue
            if self.fixed and (kept := self.fixed.match(data, at)):
                at = kept.end()
                continue
            hit = self.map.longest(data, at)
            if hit is None:
                at += 1
                continue
            out += [data[done:at], hit[1]]
            source += [np.arange(done, at), np.full(len(hit[1]), at)]
            done = at = at + hit[0]
        out.append(data[done:])
        source.append(np.arange(done, len(data)))
        return b"".join(out), np.concatenate(source).astype(np.int64)

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised text and, for each of its byte positions and its end, the source position."""
        text, source = self._mapped(data)
        raw = np.frombuffer(text, np.uint8)
        blank = raw == 32
        end = len(data)
        if self.squeeze and blank.any():
            keep = ~blank | ~np.concatenate([[True], blank[:-1]])
            last = np.flatnonzero(~blank)[-1] if not blank.all() else -1
            if last + 1 < len(raw):
                end = int(source[last + 1])
            keep[last + 1:] = False
            raw, source, blank = raw[keep], source[keep], blank[keep]
        if not len(raw) and (self.squeeze or not data):
            return b"", np.array([end], np.int64)
        if self.escape:
            text = raw.tobytes().replace(b" ", SPACE)
            source = np.repeat(source, np.where(blank, 3, 1))
        else:
            text = raw.tobytes()
        mark = SPACE if self.escape else b" "
        if self.dummy_prefix and self.suffix:
            text, source = text + mark, np.concatenate([source, np.full(len(mark), end)])
        elif self.dummy_prefix:
            text, source = mark + text, np.concatenate([np.full(len(mark), source[0] if len(source) else 0), source])
        return text, np.append(source, end)


class OffsetCodec:
    """Encoder with byte spans, and decoder, of one SentencePiece model."""

    def __init__(self, model: bytes):
        import sentencepiece

        pieces, norm, trainer = [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append((piece.get(1, b""), piece.get(3, 1)))
            elif number == 2:
                trainer.update(_fields(value))
            elif number == 3:
                norm.update(_fields(value))
        # kinds: 1 normal, 2 unknown, 3 control, 4 user-defined, 6 one byte
        self.width = np.array([{2: -1, 3: 0, 6: 1}.get(kind, len(text)) for text, kind in pieces], np.int64)
        self.normalize = Normalizer(norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1)),
                                    bool(trainer.get(24, 0)), [text for text, kind in pieces if kind == 4])
        # a later copy of the normaliser field overrides the first: no map, no prefix, no white-space handling
        identity = b"\x0a\x08identity\x12\x00\x18\x00\x20\x00\x28\x00"
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=model + b"\x1a" + bytes([len(identity)]) + identity)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.end_id = self.library.eos_id()

    def encode(self, text: str, end: bool = True) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids, and the byte span of the source of each id; the end id has an empty span at the end."""
        data = text.encode()
        normal, source = self.normalize(data)
        ids = self.segmenter.encode(normal.decode()) if normal else []
        width = self.width[ids] if ids else np.zeros(0, np.int64)
        if (width < 0).any():  # unknown pieces: as long as their surfaces
            width = np.array([1 if self.width[i] == 1 and s.startswith("<0x") else len(s.encode())
                              for i, s in zip(ids, self.segmenter.encode(normal.decode(), out_type=str))], np.int64)
        cut = source[np.concatenate([[0], np.cumsum(width)])]
        starts, ends = cut[:-1], cut[1:]
        if end:
            ids = [*ids, self.end_id]
            starts, ends = np.append(starts, len(data)), np.append(ends, len(data))
        return ids, starts, ends

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def codec(path: str) -> OffsetCodec:
    def build():
        with open(path, "rb") as file:
            return OffsetCodec(file.read())
    return per_worker(("sentencepiece", path), build)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, span_start, span_end, decoded) of every whole text; ``path``: the model on every node."""
    def rows(source):
        coder = codec(path)
        for doc_id, text in source:
            ids, starts, ends = coder.encode(text or "")
            yield doc_id, ids, starts.tolist(), ends.tolist(), coder.decode(ids)
    return map_rows(docs.select("doc_id", "text"), rows, ENCODED)


def encode_decode_digest(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode_decode``, with counts and digests instead of the lists.

    ``span_bytes``: source bytes that the spans cover together.
    """
    def rows(source):
        coder = codec(path)
        number = per_worker("decimal-ids", lambda: [str(i) for i in range(1 << 16)])
        for doc_id, text in source:
            ids, starts, ends = coder.encode(text or "")
            shown = " ".join([number[i] if i < 65536 else str(i) for i in ids])
            yield (doc_id, len(ids), hashlib.sha256(shown.encode()).hexdigest(),
                   hashlib.sha256(coder.decode(ids).encode()).hexdigest(), int((ends - starts).sum()))
    return map_rows(docs.select("doc_id", "text"), rows, DIGEST)
