"""Token ids in files of static interleaved rANS blocks (operator 4).

A token file is a folder of two Parquet tables, written and read through Spark
only, so it can lie in any store: ``table`` (the shared frequency table) and
``blocks``. A block holds the ids of whole consecutive documents, coded by
``LANES`` interleaved range asymmetric numeral coders that share the table.
It carries its documents' ids and lengths, the position of its first id among
the ids of all documents, checkpoints (the coder states and the place in the
payload, every ``CHECKPOINT`` ids) from which decoding can start, and checksums
of payload and ids. Blocks don't depend on each other.

Work: one range shuffle of the texts by doc_id; each task tokenises its range
(stored once, as the table counts all ids before any is coded); counts are
summed over all data; each task then codes its own range.

Defined cases: a null or empty text holds only the end id; documents of equal
doc_id lie in the order of a hash of their text; a null doc_id sorts first;
extra columns are not read; an empty table gives files without blocks. A
document is never split over blocks: its ids bound a block's size from below.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .common import Shared, map_rows

LANES = 1024
BLOCK = 1 << 20
CHECKPOINT = 1 << 18
SCALE = 20
LOW = 1 << 31

TOKENS = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()),
                    ("ids", pa.binary())])
COUNTS = pa.schema([("id", pa.int64()), ("n", pa.int64())])
BLOCKS = pa.schema([
    ("start", pa.int64()), ("n_tokens", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("payload", pa.binary()), ("state", pa.binary()),
    ("check_step", pa.list_(pa.int64())), ("check_word", pa.list_(pa.int64())), ("check_state", pa.binary()),
    ("payload_crc32", pa.int64()), ("ids_crc32", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
READ_DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


class FrequencyTable:
    """Counts scaled to a total of 2**SCALE, at least 1 for every id that occurs."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        order = np.argsort(ids)
        self.ids, counts = ids[order].astype(np.uint32), counts[order].astype(np.float64)
        total = 1 << SCALE
        if len(self.ids) > total // 2:
            raise ValueError(f"more than {total // 2} different ids")
        freq = np.maximum(1, np.floor(counts / max(counts.sum(), 1) * (total - len(counts)))).astype(np.int64)
        if len(freq):
            freq[np.argmax(freq)] += total - freq.sum()
        self.freq = freq.astype(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else self.freq
        top = int(self.ids[-1]) + 1 if len(ids) else 0
        self.rank = np.zeros(top, np.uint32)
        self.rank[self.ids] = np.arange(len(self.ids), dtype=np.uint32)

    def slots(self) -> np.ndarray:
        """Rank of the id that owns each slot; only decoders need it."""
        return np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.freq.astype(np.int64))


def encode_block(table: FrequencyTable, ids: np.ndarray):
    """(payload words, first states, checkpoint steps, words, states) of one block."""
    rank = table.rank[ids]
    freq, first = table.freq[rank], table.first[rank]
    limit = freq << np.uint64(63 - SCALE)  # a state from here on would overflow
    steps = -(-len(ids) // LANES)
    state = np.full(LANES, LOW, np.uint64)
    out, words, marks = [], 0, []
    every = max(1, CHECKPOINT // LANES)
    for t in range(steps - 1, -1, -1):
        at = slice(t * LANES, min((t + 1) * LANES, len(ids)))
        f = freq[at]
        x = state[:len(f)]
        full = x >= limit[at]
        if full.any():
            out.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            words += len(out[-1])
            x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[:len(f)] = (q << np.uint64(SCALE)) + (x - q * f) + first[at]
        if t and t % every == 0:
            marks.append((t, words, state.copy()))
    payload = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    marks.reverse()
    saved = np.concatenate([m[2] for m in marks]) if marks else np.zeros(0, np.uint64)
    return payload, state, [m[0] for m in marks], [words - m[1] for m in marks], saved


def decode_block(table: FrequencyTable, slots: np.ndarray, payload: np.ndarray, state: np.ndarray, n: int,
                 step: int = 0, word: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids from ``step`` (at ``word`` of the payload, with the states there) up to id ``stop``."""
    stop = n if stop is None else min(stop, n)
    state = state.copy()
    out = np.empty(max(0, -(-stop // LANES) * LANES - step * LANES), np.uint32)
    mask = np.uint64((1 << SCALE) - 1)
    base = step * LANES
    for t in range(step, -(-stop // LANES)):
        size = min(LANES, n - t * LANES)
        x = state[:size]
        slot = x & mask
        rank = slots[slot]
        out[t * LANES - base:t * LANES - base + size] = rank
        x = table.freq[rank] * (x >> np.uint64(SCALE)) + slot - table.first[rank]
        low = x < LOW
        k = int(np.count_nonzero(low))
        if k:
            x[low] = (x[low] << np.uint64(32)) | payload[word:word + k]
            word += k
        state[:size] = x
    return table.ids[out[:stop - base]]


def _checked_payload(row: dict) -> np.ndarray:
    if zlib.crc32(row["payload"]) != row["payload_crc32"]:
        raise ValueError(f"block at {row['start']}: payload checksum differs")
    return np.frombuffer(row["payload"], "<u4")


def decode_range(table: FrequencyTable, slots: np.ndarray, row: dict, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a block, decoded from the last checkpoint before ``start``."""
    step, word, state = 0, 0, np.frombuffer(row["state"], "<u8")
    for i, t in enumerate(row["check_step"]):
        if t * LANES <= start:
            step, word = t, row["check_word"][i]
            state = np.frombuffer(row["check_state"], "<u8", LANES, i * LANES * 8)
    got = decode_block(table, slots, _checked_payload(row), state.astype(np.uint64), row["n_tokens"], step, word, stop)
    return got[start - step * LANES:]


def tokenize_ranges(docs: DataFrame, json_path: str, ranks_path: str | None, end_id: int, added: bool = False) -> DataFrame:
    """Ids of whole documents in ascending doc_id order: by ``part``, then by ``local_start``."""
    ranged = (docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))
              .repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text"))

    def rows(source):
        encode, part, local = encoder(json_path, ranks_path, added), TaskContext.get().partitionId(), 0
        for doc_id, text in source:
            ids = encode(text or "")
            ids.append(end_id)
            narrow = np.frombuffer(ids, np.uint32)
            yield part, doc_id, local, len(ids), narrow.astype("<u2" if narrow.max() < 65536 else "<u4").tobytes()
            local += len(ids)
    return map_rows(ranged, rows, TOKENS)


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def count_ids(tokens: DataFrame) -> DataFrame:
    """(id, n) over all ids; every task sends each id at most once per 16 Mi ids."""
    def rows(source):
        held, size = [], 0
        for n, data in source:
            held.append(_wide(data, n))
            size += n
            if size >= 1 << 24:
                yield from counted(held)
                held, size = [], 0
        if held:
            yield from counted(held)

    def counted(held):
        counts = np.bincount(np.concatenate(held))
        return ((int(i), int(counts[i])) for i in np.flatnonzero(counts))
    return map_rows(tokens.select("n_tokens", "ids"), rows, COUNTS).groupBy("id").agg(F.sum("n").alias("n"))


def read_counts(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of the stored table; as many rows as the vocabulary has ids at most."""
    rows = spark.read.parquet(f"{path}/table").collect()
    return np.array([r["id"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)


def write_token_files(docs: DataFrame, path: str, json_path: str, ranks_path: str | None, end_id: int, added: bool = False) -> None:
    """Write the token files of ``docs`` (doc_id, text) to folder ``path``."""
    spark = docs.sparkSession
    store = Shared(spark, "rans")
    tokens = store.write(tokenize_ranges(docs, json_path, ranks_path, end_id, added), "tokens")
    count_ids(tokens).write.parquet(f"{path}/table")
    # ids of all documents in earlier ranges, by range: as many numbers as tasks
    base, total = {}, 0
    for part, n in sorted(map(tuple, tokens.groupBy("part").agg(F.sum("n_tokens")).collect())):
        base[part] = total
        total += n
    shared = spark.sparkContext.broadcast((*read_counts(spark, path), base))

    def rows(source):
        ids, counts, bases = shared.value
        table = FrequencyTable(ids, counts)
        held, lengths, doc_ids, size, start = [], [], [], 0, -1

        def pack():
            data = np.concatenate(held).astype("<u4")
            payload, state, steps, words, saved = encode_block(table, data)
            raw = payload.tobytes()
            return (start, len(data), doc_ids, lengths, raw, state.astype("<u8").tobytes(), steps, words,
                    saved.astype("<u8").tobytes(), zlib.crc32(raw), zlib.crc32(data.tobytes()))
        for part, doc_id, local, n, data in source:
            at = bases[part] + local
            if held and (at != start + size or size >= BLOCK):
                yield pack()
                held, lengths, doc_ids, size = [], [], [], 0
            if not held:
                start = at
            held.append(_wide(data, n))
            lengths.append(n)
            doc_ids.append(doc_id)
            size += n
        if held:
            yield pack()
    map_rows(tokens, rows, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    store.drop("tokens")


def _read(spark: SparkSession, path: str, schema: pa.Schema, value) -> DataFrame:
    shared = spark.sparkContext.broadcast(read_counts(spark, path))
    names = BLOCKS.names

    def rows(source):
        table = FrequencyTable(*shared.value)
        slots = table.slots()
        for values in source:
            row = dict(zip(names, values))
            ids = decode_block(table, slots, _checked_payload(row), np.frombuffer(row["state"], "<u8").astype(np.uint64),
                               row["n_tokens"]).astype("<u4")
            if zlib.crc32(ids.tobytes()) != row["ids_crc32"]:
                raise ValueError(f"block at {row['start']}: checksum of ids differs")
            at = 0
            for doc_id, n in zip(row["doc_ids"], row["lengths"]):
                yield doc_id, row["start"] + at, n, value(ids[at:at + n])
                at += n
    return map_rows(spark.read.parquet(f"{path}/blocks").select(*names), rows, schema, slice_rows=8)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids as little-endian unsigned 32-bit integers) of every document in the files."""
    return _read(spark, path, READ, lambda ids: ids.tobytes())


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_token_files``, with the crc32 of the ids instead of the ids."""
    return _read(spark, path, READ_DIGEST, lambda ids: zlib.crc32(ids.tobytes()))
