"""Best-fit-decreasing packing of documents into sequences (operator 7).

Documents are placed in order of falling length, each into the open sequence
with the least room that still holds it; a segment tree over the remaining
capacities finds that room in logarithmic time. Since a sequence is told apart
only by its room, documents of one length are placed as a run: the tree works
on counts of sequences per room, and a run fills all sequences of one room
before it moves to the next, exactly as one document after another would. The
plan is the same as that of a sequential best-fit-decreasing over all
documents, at any size of the table, and has a bounded number of rows: it is
made from a histogram of at most ``capacity`` lengths.

Work: every task tokenises its documents, cuts the long ones and numbers its
pieces within their length; the histogram is summed over all data; a window
over (length, task) counts places the numbering of each task in the global
one; each piece then looks its sequence up in the plan. No text or id is
shuffled.

Defined cases: a null or empty text is one piece with the end id; equal
lengths are placed in the order of the tasks that read them; repeated rows and
repeated or null doc_ids are packed like any other row; extra columns are not
read; an empty table gives an empty table. Only documents over ``capacity`` are
cut, into pieces of ``capacity`` after a first one that may be shorter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder
from .common import Shared, map_rows

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("task", pa.int32()), ("rank", pa.int64())])


class Capacities:
    """Segment tree over rooms 0..capacity; a leaf counts the open sequences with that room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.tree[at] += n
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that an open sequence has."""
        at = least + self.size
        if self.tree[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def pack_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, documents per sequence, first sequence, offset).

    Documents of ``length`` from rank ``first rank`` on (up to the next row of
    that length) go to the sequences from ``first sequence`` on, the given
    number to each, the first at ``offset``.
    """
    tree, ranges, plan, opened = Capacities(capacity), {}, [], 0

    def open_range(room: int, first: int, n: int) -> None:
        if n and room:
            ranges.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, n = opened, -(-left // each)
                opened += n
            else:
                each = room // length
                first, n = ranges[room].pop()
                tree.add(room, -n)
            used = min(n, left // each)
            placed = used * each
            open_range(room - each * length, first, used)
            spare = first + used
            if used < n and left > placed:  # the last sequence of the run is filled in part
                open_range(room - (left - placed) * length, spare, 1)
                placed, spare = left, spare + 1
            open_range(room, spare, first + n - spare)
            plan.append((length, rank, each, first, capacity - room))
            rank, left = rank + placed, left - placed
    return plan


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(i, capacity) for i in range(head, n, capacity)]


def token_pieces(docs: DataFrame, json_path: str, ranks_path: str | None, end_id: int, capacity: int, added: bool = False) -> DataFrame:
    """Pieces of all documents, numbered within (task, length)."""
    def rows(source):
        encode, task = encoder(json_path, ranks_path, added), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for doc_id, text in source:
            ids = encode(text or "")
            ids.append(end_id)
            data = memoryview(np.frombuffer(ids, np.uint32).astype("<u4"))
            for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                yield doc_id, piece, start, length, zlib.crc32(data[start:start + length]), task, seen[length]
                seen[length] += 1
    return map_rows(docs.select("doc_id", "text"), rows, PIECES)


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str | None, end_id: int, capacity: int = 1024, added: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    spark = docs.sparkSession
    pieces = Shared(spark, "packing").write(token_pieces(docs, json_path, ranks_path, end_id, capacity, added), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    # at most `capacity` rows, whatever the input
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = np.array(pack_runs(histogram, capacity), np.int64).reshape(-1, 5)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"))
    numbered = (pieces.join(base, ["length", "task"])
                .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank")))
    shared = spark.sparkContext.broadcast(plan)

    def place(length, rank):
        import pandas as pd

        rows = shared.value
        # one sorted key: plan rows of a length, then the first rank of the row
        low = np.searchsorted(rows[:, 0], length.to_numpy(), "left")
        high = np.searchsorted(rows[:, 0], length.to_numpy(), "right")
        want = rank.to_numpy()
        while (open_ := high - low > 1).any():  # halve the rows that may hold the rank
            middle = (low + high) // 2
            right = open_ & (rows[np.minimum(middle, len(rows) - 1), 1] <= want)
            low, high = np.where(right, middle, low), np.where(open_ & ~right, middle, high)
        row = rows[low]
        index = want - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + index // row[:, 2],
                             "offset": row[:, 4] + index % row[:, 2] * row[:, 0]})

    schema = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = F.pandas_udf(place, schema)(F.col("length"), F.col("rank"))
    return (numbered.withColumn("at", at)
            .select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset"))
