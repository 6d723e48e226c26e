"""Hard negatives by an inverted multi-index (operator 12).

Every vector is split into two halves, and each half is put to the nearest
word of that half's codebook; the two words form the cell of the vector. The
table is dealt into slices of about ``VALUES`` components; a slice stores its
vectors cell by cell, with the greatest distance of its members to each word.
A word's half-score bound for an anchor is the inner product of the anchor's
half with the word plus the half's length times that radius, and a cell's
bound is the sum of two of them. A heap walks the cells of a slice in order of
their bounds (multi-sequence), scoring members exactly, and stops as soon as
the next bound certifies that nothing better is left:

* positives: the k best rows of the anchor's label are known and the k-th
  score is over the next bound;
* negatives: each positive has a window of scores, from ``low`` to ``high``
  percent of its own; a window is settled if the next bound is under its lower
  end, or if it holds enough rows and the last of them is over the next bound.

Slices are searched one by one and merged by a ranked window, so the result is
exact (recall 1). Anchors meet the slices in blocks (``blocks.meet``). The
codebooks are fitted on at most ``sample`` rows; every row is indexed. They only
decide how soon a walk may stop, never what it finds.

Defined cases: rows with a null vec_id or label, a null vector, or a null or
non-finite component take no part; shorter vectors count as padded with zeros;
rows of the anchor's own vec_id are neither its positives nor its negatives;
equal scores go by the smaller vec_id; repeated rows are candidates of their
own, but one anchor; an anchor without a positive, or a positive without a
negative in its window, has no row; extra columns are not read; an empty table
gives an empty table. Scores are exact while they fit in a long; beyond it they
saturate, and windows are those of the saturated scores.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import meet, padded, read_matrix, stored, usable, whole_matrix
from .common import Shared, map_rows

#: Components of a slice's vectors and anchors of a block, about; words of a half's codebook.
VALUES, ANCHORS, WORDS = 1 << 20, 512, 16
#: Rows scored before the next look at the bound.
AT_ONCE = 1024
#: Rows that the codebooks are fitted on, at most, and rounds of fitting.
SAMPLE, ROUNDS = 4096, 8

BLOCK = [("ids", pa.binary()), ("labels", pa.binary()), ("dims", pa.int32()), ("kind", pa.string()), ("values", pa.binary())]
SLICE = pa.schema([("slice", pa.int64()), *BLOCK, ("cells", pa.binary()), ("radii", pa.binary())])
ASKED = pa.schema([("query_group", pa.int64()), ("tags", pa.binary()), *BLOCK])
WINDOWED = pa.schema([*ASKED, ("wanted", pa.list_(pa.list_(pa.int64())))])
POSITIVE = pa.schema([("anchor_id", pa.int64()), ("tag", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
NEGATIVE = pa.schema([("anchor_id", pa.int64()), ("tag", pa.int64()), ("positive_score", pa.int64()),
                      ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def codebook(points: np.ndarray, words: int, rounds: int) -> np.ndarray:
    """Words (rows) fitted to points by Lloyd's rounds, from points spread over the input's order."""
    found = points[np.linspace(0, len(points) - 1, min(words, len(points))).astype(int)] if len(points) else np.zeros((1, points.shape[1]))
    for _ in range(rounds):
        nearest = nearest_words(points, found)
        for w in range(len(found)):
            mine = points[nearest == w]
            if len(mine):
                found[w] = mine.mean(0)
    return found


def nearest_words(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(1)[None, :] - 2 * points @ words.T).argmin(1) if len(points) else np.zeros(0, int)


class Codebooks:
    """Two codebooks: over the first half of the dimensions, and over the rest."""

    def __init__(self, vectors: np.ndarray, words: int = WORDS, rounds: int = ROUNDS):
        self.half = vectors.shape[1] // 2
        self.words = [codebook(x, words, rounds) for x in self.halves(vectors)]

    def halves(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [vectors[:, :self.half], vectors[:, self.half:]]

    def index(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of every vector (a row), and per half the greatest distance to each word."""
        places, radii = [], []
        for part, words in zip(self.halves(vectors), self.words):
            near = nearest_words(part, words)
            radius = np.zeros(len(words))
            np.maximum.at(radius, near, np.sqrt(((part - words[near]) ** 2).sum(1)))
            places.append(near)
            radii.append(radius)
        return places[0] * len(self.words[1]) + places[1], np.concatenate(radii)

    def bounds(self, anchors: np.ndarray, radii: np.ndarray) -> list[np.ndarray]:
        """Per half, anchors by words: the greatest half-score that a member of the word can have."""
        split = np.split(radii, [len(self.words[0])])
        return [q @ w.T + np.sqrt((q**2).sum(1))[:, None] * r[None, :] for q, w, r in zip(self.halves(anchors), self.words, split)]


def walk(first: np.ndarray, second: np.ndarray):
    """(bound, cell) of all cells, the greatest bound first: a heap over two ordered lists of words."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap = [(-(first[a[0]] + second[b[0]]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(a[i]) * len(b) + int(b[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (-(first[a[i]] + second[b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(first[a[i + 1]] + second[b[0]]), i + 1, 0))


class Slice:
    """Vectors of a slice, cell by cell, and the walk over them."""

    def __init__(self, books: Codebooks, ids, labels, vectors, cells, radii):
        self.books, self.ids, self.labels, self.vectors, self.radii = books, ids, labels, vectors, radii
        n = len(books.words[0]) * len(books.words[1])
        self.starts = np.searchsorted(cells, np.arange(n + 1))
        # a double holds sums of products exactly under 2^53; beyond it, whole numbers of any size
        self.top = float(np.abs(vectors).max(initial=0)) * max(vectors.shape[1], 1)

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.top * float(np.abs(anchor).max(initial=0)) < 2.0**53:
            return (self.vectors[rows] @ anchor).astype(np.int64)
        q = [int(x) for x in anchor]
        return np.array([sum(a * int(b) for a, b in zip(q, self.vectors[r])) for r in rows], object)

    def visit(self, anchor: np.ndarray, first: np.ndarray, second: np.ndarray):
        """(rows, scores, bound): members of the next cells, and the most that any row after them can score."""
        held, n = [], 0
        for bound, cell in walk(first, second):
            a, b = self.starts[cell], self.starts[cell + 1]
            if a == b:
                continue
            if n >= AT_ONCE:
                rows = np.concatenate(held)
                # half a unit and a share cover the rounding of the bound; scores are whole numbers
                yield rows, self.scores(anchor, rows), bound + 1e-9 * abs(bound) + 0.5
                held, n = [], 0
            held.append(np.arange(a, b))
            n += b - a
        if held:
            rows = np.concatenate(held)
            yield rows, self.scores(anchor, rows), float("-inf")

    def best_of_label(self, anchor_id: int, label: int, anchor: np.ndarray, first, second, k: int) -> list[tuple[int, int]]:
        """(-score, id) of the k best other rows of the label."""
        best: list[tuple[int, int]] = []
        for rows, scores, bound in self.visit(anchor, first, second):
            mine = (self.labels[rows] == label) & (self.ids[rows] != anchor_id)
            if len(best) == k:
                mine &= scores >= -best[-1][0]
            best = sorted(best + [(-int(s), int(i)) for s, i in zip(scores[mine], self.ids[rows[mine]])])[:k]
            if len(best) == k and -best[-1][0] > bound:
                break
        return best

    def best_in_windows(self, anchor_id: int, label: int, anchor: np.ndarray, first, second, windows: dict, k: int) -> dict:
        """Per window, (-score, id) of the k best rows of other labels from its low to its high end."""
        found = {w: [] for w in windows}
        left = {w: x for w, x in windows.items() if x[0] <= x[1]}
        steps = self.visit(anchor, first, second) if left else ()
        for rows, scores, bound in steps:
            low, high = min(x[0] for x in left.values()), max(x[1] for x in left.values())
            mine = (scores >= low) & (scores <= high) & (self.labels[rows] != label) & (self.ids[rows] != anchor_id)
            here, ids = scores[mine], self.ids[rows[mine]]
            for w, (low, high) in list(left.items()):
                fits = (here >= low) & (here <= high)
                if len(found[w]) == k:
                    fits &= here >= -found[w][-1][0]
                found[w] = sorted(found[w] + [(-int(s), int(i)) for s, i in zip(here[fits], ids[fits])])[:k]
                if bound < low or len(found[w]) == k and -found[w][-1][0] > bound:
                    del left[w]
            if not left:
                break
        return found


def _long(x: int) -> int:
    return min((1 << 63) - 1, max(-(1 << 63), x))


def _rows_of(dims: int, dim: int, kind: str, values: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(padded(read_matrix(dim, kind, values, n), dims).T)


def fitted_codebooks(rows: DataFrame, n: int, scale: float, dims: int, words: int, sample: int) -> Codebooks:
    """Codebooks of at most ``sample`` rows, chosen by hash; rows that repeat a vec_id and its vector count once.

    A share of hashes that about four times as many rows have is picked before
    anything is shuffled.
    """
    part = min(1 << 30, (4 * sample << 30) // max(n, 1))
    picked = rows.select("v", F.xxhash64("v", "vec_id").alias("h")).where(F.pmod("h", F.lit(1 << 30)) < part)
    chosen = picked.dropDuplicates(["h"]).orderBy("h").limit(sample).collect()
    return Codebooks(padded(whole_matrix([r["v"] for r in chosen], scale), dims).T.copy(), words)


def slices_of(rows: DataFrame, n: int, books: Codebooks, dims: int, scale: float) -> DataFrame:
    """One indexed slice per task, rows dealt out evenly."""
    def index(source):
        from pyspark import TaskContext

        held = list(source)
        if not held:
            return
        vectors = padded(whole_matrix([r[2] for r in held], scale), dims).T
        cells, radii = books.index(vectors)
        order = np.argsort(cells, kind="stable")
        yield (TaskContext.get().partitionId(), np.array([r[0] for r in held], "<i8")[order].tobytes(),
               np.array([r[1] for r in held], "<i8")[order].tobytes(), *stored(vectors[order].T), cells[order].astype("<i4").tobytes(), radii.tobytes())
    return map_rows(rows.select("vec_id", "label", "v").repartition(n), index, SLICE)


def anchor_blocks(anchors: DataFrame, scale: float, windows: bool) -> DataFrame:
    """Blocks of anchors (vec_id, label, v, tag, query_group[, wanted]) of one group."""
    def pack(source):
        held: dict[int, list] = {}
        for row in source:
            held.setdefault(row[4], []).append(row)
        for group, rows in held.items():
            found = (group, np.array([r[3] for r in rows], "<i8").tobytes(), np.array([r[0] for r in rows], "<i8").tobytes(),
                     np.array([r[1] for r in rows], "<i8").tobytes(), *stored(whole_matrix([r[2] for r in rows], scale)))
            yield (*found, [r[5] for r in rows]) if windows else found
    names = ["vec_id", "label", "v", "tag", "query_group"] + (["wanted"] if windows else [])
    return map_rows(anchors.select(names), pack, WINDOWED if windows else ASKED)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   scale: float = 256.0, label: Column | None = None, sample: int = SAMPLE, words: int = WORDS,
                   values_per_slice: int = VALUES, anchors_per_block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors``: vec_id, embedding, label. A negative's score lies between
    ``low`` and ``high`` percent of the positive's; ``label`` replaces the
    column of that name.
    """
    store = Shared(vectors.sparkSession, "hard-negatives")
    label = F.col("label") if label is None else label
    rows = store.write(
        vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding"))
        .select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
                F.col("embedding").cast("array<double>").alias("v"), is_anchor.alias("asked"))
        .withColumn("tag", F.xxhash64("vec_id", "label", "v")), "rows")
    found = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.count(F.when(F.col("asked"), 1)).alias("asked")).first()
    dims, groups = found["dims"] or 0, max(1, -(-found["asked"] // anchors_per_block))
    books = fitted_codebooks(rows, found["n"], scale, dims, words, sample)
    slices = store.write(slices_of(rows, max(1, -(-found["n"] * max(dims, 1) // values_per_slice)), books, dims, scale), "slices")
    asked = (rows.where("asked").dropDuplicates(["vec_id", "label", "v"])
             .withColumn("query_group", F.pmod(F.col("tag"), F.lit(groups)).cast("long")))
    blocks = store.write(anchor_blocks(asked.repartition(groups, "query_group"), scale, False), "anchors")

    def pairs(source):
        """(slice, anchors, their half-score bounds, the other columns of the block) of every meeting."""
        for ids, labels, dim, kind, values, cells, radii, *block in source:
            tags, q_ids, q_labels = (np.frombuffer(x, "<i8") for x in block[:3])
            ids, labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
            here = Slice(books, ids, labels, _rows_of(dims, dim, kind, values, len(ids)), np.frombuffer(cells, "<i4"), np.frombuffer(radii, "<f8"))
            anchors = _rows_of(dims, *block[3:6], len(q_ids))
            bounds = here.books.bounds(anchors, here.radii)
            for j in range(len(q_ids)):
                yield here, int(tags[j]), (int(q_ids[j]), int(q_labels[j]), anchors[j], bounds[0][j], bounds[1][j]), block[6][j] if len(block) > 6 else None

    def search_positives(source):
        for here, tag, anchor, _ in pairs(source):
            for score, vec_id in here.best_of_label(*anchor, positives):
                yield anchor[0], tag, vec_id, _long(-score)

    def search_negatives(source):
        for here, tag, anchor, scores in pairs(source):
            windows = {p: (-(-low * p // 100), high * p // 100) for p in scores}
            for p, best in here.best_in_windows(*anchor, windows, negatives).items():
                for score, vec_id in best:
                    yield anchor[0], tag, p, vec_id, _long(-score)

    per_anchor = Window.partitionBy("anchor_id", "tag").orderBy(F.desc("positive_score"), "positive_id")
    chosen = store.write(meet(blocks, slices, search_positives, POSITIVE).withColumn("place", F.row_number().over(per_anchor))
                         .where(F.col("place") <= positives), "positives")
    wanted = chosen.groupBy(F.col("anchor_id").alias("vec_id"), "tag").agg(F.collect_set("positive_score").alias("wanted"))
    windowed = asked.join(wanted, ["vec_id", "tag"]).repartition(groups, "query_group")
    again = store.write(anchor_blocks(windowed, scale, True), "windows")
    per_window = Window.partitionBy("anchor_id", "tag", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    mined = store.write(meet(again, slices, search_negatives, NEGATIVE).withColumn("rank", F.row_number().over(per_window))
                        .where(F.col("rank") <= negatives), "negatives")
    store.drop("rows", "slices", "anchors", "windows")
    return (chosen.join(mined, ["anchor_id", "tag", "positive_score"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def mine_noisy_labels(vectors: DataFrame) -> DataFrame:
    """``hard_negatives`` of anchors divisible by 50, where every seventh label is moved on by one of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0, label=moved)
