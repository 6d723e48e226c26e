"""Quality classifier by compression (operator 9).

Two zstandard dictionaries are built, one from good and one from bad labelled
texts. A text is cut into short chunks, every chunk is compressed with both
dictionaries, and the difference of the two totals over the larger of them is
the raw score. A logistic calibrator, fitted on other labelled texts than those
in the dictionaries, turns it (with the compressed sizes per byte and the
length, on which its scale depends) into the probability that the text is good.

The dictionaries and the calibrator are fitted on a bounded sample: at most
``per_class`` texts of either class, each of at most ``max_bytes`` bytes.

Defined cases: a null text scores as an empty one; an empty text is one empty
chunk; without labels of both classes every score is the share of good labels
(0.5 with no labels); a text of any length is compressed whole, chunk by chunk;
rows are independent, so ties, repeated rows and extra columns change nothing;
an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import held_out, map_rows, per_worker
from .labelled import Logistic, class_counts, labelled_sample

CHUNK = 1024
SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def chunks(data: bytes):
    return [data[i:i + CHUNK] for i in range(0, max(len(data), 1), CHUNK)]


def dictionary(texts: list[bytes], size: int) -> bytes:
    """Trained dictionary; the texts themselves where they are too few to train on."""
    import zstandard

    samples = [c for t in texts for c in chunks(t) if len(c) >= 8]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:] or b"\0" * 8


def compressor(data: bytes, level: int):
    import zstandard

    book = zstandard.ZstdCompressionDict(data)
    book.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=book, write_content_size=False, write_checksum=False, write_dict_id=False)


def features(text: str, good, bad) -> list[float]:
    """Normalised size difference first, then what its scale depends on."""
    data = text.encode()
    a = b = 0
    for chunk in chunks(data):
        a += len(good.compress(chunk))
        b += len(bad.compress(chunk))
    n = max(len(data), 1)
    diff, ratio, length = (a - b) / max(a, b), a / n, math.log(n)
    return [diff, diff * diff, ratio, ratio * ratio, math.log(ratio), math.log(b / n), length, diff * length, diff * math.log(ratio)]


def fit(docs: DataFrame, labels: DataFrame, train, per_class: int, max_bytes: int, size: int, level: int):
    """(dictionaries, calibrator) from the sample, or (None, share of good labels)."""
    counts = class_counts(labels, "quality", train)
    rows = labelled_sample(docs, labels, "quality", train, per_class, max_bytes).collect()
    texts: list[dict[str, int]] = [{}, {}]
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        texts[r["label"]].setdefault(r["text"], r["doc_id"])
    if min(len(t) for t in texts) < 2:
        return None, counts[1] / sum(counts) if sum(counts) else 0.5
    half = [[t for i, t in enumerate(texts[v]) if i % 2 == k] for k in (0, 1) for v in (0, 1)]
    books = [dictionary([t.encode() for t in half[v]], size) for v in (0, 1)]
    bad, good = (compressor(b, level) for b in books)
    x = np.array([features(t, good, bad) for v in (0, 1) for t in half[2 + v]])
    y = np.repeat([0.0, 1.0], [len(half[2]), len(half[3])])
    # the classes count as in the labels, not as in the sample
    weight = np.where(y == 1, counts[1] / len(half[3]), counts[0] / len(half[2]))
    return books, Logistic(x, y, weight * len(y) / weight.sum(), ridge=0.01)


def score_quality(docs: DataFrame, labels: DataFrame, *, modulus: int = 5, remainder: int = 0, threshold: float = 0.3,
                  per_class: int = 3000, max_bytes: int = 32 << 10, dictionary_bytes: int = 64 << 10, level: int = 3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    Labels are learned only from rows whose crc32 of doc_id mod ``modulus``
    isn't ``remainder``.
    """
    books, model = fit(docs, labels, lambda c: ~held_out(c, modulus, remainder), per_class, max_bytes, dictionary_bytes, level)

    def rows(source):
        pair = None if books is None else per_worker(("zstd", hash(books[0]), hash(books[1]), level),
                                                     lambda: [compressor(b, level) for b in books])
        for doc_id, apart, text in source:
            score = model if pair is None else float(model(np.array([features(text or "", pair[1], pair[0])]))[0])
            yield doc_id, apart, score, int(score >= threshold)
    return map_rows(docs.select("doc_id", held_out(docs["doc_id"], modulus, remainder).alias("apart"), "text"), rows, SCORED)
