"""Fill-in-the-middle transformation (operator 11).

A text is cut at two unit boundaries, a unit being a word with the blanks
before it, or the blanks that end the text. The text is divided into blocks of
a fixed number of bytes; a Fenwick tree over the blocks holds how many units
end and how many code points start in each. A binary-lifting descent finds the
block where the wanted unit ends, adding up both counts on its way down; the
boundary itself is then located inside that block. Blanks are ASCII, so all of
it runs on the UTF-8 bytes and no text is decoded.

Cuts and form are fixed by ``sha256(seed:doc_id)``, so reruns agree and no row
depends on another. The original text is rebuilt from the output and its form
by ``restored_text`` (JVM expressions): a marker never stands in a text that is
transformed, and none can arise where a piece and a marker meet, since markers
begin with ``<`` and hold no other one.

Defined cases: a null text is an empty one, and an empty text is plain; a text
that holds a marker is plain; a null doc_id is hashed as no digits (``seed:``);
repeated rows and rows of one doc_id get the same numbers; extra columns are
not read; an empty table gives an empty table; a text of any length is cut,
its masks being made for ``CHUNK`` bytes at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Bytes of a block, and bytes whose masks are in memory at a time (a multiple of the first).
BLOCK, CHUNK = 512, 1 << 20
#: Marks of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")

CUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                 ("middle_chars", pa.int64()), ("output", pa.binary())])


def unit_ends(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Where a unit's last byte is among bytes start to stop: at a word's last byte, and at the text's."""
    part = data[start:min(stop + 1, len(data))]
    blank = (part == 32) | (part - np.uint8(9) <= 4)
    ends = ~blank[:stop - start]
    ends[:len(blank) - 1] &= blank[1:stop - start + 1]
    if stop == len(data):
        ends[-1] = True
    return ends


class BlockTree:
    """Fenwick tree over blocks of a text: units that end and code points that start in them."""

    def __init__(self, data: bytes, block: int = BLOCK, chunk: int = CHUNK):
        self.data, self.block = np.frombuffer(data, np.uint8), block
        n = -(-len(data) // block)
        self.sums = np.zeros((n + 1, 2), np.int64)
        for at in range(0, len(data), chunk):
            stop = min(at + chunk, len(data))
            first = np.arange(0, stop - at, block)
            here = self.sums[1 + at // block:1 + at // block + len(first)]
            here[:, 0] = np.add.reduceat(unit_ends(self.data, at, stop), first, dtype=np.int64)
            here[:, 1] = np.add.reduceat((self.data[at:stop] & 0xC0) != 0x80, first, dtype=np.int64)
        self.units, self.chars = (int(x) for x in self.sums.sum(0))
        # node i holds the sums of the blocks from i - lowbit(i) on, up to its own
        step = 1
        while step <= n:
            self.sums[2 * step::2 * step] += self.sums[step:n + 1 - step:2 * step][:len(self.sums[2 * step::2 * step])]
            step *= 2

    def locate(self, units: int) -> tuple[int, int]:
        """(byte, code point) after the first ``units`` units."""
        if units <= 0:
            return 0, 0
        n, at, left, chars = len(self.sums) - 1, 0, units, 0
        step = 1 << n.bit_length()
        while step:
            if at + step <= n and self.sums[at + step, 0] < left:
                at += step
                left -= int(self.sums[at, 0])
                chars += int(self.sums[at, 1])
            step >>= 1
        start = at * self.block
        stop = min(start + self.block, len(self.data))
        place = start + int(np.flatnonzero(unit_ends(self.data, start, stop))[left - 1]) + 1
        return place, chars + int(np.count_nonzero((self.data[start:place] & 0xC0) != 0x80))


def draws(seed: int, doc_id: int | None) -> list[int]:
    """The first four 32-bit numbers of the document's hash."""
    import hashlib

    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def transform(data: bytes, numbers: list[int], percent: int, spm_percent: int, markers: tuple[str, str, str]):
    """(n, form, prefix_chars, middle_chars, output) of a text's bytes."""
    tree = BlockTree(data)
    p, s, m = (x.encode() for x in markers)
    if not data or numbers[2] % 100 >= percent or any(x in data for x in (p, s, m)):
        return tree.units, "plain", None, None, data
    low, high = sorted(x % (tree.units + 1) for x in numbers[:2])
    (a, a_chars), (b, b_chars) = tree.locate(low), tree.locate(high)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if numbers[3] % 100 < spm_percent:
        form, output = "spm", (s, suffix, p, prefix, m, middle)
    else:
        form, output = "psm", (p, prefix, s, suffix, m, middle)
    return tree.units, form, a_chars, b_chars - a_chars, b"".join(output)


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80,
                   markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document.

    ``percent`` of the documents are transformed, ``spm_percent`` of those with
    the suffix first. ``markers`` are those of prefix, suffix and middle; each
    begins with a character that stands nowhere else in any of them.
    """
    if any(x[0] in y[1:] for x in markers for y in markers) or len(set(markers)) < 3:
        raise ValueError("markers must differ, and their first character may stand at their beginning only")

    def rows(source):
        for doc_id, data in source:
            yield doc_id, *transform(data, draws(seed, doc_id), percent, spm_percent, markers)
    texts = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    return map_rows(texts, rows, CUT, slice_rows=64).withColumn("output", F.col("output").cast("string"))


def restored_text(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The original text, rebuilt from an output and its form."""
    p, s, m = (F.lit(x) for x in markers)

    def between(first: Column, last: Column) -> Column:
        return F.split_part(F.split_part(output, first, F.lit(2)), last, F.lit(1))
    middle = F.split_part(output, m, F.lit(2))
    return (F.when(form == "psm", F.concat(between(p, s), middle, between(s, m)))
            .when(form == "spm", F.concat(between(p, m), middle, between(s, p)))
            .otherwise(output))


def fill_in_middle_digest(docs: DataFrame) -> DataFrame:
    """The columns of ``fill_in_middle`` with sha256 of the output and of the text rebuilt from it."""
    cut = fill_in_middle(docs)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored_text(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
