"""K-d tree sharding by bytes (operator 6). DataFrame functions only.

All documents are split at weighted medians, the weight being the bytes, along
the widest metadata dimension of each cell, until there is one cell per shard.
A median is found by summed histograms that zoom in on the cell's key range:
every round sends ``BINS`` numbers per cell to the driver, whatever the input.
The cuts are then expressions over a row's own metadata, so assigning a row to
its shard needs no join and no shuffle.

Dimensions are functions of the text, and ties are cut by a hash of the text,
so equal texts share a shard. Groups of copies over 2 % of a shard's target
(fewer than ``50 * n_shards``) are first placed whole, each in the emptiest
shard; the cuts then fall among small groups and level the shards out. Only the
rows of a group over half a target, which would break the balance, are dealt
out.

Defined cases: a null text has size 1 (no byte, plus 1) and the crc32 of no
byte; a null doc_id is kept; repeated rows get slots of their own; extra
columns are not read; an empty table gives an empty table; a text of any
length is one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared

BINS = 4096
#: Rows of a numbering window, about.
SLOT_ROWS = 50_000


def document_metadata(docs: DataFrame) -> DataFrame:
    """(doc_id, row, size, text_crc32, h, dim_0, dim_1): a number for the row, bytes plus 1, and the share of bytes beyond one per character."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long")
    return docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), (size + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("h"), (size + 1).alias("dim_0"),
        F.floor(1_000_000 * (size - F.length(text)) / F.greatest(size, F.lit(1))).cast("long").alias("dim_1"))


def leaf_cells(n_shards: int) -> list[int]:
    """Cells without a cut, in order: cell 1 is the root, c splits into 2c and 2c + 1, halving its shards."""
    def below(cell: int, n: int) -> list[int]:
        return [cell] if n == 1 else below(2 * cell, n // 2) + below(2 * cell + 1, n - n // 2)
    return below(1, n_shards)


def within(cell: int, ancestor: int) -> bool:
    return cell >> max(0, cell.bit_length() - ancestor.bit_length()) == ancestor


def place_heavy(groups: list, leaves: list[int], target: float) -> tuple[list[tuple], dict[int, int]]:
    """Heavy groups: (h, size, leaf cell, 1) for the emptiest leaf, the heaviest group first, or
    (h, size, null, parts) for a group that has to be dealt out; and the bytes placed in each leaf."""
    load, marks = dict.fromkeys(leaves, 0), []
    for g in sorted(groups, key=lambda g: (-g["w"], g["h"])):
        if g["w"] > 0.5 * target and g["n"] > 1:
            marks.append((g["h"], g["size"], None, min(g["n"], int(g["w"] / (0.01 * target)))))
        else:
            leaf = min(leaves, key=load.get)
            load[leaf] += g["w"]
            marks.append((g["h"], g["size"], leaf, 1))
    return marks, load


def with_keys(meta: DataFrame, marks: list[tuple], dims: list[str]) -> DataFrame:
    """Adds ``leaf`` (of heavy groups) and key_i: dim_i, then a hash of the text, as one long."""
    # fewer than 50 * n_shards rows
    values = ", ".join(f"({h}L, {size}L, {'NULL' if leaf is None else leaf}, {parts})" for h, size, leaf, parts in marks or [(0, 0, None, 1)])
    table = meta.sparkSession.sql(f"SELECT h, size, CAST(leaf AS INT) AS leaf, parts FROM VALUES {values} AS marks(h, size, leaf, parts)")
    joined = meta.join(F.broadcast(table), ["h", "size"], "left")
    # a group that is dealt out by row gets a tie hash per part
    tie = F.when(F.col("parts") > 1, F.xxhash64("h", F.pmod(F.xxhash64("doc_id"), F.col("parts")))).otherwise(F.col("h"))
    tie = F.shiftrightunsigned(tie, 32)
    return joined.select(*meta.columns, "leaf", *[(F.shiftleft(F.col(d), 32) + tie).alias(f"key_{i}") for i, d in enumerate(dims)])


def _case(node: Column, values: dict[int, Column], other: Column) -> Column:
    return reduce(lambda c, kv: F.when(node == kv[0], kv[1]).otherwise(c), values.items(), other)


def build_tree(points: DataFrame, n_shards: int, n_dims: int, load: dict[int, int]) -> list[dict[int, tuple[int, int]]]:
    """Per level: cell -> (dimension, cut). A row goes right if its key is over the cut.

    ``points``: key_i, dim_i and weight ``w`` of all but the heavy groups; ``load``: bytes of those by leaf.
    """
    leaves, tree, node, scale = {1: n_shards}, [], F.lit(1), None
    while any(n > 1 for n in leaves.values()):
        cells = [c for c, n in leaves.items() if n > 1]
        placed = points.withColumn("cell", node).where(F.col("cell").isin(cells))
        stats = placed.groupBy("cell").agg(
            F.sum("w").alias("w"),
            *[f(c).alias(f"{n}_{c}") for i in range(n_dims) for c in (f"dim_{i}", f"key_{i}") for n, f in (("lo", F.min), ("hi", F.max))])
        found = {r["cell"]: r for r in stats.collect()}
        widths = {c: [r[f"hi_dim_{i}"] - r[f"lo_dim_{i}"] for i in range(n_dims)] for c, r in found.items()}
        scale = scale or [max(w, 1) for w in widths.get(1, [1] * n_dims)]
        widest = {c: max(range(n_dims), key=lambda i: w[i] / scale[i]) for c, w in widths.items()}
        heavy = {c: sum(w for leaf, w in load.items() if within(leaf, c)) for x in cells for c in (x, 2 * x, 2 * x + 1)}
        want = {c: (r["w"] + heavy[c]) * (leaves[c] // 2) / leaves[c] - heavy[2 * c] for c, r in found.items()}
        # a cell without rows needs no cut
        level = dict.fromkeys(cells, (0, 0)) | weighted_cuts(placed, found, widest, want)
        tree.append(level)
        node = step(node, level)
        leaves = {child: n for c, k in leaves.items() for child, n in (((2 * c, k // 2), (2 * c + 1, k - k // 2)) if k > 1 else ((c, k),))}
    return tree


def weighted_cuts(placed: DataFrame, found: dict, widest: dict[int, int], want: dict[int, float]) -> dict[int, tuple[int, int]]:
    """The cut of each cell whose left side weighs nearest to ``want``, by zooming histograms."""
    key = _case(F.col("cell"), {c: F.col(f"key_{d}") for c, d in widest.items()}, F.lit(0).cast("long"))
    keyed = placed.select("cell", key.alias("key"), "w")
    # lowest and highest key of the zoom, weight below it, wanted weight
    state = {c: [found[c][f"lo_key_{d}"], found[c][f"hi_key_{d}"], 0, want[c]] for c, d in widest.items()}
    cuts = {}
    while state:
        width = {c: max(1, -(-(s[1] - s[0] + 1) // BINS)) for c, s in state.items()}
        low = _case(F.col("cell"), {c: F.lit(s[0]) for c, s in state.items()}, F.lit(0).cast("long"))
        high = _case(F.col("cell"), {c: F.lit(s[1]) for c, s in state.items()}, F.lit(-1).cast("long"))
        wide = _case(F.col("cell"), {c: F.lit(w).cast("long") for c, w in width.items()}, F.lit(1).cast("long"))
        bins = (keyed.where(F.col("cell").isin(list(state)) & F.col("key").between(low, high))
                .select("cell", "w", (F.col("key") - low).alias("past"), wide.alias("wide"))
                .groupBy("cell", F.expr("past div wide").alias("bin")).agg(F.sum("w").alias("w")).collect())
        for c, (lo, hi, below, want) in list(state.items()):
            at = below
            for b, w in sorted((r["bin"], r["w"]) for r in bins if r["cell"] == c):
                first = lo + b * width[c]
                if at + w < want:
                    at += w
                    continue
                if width[c] == 1:
                    # the key that crosses the wanted weight goes to the side that ends nearer to it
                    cuts[c] = widest[c], first if at + w - want <= want - at else first - 1
                    del state[c]
                else:
                    state[c] = [first, min(hi, first + width[c] - 1), at, want]
                break
            else:
                cuts[c] = widest[c], hi
                del state[c]
    return cuts


def step(node: Column, level: dict[int, tuple[int, int]]) -> Column:
    """Cell of a row after the cuts of one level."""
    return _case(node, {c: 2 * F.lit(c) + (F.col(f"key_{d}") > F.lit(cut)).cast("int") for c, (d, cut) in level.items()}, node)


def shard_by_bytes(docs: DataFrame, n_shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document.

    Shards are near equal in bytes (law ``bytes``); slots are gapless from 0.
    """
    store = Shared(docs.sparkSession, "kd")
    dims, leaves = ["dim_0", "dim_1"], leaf_cells(n_shards)
    meta = store.write(document_metadata(docs), "meta")
    found = meta.agg(F.sum("size").alias("w"), F.count("*").alias("n")).first()
    target = max((found["w"] or 0) / n_shards, 1)
    # fewer than 50 * n_shards groups, since each holds over 2 % of a target
    heavy = (meta.groupBy("h", "size").agg(F.sum("size").alias("w"), F.count("*").alias("n"))
             .where(F.col("w") > 0.02 * target).collect())
    marks, load = place_heavy(heavy, leaves, target)
    keyed = with_keys(meta, marks, dims)
    points = store.write(keyed.where(F.col("leaf").isNull()).groupBy(*[f"key_{i}" for i in range(len(dims))])
                         .agg(F.sum("size").alias("w"), *[F.min(d).alias(d) for d in dims]), "points")
    node, frame = F.lit(1), keyed
    for i, level in enumerate(build_tree(points, n_shards, len(dims), load)):
        frame = frame.withColumn(f"cell_{i}", step(node, level))
        node = F.col(f"cell_{i}")
    shard = _case(F.coalesce(F.col("leaf"), node), {c: F.lit(i) for i, c in enumerate(leaves)}, F.lit(0)).cast("int")
    buckets = max(1, found["n"] // SLOT_ROWS)
    # rows that repeat a document fall into many buckets, by the row's number
    frame = frame.select("doc_id", "row", "size", "text_crc32", "h", shard.alias("shard"),
                         F.pmod(F.xxhash64("doc_id", "h", "row"), F.lit(buckets)).cast("int").alias("bucket"))
    counts = frame.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "h", "row"))
    store.drop("points")
    return (frame.withColumn("rank", rank).join(base, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("base") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
