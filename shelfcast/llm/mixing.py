"""Mixing sources to target weights by Pareto order sampling (operator 13). DataFrame functions only.

A source's share of the mix follows its weight, up to ``most`` times its own
size; what a source can't give is shared among the others by weight. Within a
source a document's expected number of copies is proportional to its
importance (by default the bit length of its size, so longer documents come
more often), up to ``most``, such that the expected words add up to the
source's target. The whole copies of that number are certain. The remaining
fraction is an inclusion probability: documents are ranked by the odds of a
random number divided by the odds of that probability (Pareto order sampling),
and the first ones are taken until the source's remaining words are reached.
The size that the sample fixes is thus the words of the source; the document
that crosses it is taken if that ends nearer.

The crossing is found digit by digit: words are summed by the highest bits of
the rank, the interval that crosses is kept, and only its rows go on to the
next bits. Rows of equal rank (a document repeated many times) are told apart
by the task that read them and their place in it. So no task orders a source,
and what the driver sees is three numbers per round of sharing.

Random numbers come from md5 of seed, doc_id and the text's md5, so reruns
agree, whatever the partitions; rows that repeat a document are
interchangeable, and how many of them are taken is fixed too.

Defined cases: a null or empty text has no word and is never taken; a null
source is a source of its own, the last; a null doc_id counts as the empty
string in the random number; a source without words has the target 0; an
importance that is null or out of 1 to 64 is moved to the nearest end; extra
columns are not read, and columns carried along may have any name; an empty
table gives an empty table; a text of any length is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import salted_join
from .common import WORD_PATTERN, Shared

#: Bits of the random number and of the rank.
BITS = 48
#: Largest importance.
CLASSES = 64


def bit_length(size: Column) -> Column:
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def measured(docs: DataFrame, carry: Sequence[str], importance: Column, seed: int) -> DataFrame:
    """(doc, src, size, cls, draw, part, place): one row per document row.

    ``src`` sorts by code point, null last. ``part`` and ``place`` number the
    rows as they are read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    named = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.encode(text, "UTF-8")))
    row = F.monotonically_increasing_id()
    sized = docs.select(
        F.struct(*carry).alias("doc"),
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source"))).alias("src"),
        F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.encode(named, "UTF-8")), 1, BITS // 4), 16, 10).cast("long").alias("draw"),
        F.shiftright(row, 33).alias("part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    cls = F.least(F.greatest(F.coalesce(importance.cast("int"), F.lit(1)), F.lit(1)), F.lit(CLASSES))
    return sized.withColumn("cls", cls)


def ordinals(sources: DataFrame, store: Shared) -> DataFrame:
    """Adds ``ordinal``, the place of each ``src`` in their order, from 0; ranged over tasks."""
    ranged = store.write(sources.repartitionByRange("src").withColumn("range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # one row per range
    offsets = sizes.select("range", F.coalesce(before, F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("src"))
    return (ranged.withColumn("r", rank).join(offsets, "range")
            .select(*sources.columns, (F.col("offset") + F.col("r") - 1).alias("ordinal")))


def with_targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Adds ``target`` to (src, words, weight): proportional to weight, at most ``most`` times the words.

    The unit per weight grows round by round, as sources reach their limit, until no further one does.
    """
    words = F.col("words")
    first = sources.agg(F.sum("words").alias("words"), F.sum("weight").alias("weight")).first()
    budget = min(share, most) * (first["words"] or 0)
    unit, capped = budget / (first["weight"] or 1), 0
    while True:
        full = most * words < unit * F.col("weight")
        now = sources.agg(F.sum(F.when(full, words)).alias("words"), F.sum(F.when(~full, F.col("weight"))).alias("weight"),
                          F.count(F.when(full, 1)).alias("n")).first()
        if now["n"] == capped or not now["weight"]:
            break
        unit, capped = (budget - most * now["words"]) / now["weight"], now["n"]
    return sources.withColumn("target", F.least(most * words, unit * F.col("weight")))


def with_rates(classes: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """(src, words, target, rate, rest): copies per importance, and words left after the whole copies.

    ``classes``: (src, cls, words), at most ``CLASSES`` rows per source. The
    most important classes reach ``most`` first; ``rate`` is null if all do.
    """
    held = classes.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("cls", "words")), asc=False).alias("held"))
    begin = F.struct(F.lit(0).cast("long").alias("full"),
                     F.aggregate("held", F.lit(0).cast("long"), lambda s, x: s + x["cls"] * x["words"]).alias("left"),
                     F.lit(None).cast("double").alias("rate"))

    def add(s: Column, x: Column) -> Column:
        rate = F.when(s["left"] > 0, (F.col("target") - most * s["full"]) / s["left"])
        fits = rate * x["cls"] <= most
        return F.struct(F.when(s["rate"].isNull() & ~F.coalesce(fits, F.lit(False)), s["full"] + x["words"]).otherwise(s["full"]).alias("full"),
                        (s["left"] - x["cls"] * x["words"]).alias("left"),
                        F.coalesce(s["rate"], F.when(fits, rate)).alias("rate"))
    rated = held.join(targets, "src").withColumn("rate", F.aggregate("held", begin, add)["rate"])
    certain = F.aggregate("held", F.lit(0.0), lambda s, x: s + F.floor(expected(F.col("rate"), x["cls"], most)) * x["words"])
    return rated.withColumn("rest", F.col("target") - certain).drop("held")


def expected(rate: Column, cls: Column, most: float) -> Column:
    """Expected copies of a document."""
    return F.coalesce(F.least(F.lit(float(most)), rate * cls), F.lit(float(most)))


def with_ranks(rows: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """Adds whole (certain copies) and rank (null where nothing is left to chance) to rows joined with their source's plan."""
    joined = salted_join(rows, plan, ["src"])
    copies = expected(F.col("rate"), F.col("cls"), most)
    joined = joined.withColumn("whole", F.when(F.col("size") > 0, F.floor(copies)).otherwise(0))
    p = copies - F.floor(copies)
    u = (F.col("draw") + 0.5) / float(1 << BITS)
    against = u * (1 - p)
    # odds(u) / odds(p), carried into 0 to 1
    rank = F.least(F.floor(against / (against + (1 - u) * p) * float(1 << BITS)), F.lit((1 << BITS) - 1))
    return joined.withColumn("rank", F.when((F.col("size") > 0) & (p > 0) & (F.col("rest") > 0), rank))


def crossings(ranked: DataFrame, plan: DataFrame, store: Shared) -> DataFrame:
    """(src, cut_rank, cut_part, cut_place, taken_too): the row of each source that crosses its remaining words.

    Each round sums the words by one digit of (rank, part, place) among the
    rows still open, finds the value that crosses, and keeps its rows.
    """
    rank = F.col("rank")
    digits = [F.shiftright(rank, 36), F.shiftright(rank, 24).bitwiseAND(F.lit(4095)), rank.bitwiseAND(F.lit((1 << 24) - 1)),
              F.col("part"), F.col("place")]
    state = plan.where(F.col("rest") > 0).select("src", "rest")
    rows = ranked.where(rank.isNotNull()).select("src", "size", "rank", "part", "place")
    for i, digit in enumerate(digits):
        # at most 4096 values, then those left under one, then one per task, then those of one task
        values = rows.groupBy("src", digit.alias("digit")).agg(F.sum("size").alias("w"))
        up_to = F.sum("w").over(Window.partitionBy("src").orderBy("digit"))
        crossed = (salted_join(values.withColumn("up_to", up_to), state.select("src", "rest"), ["src"])
                   .where((F.col("up_to") >= F.col("rest")) & (F.col("up_to") - F.col("w") < F.col("rest")))
                   .select("src", "digit", (F.col("rest") - (F.col("up_to") - F.col("w"))).alias("rest")))
        state = store.write(crossed, f"cross-{i}")
        rows = store.write(salted_join(rows, state.select("src", F.col("digit").alias("_digit")), ["src"])
                           .where(digit == F.col("_digit")).drop("_digit"), f"open-{i}")
    return rows.join(state.select("src", "rest"), "src").select(
        "src", F.col("rank").alias("cut_rank"), F.col("part").alias("cut_part"), F.col("place").alias("cut_place"),
        (F.col("size") - F.col("rest") <= F.col("rest")).alias("taken_too"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 42,
                importance: Column | None = None, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(doc, size, source_size, target, copies, taken) of every row; ``doc`` holds the columns ``carry``.

    Sources in order of code point weigh ``weights``, repeating, and share
    ``share`` times the words of all documents. ``importance`` is a whole
    number from 1 to 64, from the column ``size``.
    """
    store = Shared(docs.sparkSession, "mix")
    rows = store.write(measured(docs, carry, bit_length(F.col("size")) if importance is None else importance, seed), "rows")
    classes = store.write(rows.groupBy("src", "cls").agg(F.sum("size").alias("words")), "classes")
    sources = ordinals(classes.groupBy("src").agg(F.sum("words").alias("words")), store)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("ordinal") % len(weights) + 1).cast("int"))
    targets = store.write(with_targets(store.write(sources.select("src", "words", weight.alias("weight")), "weights"), share, most), "targets")
    plan = store.write(with_rates(classes, targets.select("src", "words", "target"), most), "plan")
    cuts = crossings(with_ranks(rows, plan, most), plan, store)
    known = store.write(plan.join(cuts, "src", "left"), "cuts")
    store.drop("classes", "ranged", "weights", "targets", "plan", *[f"{t}-{i}" for t in ("cross", "open") for i in range(5)])
    rank, part, place = F.col("rank"), F.col("part"), F.col("place")
    before = ((rank < F.col("cut_rank"))
              | ((rank == F.col("cut_rank")) & ((part < F.col("cut_part"))
                                                | ((part == F.col("cut_part")) & ((place < F.col("cut_place"))
                                                                                  | ((place == F.col("cut_place")) & F.col("taken_too")))))))
    # a source without a crossing has less than its rest to give: all of it
    extra = F.when(rank.isNotNull() & F.coalesce(before, F.lit(True)), 1).otherwise(0)
    marked = with_ranks(rows, known, most).withColumn("copies", (F.col("whole") + extra).cast("int"))
    return marked.select("doc", "size", F.col("words").alias("source_size"), "target", "copies",
                         (F.col("copies") * F.col("size")).alias("taken"))


def repeated_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its columns."""
    mixed = mix_sources(docs, carry=docs.columns, **options).where(F.col("copies") > 0)
    return mixed.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def mix_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    return mix_sources(docs).select("doc.doc_id", "size", "source_size", "target", "taken")
