"""Running sums over an order, without a task that holds a whole group.

Rows are dealt into ranges of ``(group, order)``: neighbours in the order share
a task, and a large group is cut over many. The ranges are kept in a reliable
checkpoint, so every later step sees the same cuts, also after a lost
executor. Each range is summed up, the sums of the ranges before it in its group
are its offset, and a window counts on inside each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.joins import salted_join
from shelfcast.session import ensure_checkpoint_dir


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column,
                up_to: str = "up_to", total: str = "total", partitions: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` over the group's rows up to this one, and over all of them.

    ``order`` is a total order inside a group (rows of equal keys would lie in
    one range); ``value`` must add up exactly (whole numbers or decimals).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = [*map(F.col, group), *order]
    dealt = df.withColumn("_value", value)
    dealt = dealt.repartitionByRange(partitions, *keys) if partitions else dealt.repartitionByRange(*keys)
    ranged = dealt.withColumn("_range", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per group and range
    offsets = (ranged.groupBy(*group, "_range").agg(F.sum("_value").alias("_sum"))
               .withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
               .withColumn("_total", F.sum("_sum").over(Window.partitionBy(*group))).drop("_sum"))
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (ranged.join(offsets, [*group, "_range"])
            .withColumn(up_to, F.col("_before") + F.sum("_value").over(inside)).withColumnRenamed("_total", total)
            .drop("_range", "_value", "_before"))


def _scale(x: Column) -> Column:
    """A whole number that orders doubles of any sign and size, 64 steps an octave."""
    step = F.floor(F.log2(F.abs(x)) * 64) + (1 << 17)
    return F.when(x > 0, step).when(x < 0, -step).otherwise(0)


def values_at_ranks(counts: DataFrame, group: str, value: str, weight: str, ranks: Sequence[Column],
                    bound: int = 10_000, steps: int = 1024) -> DataFrame:
    """(group, lines, low, high, at): least and greatest value, and the values at ``ranks``, by rank refinement.

    ``counts`` holds one row per group and value (kept by the caller, as it is
    read in every round), ``weight`` the rows that have it. ``ranks`` are
    columns over ``lines``, the group's rows, counted from 0. Values are summed
    up by intervals; only intervals that hold a wanted rank are looked into
    again, by equal steps between their least and greatest value, until none
    holds more than ``bound`` values. So no task sorts a group, and one
    value far from the others moves no other interval.
    """
    spark = counts.sparkSession
    ensure_checkpoint_dir(spark)
    rows = counts.select(F.col(group).alias("g"), F.col(value).alias("v"), F.col(weight).alias("w"))
    interval = [F.sum("w").alias("n"), F.count("*").alias("values"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    whole = Window.partitionBy("g")
    before = whole.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    # at most some thousand intervals of a group
    first = (rows.groupBy("g", _scale(F.col("v")).alias("place")).agg(*interval)
             .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
             .withColumn("lines", F.sum("n").over(whole)).withColumn("low", F.min("lo").over(whole)).withColumn("high", F.max("hi").over(whole)))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), r.cast("long").alias("rank")) for i, r in enumerate(ranks)])

    def holding(intervals: DataFrame) -> DataFrame:
        """Intervals with the wanted ranks that fall into them."""
        here = F.filter("wanted", lambda x: (x["rank"] >= F.col("start")) & (x["rank"] < F.col("start") + F.col("n")))
        return intervals.withColumn("wanted", here).filter(F.size("wanted") > 0)
    held = holding(first.withColumn("wanted", wanted)).select("g", "lines", "low", "high", "lo", "hi", "start", "values", "wanted").checkpoint()
    groups = held.groupBy("g").agg(F.first("lines").alias("lines"), F.first("low").alias("low"), F.first("high").alias("high"))
    found = [held.filter(F.col("lo") == F.col("hi")).select("g", "wanted", F.col("lo").alias("v"))]
    held = held.filter(F.col("lo") < F.col("hi")).select("g", "lo", "hi", "start", "values", "wanted")

    def inside(intervals: DataFrame) -> DataFrame:
        """Values of the intervals, with their interval's columns."""
        place = _scale(F.col("v"))
        keyed = intervals.withColumn("place", _scale(F.col("lo")))
        return (salted_join(rows.withColumn("place", place).filter(F.col("v").isNotNull()),
                            keyed.groupBy("g", "place").agg(F.collect_list(F.struct("lo", "hi", "start", "wanted")).alias("held")), ["g", "place"])
                .select("g", "v", "w", F.explode(F.filter("held", lambda x: (x["lo"] <= F.col("v")) & (F.col("v") <= x["hi"]))).alias("x"))
                .select("g", "v", "w", "x.*"))
    while held.filter(F.col("values") > bound).limit(1).count():
        step = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (steps - 1))
        finer = (inside(held).groupBy("g", F.col("lo").alias("of"), "start", "wanted", step.alias("step")).agg(*interval)
                 .withColumn("start", F.col("start") + F.coalesce(F.sum("n").over(
                     Window.partitionBy("g", "of").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
        held = holding(finer).select("g", "lo", "hi", "start", "values", "wanted").checkpoint()
        found.append(held.filter(F.col("lo") == F.col("hi")).select("g", "wanted", F.col("lo").alias("v")))
        held = held.filter(F.col("lo") < F.col("hi"))
    upto = F.col("start") + F.sum("w").over(Window.partitionBy("g", "lo").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = inside(held).withColumn("end", upto)
    here = F.filter("wanted", lambda x: (x["rank"] >= F.col("end") - F.col("w")) & (x["rank"] < F.col("end")))
    found.append(ranked.withColumn("wanted", here).filter(F.size("wanted") > 0).select("g", "wanted", "v"))
    values = found[0]
    for f in found[1:]:
        values = values.unionByName(f)
    spread = values.select("g", "v", F.explode("wanted").alias("x"))
    at = spread.groupBy("g").agg(F.array(*[F.max(F.when(F.col("x.i") == i, F.col("v"))) for i in range(len(ranks))]).alias("at"))
    return groups.join(at, "g").withColumnRenamed("g", group)
