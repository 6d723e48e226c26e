"""Scopes: store x segment selections with "all" roll-up levels.

A scope is a ``(store, segment)`` pair where either key may be ``'*'``
("all stores" / "all segments"). Operators aggregate to the finest grain
first and only then fan rows out to the four levels, so the fan-out works on
already combined rows, and the single ``('*', '*')`` scope stays spread over
its other keys (dates, months, models) until those are aggregated too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = "*"
SCOPE = ("store", "segment")

# ABC class descriptions.
ABC_LABELS = {"A": "80% of revenue", "B": "15% of revenue", "C": "5% of revenue"}


def scope_window() -> Window:
    return Window.partitionBy(*SCOPE)


def expand_scopes(df: DataFrame, store: str = "store", segment: str = "segment") -> DataFrame:
    """B2: each row once per scope level it belongs to.

    A row with a NULL store appears only at the levels where store is ``'*'``
    (and likewise for segment), the way a keyed group-by drops NULL keys
    while a keyless total keeps the row.
    """
    levels = F.explode(F.array(
        F.struct(F.col(store).alias("s"), F.col(segment).alias("g")),
        F.struct(F.lit(ALL).alias("s"), F.col(segment).alias("g")),
        F.struct(F.col(store).alias("s"), F.lit(ALL).alias("g")),
        F.struct(F.lit(ALL).alias("s"), F.lit(ALL).alias("g")),
    ))
    others = [c for c in df.columns if c not in (store, segment)]
    return (df.select(levels.alias("_scope"), *others)
              .select(F.col("_scope.s").alias("store"), F.col("_scope.g").alias("segment"), *others)
              .filter(F.col("store").isNotNull() & F.col("segment").isNotNull()))


def filter_scope(sales: DataFrame, store: str | None = None, segment: str | None = None) -> DataFrame:
    """B1: one selection; ``None`` or ``'*'`` means all. Pushed into the scan."""
    out = sales
    if store not in (None, ALL):
        out = out.filter(F.col("store") == store)
    if segment not in (None, ALL):
        out = out.filter(F.col("segment") == segment)
    return out


def list_stores(sales: DataFrame) -> DataFrame:
    """Sorted distinct non-null stores."""
    return sales.select("store").where(F.col("store").isNotNull()).distinct().orderBy("store")


def list_segments(sales: DataFrame, store: str | None = None) -> DataFrame:
    """Sorted distinct segments, optionally of one store."""
    return (filter_scope(sales, store=store).select("segment")
            .where(F.col("segment").isNotNull()).distinct().orderBy("segment"))


def min_rows_guard(daily: DataFrame, min_lines: int = 10) -> DataFrame:
    """Scopes with at least ``min_lines`` sale lines (forecastable), from the daily series."""
    return daily.groupBy(*SCOPE).agg(F.sum("lines").alias("lines")).filter(F.col("lines") >= min_lines)


def weekday(col: Column | str) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(F.col(col) if isinstance(col, str) else col)


def weekday_name(col: Column | str) -> Column:
    """English weekday name."""
    return F.date_format(F.col(col) if isinstance(col, str) else col, "EEEE")


def abc_label(col: Column | str) -> Column:
    """Class letter -> description."""
    mapping = F.create_map(*[F.lit(x) for kv in ABC_LABELS.items() for x in kv])
    return F.element_at(mapping, F.col(col) if isinstance(col, str) else col)
