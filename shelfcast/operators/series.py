"""Daily series per scope and their preparation.

The only shuffle of raw sale lines is the combine to ``(store, segment,
sale_date)``; everything after it works on daily rows, whose count per scope is
bounded by the calendar (days in the data), not by the number of sales.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.smoothing import dot, literal_matrix, savgol_hat_matrix
from shelfcast.operators.scope import SCOPE, expand_scopes


#: Rows of a block of the exponential average.
EMA_BLOCK = 64


@dataclass(frozen=True)
class Prep:
    """Series preparation settings (defaults: clip outliers, no smoothing)."""

    remove_outliers: bool = True
    method: str | None = None  # None | 'ma' | 'ema' | 'savgol'
    window: int = 7
    iqr_k: float = 1.5


def _ordered() -> Window:
    return Window.partitionBy(*SCOPE).orderBy("ds")


def daily_facts(facts: DataFrame) -> DataFrame:
    """Finest daily grain from the fact cube: quantity, amount (NULL-only sums to 0), lines."""
    return (facts.groupBy("store", "segment", "ds")
                 .agg(F.sum("qty").alias("qty"),
                      F.coalesce(F.sum("amount"), F.lit(0).cast("decimal(28,6)")).alias("amount"),
                      F.sum("lines").alias("lines")))


def daily_sales(facts: DataFrame) -> DataFrame:
    """Per scope and sale date, ``y`` = quantity sold; no gap filling.

    ``facts`` is the fact cube (``operators.cube.fact_cube``).
    """
    return (expand_scopes(daily_facts(facts))
            .groupBy("store", "segment", "ds")
            .agg(F.sum("qty").cast("double").alias("y"),
                 F.sum("amount").alias("amount"),
                 F.sum("lines").alias("lines")))


def winsorize_iqr(daily: DataFrame, col: str = "y", k: float = 1.5) -> DataFrame:
    """Clip to ``[Q1 - k IQR, Q3 + k IQR]`` per scope; series < 4 points unchanged.

    Quartiles are linearly interpolated (``percentile``). The frame is the
    whole daily series of one scope, bounded by its number of dates.
    """
    w = Window.partitionBy(*SCOPE)
    q = F.percentile(col, F.array(F.lit(0.25), F.lit(0.75))).over(w)
    n = F.count(F.lit(1)).over(w)
    out = daily.withColumn("_q", q).withColumn("_n", n)
    iqr = F.col("_q")[1] - F.col("_q")[0]
    lo = F.col("_q")[0] - F.lit(k) * iqr
    hi = F.col("_q")[1] + F.lit(k) * iqr
    clipped = F.when(F.col("_n") >= 4, F.least(F.greatest(F.col(col), lo), hi)).otherwise(F.col(col))
    return out.withColumn(col, clipped).drop("_q", "_n")


def moving_average(daily: DataFrame, window: int = 7, col: str = "y") -> DataFrame:
    """Centred mean over ``window`` rows, shrinking at the edges.

    An even window reaches one row further back than ahead.
    """
    w = _ordered().rowsBetween(-(window // 2), (window - 1) // 2)
    return daily.withColumn(col, F.avg(col).over(w))


def ema(daily: DataFrame, span: int = 7, col: str = "y") -> DataFrame:
    """``e0 = y0``, ``e_t = a y_t + (1 - a) e_{t-1}``, ``a = 2 / (span + 1)``.

    Over the whole history, in blocks of ``EMA_BLOCK`` rows. Each row folds the
    values of its own block. A block is an affine map of the ``e`` before it,
    ``own + (1 - a)^rows x``; the maps are composed once per block, on one row
    per block, and every row of a block takes the same ``e`` from it. All steps
    keep the partitioning by scope, so nothing is shuffled between them.
    """
    alpha = 2.0 / (span + 1.0)
    decay = 1.0 - alpha
    ordered = _ordered()
    i = F.row_number().over(ordered) - 1
    recent = F.collect_list(col).over(ordered.rowsBetween(-(EMA_BLOCK - 1), 0))
    place = F.col("_i") % EMA_BLOCK
    own = F.aggregate(F.slice(F.col("_h"), -(place + 1), place + 1), F.lit(0.0),
                      lambda acc, x: F.lit(alpha) * x + F.lit(decay) * acc)
    rows = daily.withColumn("_i", i).withColumn("_h", recent).withColumn("_own", own).drop("_h")
    blocks = (rows.withColumn("_block", F.floor(F.col("_i") / EMA_BLOCK)).groupBy(*SCOPE, "_block")
              .agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in SCOPE])).alias("_rows"),
                   F.max_by("_own", "_i").alias("_end"), F.min_by(col, "_i").alias("_y0")))
    by_block = Window.partitionBy(*SCOPE).orderBy("_block")
    ends = F.collect_list("_end").over(by_block.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("_y0").over(by_block.rowsBetween(Window.unboundedPreceding, 0))
    carry = F.aggregate("_ends", F.col("_first"), lambda acc, x: x + F.lit(decay ** EMA_BLOCK) * acc)
    out = (blocks.withColumn("_ends", ends).withColumn("_first", first).withColumn("_carry", carry)
                 .select(*SCOPE, "_carry", F.inline("_rows")))
    value = F.col("_own") + F.pow(F.lit(decay), place + 1) * F.col("_carry")
    return out.withColumn(col, value).select(*daily.columns)


def savgol(daily: DataFrame, window: int = 7, col: str = "y") -> DataFrame:
    """Savitzky-Golay, order ``min(3, window - 1)``, polynomial edges.

    An even window is widened by one; a series shorter than the window is
    returned unchanged. Interior rows use the centre row of the hat matrix
    over the centred window; the first/last ``window // 2`` rows evaluate the
    polynomial fitted to the first/last ``window`` values.
    """
    if window % 2 == 0:
        window += 1
    order = min(3, window - 1)
    m = window // 2
    h = literal_matrix(savgol_hat_matrix(window, order))
    ordered = _ordered()
    i = F.row_number().over(ordered) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(*SCOPE))
    centred = F.collect_list(col).over(ordered.rowsBetween(-m, m))
    wide = F.collect_list(col).over(ordered.rowsBetween(-(window - 1), window - 1))
    out = (daily.withColumn("_i", i).withColumn("_n", n)
                .withColumn("_c", centred).withColumn("_w", wide))
    head = F.col("_i") < m
    tail = F.col("_i") >= F.col("_n") - m
    values = (F.when(head, F.slice("_w", 1, window))
               .when(tail, F.slice("_w", -window, window))
               .otherwise(F.col("_c")))
    row = (F.when(head, F.col("_i"))
            .when(tail, F.lit(window) - (F.col("_n") - F.col("_i")))
            .otherwise(F.lit(m)))
    smoothed = dot(values, F.element_at(h, (row + 1).cast("int")))
    result = F.when(F.col("_n") >= window, smoothed).otherwise(F.col(col))
    return out.withColumn(col, result).drop("_i", "_n", "_c", "_w")


def clip_nonnegative(daily: DataFrame, col: str = "y") -> DataFrame:
    """E5."""
    return daily.withColumn(col, F.greatest(F.col(col), F.lit(0.0)))


def prepare_series(daily: DataFrame, prep: Prep = Prep()) -> DataFrame:
    """D2 -> optional E1 -> optional smoother -> E5; keeps ``y_raw``."""
    out = daily.select("store", "segment", "ds", F.col("y").alias("y_raw"), F.col("y"))
    if prep.remove_outliers:
        out = winsorize_iqr(out, "y", prep.iqr_k)
    if prep.method == "ma":
        out = moving_average(out, prep.window)
    elif prep.method == "ema":
        out = ema(out, prep.window)
    elif prep.method == "savgol":
        out = savgol(out, prep.window)
    elif prep.method not in (None, "none"):
        raise ValueError(f"unknown smoothing method {prep.method!r}")
    return clip_nonnegative(out)


def daily_average(daily: DataFrame) -> DataFrame:
    """D3: mean daily quantity per scope."""
    return daily.groupBy(*SCOPE).agg(F.avg("y").alias("avg_daily_qty"))


def segment_volatility(daily: DataFrame) -> DataFrame:
    """``std / mean`` of daily quantity clamped to [0, 1].

    0.3 when the scope has fewer than two sale lines or a zero mean; NULL
    when the standard deviation is undefined (one date). ``cv_raw`` is the
    unclamped ratio (0 when the mean is not positive), used by the rules.
    """
    agg = daily.groupBy(*SCOPE).agg(
        F.sum("lines").alias("_lines"), F.avg("y").alias("_m"), F.stddev_samp("y").alias("_s"))
    vol, cv = volatility_columns(F.col("_lines"), F.col("_m"), F.col("_s"))
    return agg.select(*SCOPE, vol.alias("volatility"), cv.alias("cv_raw"))


def volatility_columns(lines, mean, std):
    """D4 from a scope's lines and the mean and standard deviation of its days: clamped and raw."""
    ratio = F.try_divide(std, mean)
    vol = (F.when((lines < 2) | (mean == 0), F.lit(0.3))
            .when(ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))))
    return vol, F.when(mean > 0, ratio).otherwise(F.lit(0.0))


def cv_pct(mean, std):
    return F.when(mean > 0, std / mean * 100).otherwise(F.lit(0.0))


def series_stats(prepared: DataFrame) -> DataFrame:
    """Mean, std and CV % before and after preparation, and differences."""
    a = prepared.groupBy(*SCOPE).agg(
        F.avg("y_raw").alias("mean_before"), F.stddev_samp("y_raw").alias("std_before"),
        F.avg("y").alias("mean_after"), F.stddev_samp("y").alias("std_after"))
    return (a.withColumn("cv_before_pct", cv_pct(F.col("mean_before"), F.col("std_before")))
             .withColumn("cv_after_pct", cv_pct(F.col("mean_after"), F.col("std_after")))
             .withColumn("mean_diff", F.col("mean_after") - F.col("mean_before"))
             .withColumn("std_diff", F.col("std_after") - F.col("std_before"))
             .withColumn("cv_diff_pct", F.col("cv_after_pct") - F.col("cv_before_pct")))


def history_stats(daily: DataFrame, prepared: DataFrame) -> DataFrame:
    """Span in days + 1, totals, weighted price, processed daily mean/max/min."""
    raw = daily.groupBy(*SCOPE).agg(
        F.min("ds").alias("first_date"), F.max("ds").alias("last_date"),
        F.sum("y").alias("total_qty"), F.sum("amount").alias("total_amount"))
    proc = prepared.groupBy(*SCOPE).agg(
        F.avg("y").alias("avg_daily"), F.max("y").alias("max_daily"), F.min("y").alias("min_daily"))
    price = F.when(F.col("total_qty") > 0, F.col("total_amount").cast("double") / F.col("total_qty")).otherwise(0.0)
    return (raw.join(proc, list(SCOPE))
               .select(*SCOPE, "first_date", "last_date",
                       (F.datediff("last_date", "first_date") + 1).alias("span_days"),
                       "total_qty", F.col("total_amount").cast("double").alias("total_amount"),
                       price.alias("avg_price"), "avg_daily", "max_daily", "min_daily"))


def last_n_observations(prepared: DataFrame, n: int = 30, col: str = "y") -> DataFrame:
    """Mean and sum of the last ``n`` processed daily values per scope."""
    rk = F.row_number().over(Window.partitionBy(*SCOPE).orderBy(F.col("ds").desc()))
    return (prepared.withColumn("_rk", rk).filter(F.col("_rk") <= n)
            .groupBy(*SCOPE).agg(F.avg(col).alias(f"last{n}_mean"), F.sum(col).alias(f"last{n}_sum")))


def last_30_days(daily: DataFrame) -> DataFrame:
    """Quantity on dates >= last date - 30 days (31 calendar dates)."""
    last = F.max("ds").over(Window.partitionBy(*SCOPE))
    return (daily.withColumn("_last", last)
                 .filter(F.col("ds") >= F.date_sub("_last", 30))
                 .groupBy(*SCOPE).agg(F.sum("y").alias("qty_last_30_days")))
