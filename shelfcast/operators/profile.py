"""What the findings (K1-K15) read from the daily series and the forecast, in one pass per scope.

The rows of both (bounded by calendar and horizon) are stacked and shuffled by
scope once. One order and one aggregate over them give D3-D5, D13, D15, D17,
E11, J5 and J10-J13 together, by the formulas of the operators that
give each of them as a table of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.operators.forecast import error_sums, fit_grade, horizon_sums, kpi_columns, weighted_price, with_errors
from shelfcast.operators.scope import SCOPE, weekday
from shelfcast.operators.series import cv_pct, volatility_columns
from shelfcast.operators.weekday import WEEKDAYS


def _weekday_columns() -> list[Column]:
    """D13 + D15 from the totals ``_wd``, an array of (qty, weekday) of the weekdays with sales."""
    qty = F.transform("_wd", lambda d: d["qty"])
    n = F.size("_wd")
    mean = F.aggregate(qty, F.lit(0.0), lambda a, q: a + q) / n
    square = F.aggregate(qty, F.lit(0.0), lambda a, q: a + (q - mean) * (q - mean))
    best = F.array_max(F.transform("_wd", lambda d: F.struct(d["qty"], -d["weekday"])))
    low = F.array_min(qty)
    return [(-best["col2"]).alias("best_weekday"), F.when(n > 1, F.sqrt(square / (n - 1))).alias("weekday_std"),
            low.alias("weekday_min"), (low < mean * 0.7).alias("weak_day_gap")]


def scope_profile(daily: DataFrame, fc: DataFrame, horizon: int) -> DataFrame:
    """One row for each scope of the forecast ``fc``; ``daily`` is the raw series.

    A scope with one day has NULL deviations; one whose actuals are all zero
    has a MAPE of 0; a horizon shorter than 30 days counts with all its days.
    """
    raw = daily.select(*SCOPE, "ds", F.col("y").alias("raw"), "amount", "lines")
    fitted = fc.select(*SCOPE, "ds", "is_future", "y", "yhat_raw", "yhat", "yhat_lower", "yhat_upper")
    scope = Window.partitionBy(*SCOPE)
    of_series = F.col("is_future").isNotNull()
    # from the last horizon day backwards, the raw series after the whole forecast
    backwards = scope.orderBy(of_series.desc(), F.col("ds").desc())
    rows = (with_errors(raw.unionByName(fitted, allowMissingColumns=True))
            .withColumn("_rk", F.row_number().over(backwards))
            .withColumn("_h", F.count_if("is_future").over(scope))
            .withColumn("_before", F.count_if(of_series).over(scope)))
    processed = F.when(~F.col("is_future"), F.col("y"))
    totals = F.array(*[F.struct(F.sum(F.when(weekday("ds") == d, F.col("raw"))).alias("qty"), F.lit(d).alias("weekday"))
                       for d in WEEKDAYS])
    sums = rows.groupBy(*SCOPE).agg(
        *horizon_sums(horizon), *error_sums(),
        F.avg(F.when(F.col("is_future") & (F.col("_rk") <= 30), F.col("yhat"))).alias("avg_forecast_tail"),
        F.avg("raw").alias("raw_daily_mean"), F.stddev_samp("raw").alias("_std"), F.sum("lines").alias("_lines"),
        F.avg(F.when(F.col("_rk") - F.col("_before") <= 30, F.col("raw"))).alias("raw_last30_mean"),
        weighted_price(F.sum("raw"), F.sum("amount")).alias("weighted_price"),
        F.datediff(F.max(F.when(F.col("raw").isNotNull(), F.col("ds"))),
                   F.min(F.when(F.col("raw").isNotNull(), F.col("ds")))).alias("data_days"),
        (cv_pct(F.avg(processed), F.stddev_samp(processed)) / 100).alias("processed_cv"),
        F.filter(totals, lambda d: d["qty"].isNotNull()).alias("_wd"))
    volatility, raw_cv = volatility_columns(F.col("_lines"), F.col("raw_daily_mean"), F.col("_std"))
    r2, quality = fit_grade()
    whole = (sums.filter(F.col("total_forecast").isNotNull())
                 .withColumn("volatility", volatility).withColumn("r2", r2))
    return whole.select(
        *SCOPE, *kpi_columns(horizon), "volatility", raw_cv.alias("raw_cv"), "processed_cv",
        "raw_daily_mean", "raw_last30_mean", "avg_forecast_tail", "data_days", "mape", "r2", quality.alias("quality"),
        *_weekday_columns())
