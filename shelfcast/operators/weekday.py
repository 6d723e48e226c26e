"""Weekday and ISO-week profiles per scope.

All of them start from the daily table, so a scope contributes at most
seven rows per weekday profile and 53 x 7 cells to the week matrix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.operators.scope import SCOPE, weekday

WEEKDAYS = list(range(7))
# Short names of the matrix columns, Monday first.
DAY_COLUMNS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def weekday_sales(daily: DataFrame) -> DataFrame:
    """Per weekday (Monday = 0) qty, amount, price and share of qty in %."""
    wd = (daily.groupBy(*SCOPE, weekday("ds").alias("weekday"))
               .agg(F.sum("y").alias("qty"), F.sum("amount").cast("double").alias("amount"),
                    F.date_format(F.min("ds"), "EEEE").alias("weekday_name")))
    total = F.sum("qty").over(Window.partitionBy(*SCOPE))
    return wd.select(*SCOPE, "weekday", "weekday_name", "qty", "amount",
                     F.try_divide(F.col("amount"), F.col("qty")).alias("avg_price"),
                     (F.try_divide(F.col("qty"), total) * 100).alias("qty_pct"))


def weekday_extremes(weekdays: DataFrame) -> DataFrame:
    """D13 + D15: best/worst weekday (ties -> lowest weekday) and dispersion.

    ``weak_day_gap`` is true when the weakest weekday sells under 0.7 x the
    mean of the weekday totals; ``peak_on_weekend`` when the best is Sat/Sun.
    """
    best = F.max_by("weekday", F.struct(F.col("qty"), -F.col("weekday")))
    worst = F.min_by("weekday", F.struct(F.col("qty"), F.col("weekday")))
    best_amount = F.max_by("weekday", F.struct(F.col("amount"), -F.col("weekday")))
    e = weekdays.groupBy(*SCOPE).agg(
        best.alias("best_weekday"), worst.alias("worst_weekday"), best_amount.alias("best_weekday_amount"),
        F.stddev_samp("qty").alias("weekday_std"), F.min("qty").alias("weekday_min"),
        F.avg("qty").alias("weekday_mean"))
    return e.select(*SCOPE, "best_weekday", "worst_weekday", "best_weekday_amount",
                    "weekday_std", "weekday_min", "weekday_mean",
                    (F.col("weekday_min") < F.col("weekday_mean") * 0.7).alias("weak_day_gap"),
                    F.col("best_weekday").isin(5, 6).alias("peak_on_weekend"))


def weekday_strength(weekdays: DataFrame) -> DataFrame:
    """Weekday class against the mean weekday total (< 0.8 weak, > 1.2 strong)."""
    mean = F.avg("qty").over(Window.partitionBy(*SCOPE))
    return weekdays.select(
        *SCOPE, "weekday", "qty",
        F.when(F.col("qty") < mean * 0.8, "weak").when(F.col("qty") > mean * 1.2, "strong")
         .otherwise("normal").alias("strength"))


def week_weekday_matrix(daily: DataFrame) -> DataFrame:
    """ISO week x weekday quantity, years folded together, missing -> 0."""
    base = daily.withColumn("_wd", weekday("ds"))
    p = base.groupBy(*SCOPE, F.weekofyear("ds").alias("iso_week")).pivot("_wd", WEEKDAYS).agg(F.sum("y"))
    cols = [F.coalesce(F.col(str(d)), F.lit(0.0)).alias(name) for d, name in zip(WEEKDAYS, DAY_COLUMNS)]
    return p.select(*SCOPE, "iso_week", *cols)
