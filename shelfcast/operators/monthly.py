"""Monthly analysis per scope (D6-D11, E7, E12, F8, J14 monthly targets).

Months per scope are bounded by the calendar, so the per-scope windows here
run over at most a few hundred rows each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.operators.cube import article_counts
from shelfcast.operators.scope import SCOPE


def monthly_sales(facts: DataFrame, daily: DataFrame) -> DataFrame:
    """D6 + D7 + D8 + E7: per scope and calendar month.

    ``qty``, ``amount``, ``unique_products`` (distinct articles), ``avg_price``
    = amount / qty (0 when qty <= 0), ``intensity`` = qty per distinct article,
    and the percent change of qty and amount against the previous *observed*
    month (NULL for the first month or a zero base).
    """
    sums = (daily.groupBy(*SCOPE, F.trunc("ds", "MM").alias("month"))
                 .agg(F.sum("y").alias("qty"), F.sum("amount").alias("amount")))
    distinct = article_counts(facts, F.trunc("ds", "MM"), "month", "unique_products")
    m = sums.join(distinct, [*SCOPE, "month"], "left").fillna(0, ["unique_products"])
    amount = F.col("amount").cast("double")
    w = Window.partitionBy(*SCOPE).orderBy("month")
    prev_qty, prev_amount = F.lag("qty").over(w), F.lag(amount).over(w)
    return m.select(
        *SCOPE, "month", "qty", amount.alias("amount"), "unique_products",
        F.when(F.col("qty") > 0, amount / F.col("qty")).otherwise(0.0).alias("avg_price"),
        F.try_divide(F.col("qty"), F.col("unique_products")).alias("intensity"),
        (F.try_divide(F.col("qty") - prev_qty, prev_qty) * 100).alias("mom_qty_pct"),
        (F.try_divide(amount - prev_amount, prev_amount) * 100).alias("mom_amount_pct"),
    )


def monthly_summary(monthly: DataFrame) -> DataFrame:
    """D9, D11, E12 and the monthly targets of J14, one row per scope.

    Growth compares the last observed month with the one before it; price
    drift compares the mean of the last three monthly prices with the first
    three (needs three months); the stock target is mean monthly qty x 1.2
    and the revenue target mean monthly amount x 1.1.
    """
    asc = Window.partitionBy(*SCOPE).orderBy("month")
    desc = Window.partitionBy(*SCOPE).orderBy(F.col("month").desc())
    r = (monthly.withColumn("_a", F.row_number().over(asc))
                .withColumn("_d", F.row_number().over(desc)))
    n = F.count(F.lit(1))
    last_qty = F.max(F.when(F.col("_d") == 1, F.col("qty")))
    prev_qty = F.max(F.when(F.col("_d") == 2, F.col("qty")))
    s = r.groupBy(*SCOPE).agg(
        n.alias("months"),
        F.avg("qty").alias("mean_qty"), F.avg("amount").alias("mean_amount"),
        last_qty.alias("last_qty"), prev_qty.alias("prev_qty"),
        F.max(F.when(F.col("_d") == 1, F.col("amount"))).alias("last_amount"),
        F.max(F.when(F.col("_d") == 1, F.col("unique_products"))).alias("last_products"),
        F.avg("unique_products").alias("mean_products"),
        F.max(F.when(F.col("_d") == 1, F.col("avg_price"))).alias("last_price"),
        F.avg("avg_price").alias("mean_price"), F.stddev_samp("avg_price").alias("std_price"),
        F.avg(F.when(F.col("_d") <= 3, F.col("avg_price"))).alias("recent_price"),
        F.avg(F.when(F.col("_a") <= 3, F.col("avg_price"))).alias("early_price"),
    )
    return s.select(
        *SCOPE, "months", "mean_qty", "mean_amount", "last_qty", "prev_qty", "last_amount",
        (F.col("last_qty") - F.col("mean_qty")).alias("last_vs_mean_qty"),
        (F.col("last_amount") - F.col("mean_amount")).alias("last_vs_mean_amount"),
        F.when(F.col("months") >= 2, (F.try_divide(F.col("last_qty"), F.col("prev_qty")) - 1) * 100)
         .alias("mom_growth_pct"),
        "last_products", "mean_products", "last_price", "mean_price", "std_price",
        (F.col("std_price") < F.col("mean_price") * 0.2).alias("price_stable"),
        F.when(F.col("months") >= 3, F.col("recent_price")).alias("recent_price"),
        F.when(F.col("months") >= 3, F.col("early_price")).alias("early_price"),
        (F.col("mean_qty") * 1.2).alias("stock_target_month"),
        (F.col("mean_amount") * 1.1).alias("revenue_target_month"),
    )


def monthly_seasonality(monthly: DataFrame) -> DataFrame:
    """Std over calendar months of the mean monthly qty (>= 6 months).

    ``high_seasonality`` when that std exceeds 0.3 x mean monthly qty.
    """
    by_month = (monthly.groupBy(*SCOPE, F.month("month").alias("month_num"))
                       .agg(F.avg("qty").alias("_mq"), F.count(F.lit(1)).alias("_n"), F.sum("qty").alias("_q")))
    s = by_month.groupBy(*SCOPE).agg(
        F.stddev_samp("_mq").alias("seasonality_std"),
        F.sum("_n").alias("months"), (F.sum("_q") / F.sum("_n")).alias("mean_qty"))
    return (s.filter(F.col("months") >= 6)
             .select(*SCOPE, "months", "seasonality_std",
                     (F.col("seasonality_std") > F.col("mean_qty") * 0.3).alias("high_seasonality")))


def recent_months(monthly: DataFrame, n: int = 6) -> DataFrame:
    """F8: the last ``n`` observed months of each scope."""
    rk = F.row_number().over(Window.partitionBy(*SCOPE).orderBy(F.col("month").desc()))
    return monthly.withColumn("_rk", rk).filter(F.col("_rk") <= n).drop("_rk")
