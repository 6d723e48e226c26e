"""Seasonal forecasts for every scope at once.

Default model (J1a), per scope and entirely in SQL expressions:

    t        = days since the scope's first date
    trend(t) = a + b t                        (least squares, regr_slope/intercept)
    ratio    = y / greatest(trend, 5 % of mean y)
    wi(wd)   = mean ratio per weekday
    mi(m)    = mean of ratio / wi per calendar month
    yhat     = trend * coalesce(wi, 1) * coalesce(mi, 1)

The interval is ``yhat -/+ z80 * sd(residual)`` (80 %). The fitted model is a
set of small tables (coefficients, weekday and month indices) that can be
stored and applied to any dates. Everything runs on daily rows partitioned by
scope, so the fit adds no shuffle beyond the one that built the series.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.operators.scope import SCOPE, weekday

# Fixed value: two-sided 80 % standard normal quantile.
Z80 = 1.2815515655446004


@dataclass
class SeasonalIndexModel:
    """Fitted model as tables keyed by scope."""

    coef: DataFrame           # store, segment, first_ds, last_ds, n_days, mean_y, slope, intercept, resid_sd
    weekday_index: DataFrame  # store, segment, weekday, wi
    month_index: DataFrame    # store, segment, month_num, mi
    fitted: DataFrame         # history rows with y, trend, yhat_raw
    base: DataFrame           # the windowed frame all of the above are read from (persist it)


def restrict_to_scopes(prepared: DataFrame, scopes: DataFrame) -> DataFrame:
    """B4 applied to a series: keep scopes present in ``scopes`` (semi join)."""
    return prepared.join(scopes.select(*SCOPE), list(SCOPE), "left_semi")


def fit_seasonal_index(prepared: DataFrame) -> SeasonalIndexModel:
    """Fit trend x weekday index x month index on the processed ``y``."""
    return model_from_base(_windowed_fit(prepared))


def _windowed_fit(rows: DataFrame) -> DataFrame:
    """Fit and fitted values beside every row; rows without ``y`` are predicted, but take no part in the fit."""
    w = Window.partitionBy(*SCOPE)
    s = (rows.withColumn("first_ds", F.min("ds").over(w))
             .withColumn("last_ds", F.max("ds").over(w))
             .withColumn("t", F.datediff("ds", "first_ds").cast("double"))
             .withColumn("mean_y", F.avg("y").over(w))
             .withColumn("slope", F.coalesce(F.regr_slope("y", "t").over(w), F.lit(0.0)))
             .withColumn("intercept", F.coalesce(F.regr_intercept("y", "t").over(w), F.col("mean_y")))
             .withColumn("trend", F.col("intercept") + F.col("slope") * F.col("t"))
             .withColumn("weekday", weekday("ds"))
             .withColumn("month_num", F.month("ds")))
    floor = F.greatest(F.col("trend"), F.lit(0.05) * F.col("mean_y"))
    s = s.withColumn("ratio", F.try_divide(F.col("y"), floor))
    s = s.withColumn("wi", F.avg("ratio").over(Window.partitionBy(*SCOPE, "weekday")))
    s = s.withColumn("mi", F.avg(F.try_divide(F.col("ratio"), F.col("wi")))
                     .over(Window.partitionBy(*SCOPE, "month_num")))
    s = s.withColumn("yhat_raw", F.col("trend") * F.coalesce("wi", F.lit(1.0)) * F.coalesce("mi", F.lit(1.0)))
    return s.withColumn("resid_sd", F.coalesce(F.stddev_samp(F.col("y") - F.col("yhat_raw")).over(w), F.lit(0.0)))


def model_from_base(s: DataFrame) -> SeasonalIndexModel:
    """Coefficient and index tables read from the windowed fit frame."""
    coef = s.groupBy(*SCOPE).agg(
        F.first("first_ds").alias("first_ds"), F.first("last_ds").alias("last_ds"),
        F.count(F.lit(1)).alias("n_days"), F.first("mean_y").alias("mean_y"),
        F.first("slope").alias("slope"), F.first("intercept").alias("intercept"),
        F.first("resid_sd").alias("resid_sd"))
    wi = s.groupBy(*SCOPE, "weekday").agg(F.first("wi").alias("wi"))
    mi = s.groupBy(*SCOPE, "month_num").agg(F.first("mi").alias("mi"))
    fitted = s.select(*SCOPE, "ds", "y", "trend", "yhat_raw", "resid_sd")
    return SeasonalIndexModel(coef, wi, mi, fitted, s)


def future_frame(coef: DataFrame, horizon: int = 30) -> DataFrame:
    """The ``horizon`` calendar days after each scope's last date."""
    days = F.sequence(F.date_add("last_ds", 1), F.date_add("last_ds", horizon))
    return coef.select(*SCOPE, F.explode(days).alias("ds"))


def predict(model: SeasonalIndexModel, dates: DataFrame) -> DataFrame:
    """``yhat_raw``, trend and interval for (scope, ds) rows."""
    c = model.coef.select(*SCOPE, "first_ds", "slope", "intercept", "resid_sd")
    d = (dates.join(c, list(SCOPE))
              .withColumn("weekday", weekday("ds")).withColumn("month_num", F.month("ds"))
              .join(model.weekday_index, [*SCOPE, "weekday"], "left")
              .join(model.month_index, [*SCOPE, "month_num"], "left"))
    trend = F.col("intercept") + F.col("slope") * F.datediff("ds", "first_ds").cast("double")
    yhat = trend * F.coalesce("wi", F.lit(1.0)) * F.coalesce("mi", F.lit(1.0))
    return d.select(*SCOPE, "ds", trend.alias("trend"), yhat.alias("yhat_raw"), "resid_sd")


def _with_interval(df: DataFrame) -> DataFrame:
    """Interval from the residual sd, then yhat, lower, upper clipped at 0."""
    half = F.lit(Z80) * F.col("resid_sd")
    return (df.withColumn("yhat", F.greatest(F.col("yhat_raw"), F.lit(0.0)))
              .withColumn("yhat_lower", F.greatest(F.col("yhat_raw") - half, F.lit(0.0)))
              .withColumn("yhat_upper", F.greatest(F.col("yhat_raw") + half, F.lit(0.0)))
              .drop("resid_sd"))


def forecast(model: SeasonalIndexModel, horizon: int = 30) -> DataFrame:
    """J2 + J3 + J4: history (fitted) and horizon rows, ``is_future`` marks the latter."""
    hist = model.fitted.select(*SCOPE, "ds", F.lit(False).alias("is_future"), "y", "trend", "yhat_raw", "resid_sd")
    fut = (predict(model, future_frame(model.coef, horizon))
           .select(*SCOPE, "ds", F.lit(True).alias("is_future"), F.lit(None).cast("double").alias("y"),
                   "trend", "yhat_raw", "resid_sd"))
    return _with_interval(hist.unionByName(fut))


def fit_forecast(prepared: DataFrame, horizon: int = 30) -> DataFrame:
    """``forecast(fit_seasonal_index(prepared), horizon)`` in one pass, without a model table.

    The last day of each scope is followed by its horizon days before the fit,
    so they get trend and indices from the same windows: nothing is joined, and
    every step keeps the partitioning by scope.
    """
    last = F.max("ds").over(Window.partitionBy(*SCOPE))
    day = lambda ds, future, y: F.struct(ds.alias("ds"), future.alias("is_future"), y.alias("y"))
    observed = F.array(day(F.col("ds"), F.lit(False), F.col("y")))
    ahead = F.transform(F.sequence(F.date_add("ds", 1), F.date_add("ds", horizon)),
                        lambda d: day(d, F.lit(True), F.lit(None).cast("double")))
    rows = (prepared.select(*SCOPE, "ds", "y").withColumn("_last", last)
            .select(*SCOPE, F.inline(F.when(F.col("ds") == F.col("_last"), F.concat(observed, ahead)).otherwise(observed))))
    return _with_interval(_windowed_fit(rows).select(*SCOPE, "ds", "is_future", "y", "trend", "yhat_raw", "resid_sd"))


def future_rows(fc: DataFrame) -> DataFrame:
    """Forecast rows after the last observed date."""
    return fc.filter(F.col("is_future"))


def actual_vs_fitted(prepared: DataFrame, fc: DataFrame) -> DataFrame:
    """Actual processed ``y`` and in-sample ``yhat_raw`` on the same dates."""
    fitted = fc.filter(~F.col("is_future")).select(*SCOPE, "ds", "yhat_raw")
    return prepared.select(*SCOPE, "ds", "y").join(fitted, [*SCOPE, "ds"])


def fitted_rows(fc: DataFrame) -> DataFrame:
    """The history rows of a forecast: actual ``y`` and in-sample ``yhat_raw``."""
    return fc.filter(~F.col("is_future")).select(*SCOPE, "ds", "y", "yhat_raw")


def tail_mean(fc: DataFrame, n: int = 30) -> DataFrame:
    """K6: mean of the last ``n`` horizon days (all, if fewer) per scope."""
    rk = F.row_number().over(Window.partitionBy(*SCOPE).orderBy(F.col("ds").desc()))
    return (future_rows(fc).withColumn("_rk", rk).filter(F.col("_rk") <= n)
            .groupBy(*SCOPE).agg(F.avg("yhat").alias("avg_forecast_tail")))


def accuracy(pairs: DataFrame) -> DataFrame:
    """J5 + K7: in-sample MAE, RMSE, MAPE (non-zero actuals; 0 if none), R², grade.

    R² is 1 when the actuals are constant and fitted exactly, else 0 for
    constant actuals. Grade: MAPE < 10 and R² > 0.8 excellent; MAPE < 20
    and R² > 0.6 good; else fair.
    """
    a = with_errors(pairs).groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n_days"), *error_sums())
    r2, grade = fit_grade()
    return a.withColumn("r2", r2).select(*SCOPE, "n_days", "mae", "rmse", "mape", "r2", grade.alias("quality"))


def with_errors(pairs: DataFrame) -> DataFrame:
    """Adds the error ``_e`` of every day and the mean ``_m`` of the scope's actuals."""
    return (pairs.withColumn("_e", F.col("y") - F.col("yhat_raw"))
                 .withColumn("_m", F.avg("y").over(Window.partitionBy(*SCOPE))))


def error_sums() -> list[Column]:
    """Aggregates over ``with_errors`` rows; rows without an actual don't count."""
    return [F.avg(F.abs("_e")).alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
            F.coalesce(F.avg(F.when(F.col("y") != 0, F.abs(F.col("_e") / F.col("y")))) * 100, F.lit(0.0)).alias("mape"),
            F.sum(F.col("_e") * F.col("_e")).alias("_sse"),
            F.sum((F.col("y") - F.col("_m")) * (F.col("y") - F.col("_m"))).alias("_sst")]


def fit_grade() -> tuple[Column, Column]:
    """R² and grade from the columns of ``error_sums``; the grade reads a column ``r2``."""
    r2 = (F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst"))
           .when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    grade = (F.when((F.col("mape") < 10) & (F.col("r2") > 0.8), "excellent")
              .when((F.col("mape") < 20) & (F.col("r2") > 0.6), "good").otherwise("fair"))
    return r2, grade


def scenarios(fc: DataFrame) -> DataFrame:
    """J7 (+ J15): per horizon day the rounded realistic, pessimistic and
    optimistic quantities and the trend (half-to-even), with a date label."""
    f = future_rows(fc)
    rnd = lambda c: F.bround(c, 0).cast("long")
    return f.select(
        *SCOPE, "ds", F.date_format("ds", "yyyy-MM-dd (EEEE)").alias("date_label"),
        rnd(F.greatest(F.col("yhat_lower"), F.lit(0.0))).alias("pessimistic"),
        rnd(F.col("yhat")).alias("realistic"),
        rnd(F.greatest(F.col("yhat_upper"), F.lit(0.0))).alias("optimistic"),
        rnd(F.col("trend")).alias("trend"))


def first_forecast_days(fc: DataFrame, n: int = 10) -> DataFrame:
    """the first ``n`` horizon days per scope (report table)."""
    rk = F.row_number().over(Window.partitionBy(*SCOPE).orderBy("ds"))
    return (future_rows(fc).withColumn("day", rk).filter(F.col("day") <= n)
            .select(*SCOPE, "day", "ds", "yhat", "yhat_lower", "yhat_upper"))


def forecast_kpis(fc: DataFrame, daily: DataFrame, volatility: DataFrame, horizon: int = 30) -> DataFrame:
    """J6 + J10 + J11 + J12 + J13 + J14 per scope.

    Mean and total forecast (clipped), revenue = total x weighted price,
    growth against the last ``horizon`` processed days (0 if they sum to 0),
    confidence ``(1 - volatility) x 100``, uncertainty from the rounded
    scenarios, the horizon trend (mean of the last 7 minus the first 7
    rounded realistic values), and the stock targets.
    """
    # history rows of the forecast hold the processed series, so one ordered pass over it gives all but the price
    scope = Window.partitionBy(*SCOPE)
    rows = (fc.withColumn("_rk", F.row_number().over(scope.orderBy(F.col("ds").desc())))
              .withColumn("_h", F.count_if(F.col("is_future")).over(scope)))
    f = rows.groupBy(*SCOPE).agg(*horizon_sums(horizon)).filter(F.col("total_forecast").isNotNull())
    price = daily.groupBy(*SCOPE).agg(weighted_price(F.sum("y"), F.sum("amount")).alias("weighted_price"))
    j = f.join(price, list(SCOPE)).join(volatility.select(*SCOPE, "volatility"), list(SCOPE))
    return j.select(*SCOPE, *kpi_columns(horizon))


def weighted_price(qty, amount) -> Column:
    """Amount per piece of summed quantity and amount, 0 without a quantity."""
    return F.when(qty > 0, amount.cast("double") / qty).otherwise(0.0)


def horizon_sums(horizon: int) -> list[Column]:
    """Aggregates of J6, J10, J12 and J13 over forecast rows with their place from the end (``_rk``) and the
    scope's number of horizon days (``_h``). Rows whose ``is_future`` is NULL don't count."""
    future = F.col("is_future")
    back = F.col("_rk") - F.col("_h")  # 1 for the last observed day
    rnd = {c: F.when(future, F.bround(F.greatest(F.col(c), F.lit(0.0)), 0).cast("long")) for c in ("yhat", "yhat_lower", "yhat_upper")}
    return [
        F.avg(F.when(future, F.col("yhat"))).alias("avg_forecast"), F.sum(F.when(future, F.col("yhat"))).alias("total_forecast"),
        F.avg(rnd["yhat"]).alias("_r"), F.avg(rnd["yhat_upper"]).alias("_o"), F.avg(rnd["yhat_lower"]).alias("_p"),
        (F.avg(F.when(F.col("_rk") <= 7, rnd["yhat"])) - F.avg(F.when(F.col("_rk") > F.col("_h") - 7, rnd["yhat"]))).alias("horizon_trend"),
        F.avg(F.when(~future & (back <= 30), F.col("y"))).alias("last30_mean"),
        F.sum(F.when(~future & (back <= horizon), F.col("y"))).alias("last_h_sum")]


def kpi_columns(horizon: int) -> list[Column]:
    """The forecast KPIs from ``horizon_sums``, ``weighted_price`` and ``volatility``."""
    stock = F.col("total_forecast") * 1.2
    growth = F.when(F.col("last_h_sum") > 0, (F.col("total_forecast") / F.col("last_h_sum") - 1) * 100).otherwise(0.0)
    uncertainty = F.when(F.col("_r") > 0, ((F.col("_o") - F.col("_p")) / 2) / F.col("_r") * 100).otherwise(0.0)
    return [
        F.col("avg_forecast"), F.col("total_forecast"),
        F.when(F.col("weighted_price") > 0, F.col("total_forecast") * F.col("weighted_price")).otherwise(0.0)
         .alias("forecast_revenue"),
        (F.col("avg_forecast") - F.col("last30_mean")).alias("avg_vs_last30"),
        (F.col("total_forecast") - F.col("last_h_sum")).alias("total_vs_last_h"),
        growth.alias("forecast_growth_pct"),
        ((1 - F.col("volatility")) * 100).alias("confidence_score"),
        uncertainty.alias("uncertainty_pct"),
        F.col("horizon_trend"),
        F.when(F.col("horizon_trend") > 0, "up").when(F.col("horizon_trend") < 0, "down").otherwise("flat")
         .alias("trend_direction"),
        stock.alias("stock_target"), (stock / horizon).alias("stock_per_day"),
        F.floor(stock / (horizon * 8)).cast("long").alias("transactions_per_hour")]


def forecast_monthly(fc: DataFrame, monthly: DataFrame) -> DataFrame:
    """J8 + J9 (+ K4 input): unclipped horizon forecast per calendar month.

    Revenue uses the last actual month's average price. ``growth_vs_last_pct``
    compares each forecast month with the last actual month; ``is_first`` and
    ``is_last`` mark the months the rules read.
    """
    fm = future_rows(fc).groupBy(*SCOPE, F.trunc("ds", "MM").alias("month")).agg(F.sum("yhat_raw").alias("forecast_qty"))
    last = (monthly.groupBy(*SCOPE)
                   .agg(F.max_by("qty", "month").alias("last_actual_qty"),
                        F.max_by("avg_price", "month").alias("last_actual_price")))
    w = Window.partitionBy(*SCOPE)
    return (fm.join(last, list(SCOPE))
              .select(*SCOPE, "month", "forecast_qty",
                      (F.col("forecast_qty") * F.col("last_actual_price")).alias("forecast_revenue"),
                      "last_actual_qty",
                      ((F.try_divide(F.col("forecast_qty"), F.col("last_actual_qty")) - 1) * 100)
                       .alias("growth_vs_last_pct"),
                      (F.col("month") == F.min("month").over(w)).alias("is_first"),
                      (F.col("month") == F.max("month").over(w)).alias("is_last")))


def actual_vs_forecast(recent: DataFrame, fmonthly: DataFrame) -> DataFrame:
    """G1: last actual months stacked with forecast months, tagged."""
    a = recent.select(*SCOPE, "month", F.col("qty").alias("qty"), F.lit("actual").alias("kind"))
    f = fmonthly.select(*SCOPE, "month", F.col("forecast_qty").alias("qty"), F.lit("forecast").alias("kind"))
    return a.unionByName(f)
