"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each one reads the driver's tables through the ``sales`` view (or the dirty
text fixture for the ingest operators), so its work grows with the tables.
Shared intermediates come from a ``SalesContext`` (checkpointed in the forecast and rule queries, so the
branches of one query, and frames derived from it, read the daily series once). Decimal
outputs are cast to DOUBLE at the very end.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.operators import elasticity as el
from shelfcast.operators import forecast as fo
from shelfcast.operators import fourier as fu
from shelfcast.operators import monthly as mo
from shelfcast.operators import products as pr
from shelfcast.operators import profile as pf
from shelfcast.operators import rules as ru
from shelfcast.operators import scope as sc
from shelfcast.operators import series as se
from shelfcast.operators import weekday as wk
from shelfcast.plans.context import SalesContext
from shelfcast.plans.refresh import read_cube, refresh_cube
from shelfcast.session import ensure_checkpoint_dir
from shelfcast.sources import sales as src
from shelfcast.sources import snapshot, tpch
from shelfcast.streaming.ingest import start_ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
HORIZON = 30
LINE_ORDER = ["sale_date", *tpch.LINE_KEY]


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def finish(df: DataFrame) -> DataFrame:
    """Cast decimals to DOUBLE for output."""
    cols = [F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tpch.sales_view(spark, sf_dir)


# Intermediates that the forecast and the rule queries read in several branches
# (measured at sf0.1: keeping only these beats keeping the whole chain).
FORECAST_KEEP = frozenset({"daily", "forecast"})
# The rules read the lines three times: for the sums per model and day, for the
# articles of each month, and for the ends of the lines.
RULE_KEEP = frozenset({"model_days", "daily", "forecast", "monthly", "trend", "ends"})


def ctx(spark: SparkSession, sf_dir: str, keep: str | None = None,
        only: frozenset[str] | None = FORECAST_KEEP, horizon: int = HORIZON) -> SalesContext:
    """Context over the sales view. ``keep="checkpoint"`` for plans that read the
    daily series, model or forecast in many branches; plans that read them
    once or twice recompute instead."""
    return SalesContext(tpch.sales_view(spark, sf_dir, with_keys=True), se.Prep(), horizon, LINE_ORDER,
                        keep=keep, only=only if keep else None)


def kept(spark: SparkSession, sf_dir: str, build: Callable[[SalesContext], DataFrame], **options) -> DataFrame:
    """``build`` on a context that keeps intermediates as reliable checkpoints.

    The result and every frame derived from it read them; Spark deletes their
    files when no plan refers to them any more.
    """
    return build(ctx(spark, sf_dir, "checkpoint", **options))


# ---- A: sources and validation -------------------------------------------

@query("load_sales")
def q_load_sales(spark, sf_dir):
    return finish(src.load_sales(tpch.dirty_source(spark, sf_dir)))


@query("rejection_counts")
def q_rejection_counts(spark, sf_dir):
    r = src.rejection_reasons(tpch.dirty_source(spark, sf_dir))
    return (r.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome"))
             .agg(F.count(F.lit(1)).alias("lines")))


@query("read_snapshot")
def q_read_snapshot(spark, sf_dir):
    """Validated table written as a month-partitioned snapshot, read back."""
    path = _scratch(spark, "snapshots", sf_dir)
    src.write_snapshot(src.load_sales(tpch.dirty_source(spark, sf_dir)), path)
    return finish(src.read_snapshot(spark, path))


@query("csv_line_outcomes")
def q_csv_line_outcomes(spark, sf_dir):
    """A1-A5 on CSV files with lines of too many or too few cells: every line by its outcome."""
    path = _scratch(spark, "csv_lines", sf_dir)
    tpch.write_dirty_lines(spark, sf_dir, path)
    src.ingest(src.read_sales(spark, path), f"{path}-snapshot")
    return src.reconciliation(spark, f"{path}-snapshot")


@query("snapshot_batch_and_stream")
def q_snapshot_batch_and_stream(spark, sf_dir):
    """A part of the export written as a snapshot by a batch job, the rest added by the stream, all read back.

    The stream takes its files in four to seven turns, and its small commits are compacted on the way.
    """
    path = _scratch(spark, "shared_snapshots", sf_dir)
    rows = tpch.dirty_source(spark, sf_dir)
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(3))
    src.write_snapshot(src.load_sales(rows.filter(part == 0)), path)
    files = f"{path}-files"
    # every task writes its own lines, into four folders: at least four files also where there is one task
    deal = F.pmod(F.xxhash64(F.lit("deal"), *rows.columns), F.lit(4))
    rows.filter(part > 0).withColumn("deal", deal).write.partitionBy("deal").option("header", True).csv(files)
    written = snapshot.count_files(spark, files, ".csv")
    start_ingest(spark, f"{files}/deal=*", path, f"{path}-offsets", max_files_per_trigger=max(1, written // 4),
                 fanin=4).awaitTermination()
    return finish(src.read_snapshot(spark, path))


@query("refreshed_monthly_sales")
def q_refreshed_monthly_sales(spark, sf_dir):
    """D6 from a cube that was refreshed after the snapshot had grown.

    The snapshot gets the lines before 1996, then the rest; the second refresh
    combines the months of the second commit only.
    """
    path = _scratch(spark, "refreshed", sf_dir)
    lines, early = sales(spark, sf_dir), F.col("sale_date") < F.lit("1996-01-01").cast("date")
    for part in (early, ~early):
        src.write_snapshot(lines.filter(part), path, append=True)
        refresh_cube(spark, path, f"{path}-cube")
    return SalesContext(src.read_snapshot(spark, path), keep=None, facts=read_cube(spark, f"{path}-cube")).monthly


def _scratch(spark: SparkSession, kind: str, sf_dir: str) -> str:
    """A folder of this call's own in the shared folder."""
    return os.path.join(ensure_checkpoint_dir(spark), kind, f"{os.path.basename(sf_dir.rstrip('/'))}-{uuid.uuid4().hex}")


@query("read_sales_csv")
def q_read_sales_csv(spark, sf_dir):
    """A1: the dirty export written as CSV text and read back through ``read_sales``."""
    path = _scratch(spark, "csv_exports", sf_dir)
    tpch.dirty_source(spark, sf_dir).write.mode("overwrite").option("header", True).csv(path)
    return finish(src.load_sales(src.read_sales(spark, path, "csv")))


@query("events_daily_sales")
def q_events_daily_sales(spark, sf_dir):
    """A4 + D2 on intraday timestamps: one row per calendar day, not per event."""
    s = src.load_sales(tpch.events_source(spark, sf_dir))
    return finish(SalesContext(s, keep=None).daily)


# ---- B: scopes -----------------------------------------------------------

@query("list_stores")
def q_list_stores(spark, sf_dir):
    return sc.list_stores(sales(spark, sf_dir))


@query("list_segments")
def q_list_segments(spark, sf_dir):
    return sc.list_segments(sales(spark, sf_dir))


ONE_STORE = "NATION_12"


@query("filter_scope")
def q_filter_scope(spark, sf_dir):
    """B1: the lines of one store and one segment."""
    return finish(sc.filter_scope(sales(spark, sf_dir), ONE_STORE, "PROMO"))


@query("segments_of_store")
def q_segments_of_store(spark, sf_dir):
    return sc.list_segments(sales(spark, sf_dir), ONE_STORE)


@query("min_rows_guard")
def q_min_rows_guard(spark, sf_dir):
    return ctx(spark, sf_dir).guard


# ---- D2/E: daily series --------------------------------------------------

@query("daily_sales")
def q_daily_sales(spark, sf_dir):
    return finish(ctx(spark, sf_dir).daily)


def _prepared(spark, sf_dir, prep):
    return se.prepare_series(ctx(spark, sf_dir).daily, prep)


@query("winsorize_iqr")
def q_winsorize(spark, sf_dir):
    return _prepared(spark, sf_dir, se.Prep(remove_outliers=True))


@query("moving_average")
def q_moving_average(spark, sf_dir):
    return _prepared(spark, sf_dir, se.Prep(remove_outliers=True, method="ma", window=7))


@query("ema")
def q_ema(spark, sf_dir):
    return _prepared(spark, sf_dir, se.Prep(remove_outliers=False, method="ema", window=7))


@query("savgol")
def q_savgol(spark, sf_dir):
    return _prepared(spark, sf_dir, se.Prep(remove_outliers=False, method="savgol", window=7))


@query("daily_average")
def q_daily_average(spark, sf_dir):
    return se.daily_average(ctx(spark, sf_dir).daily)


@query("segment_volatility")
def q_segment_volatility(spark, sf_dir):
    return ctx(spark, sf_dir).volatility


@query("series_stats")
def q_series_stats(spark, sf_dir):
    return se.series_stats(_prepared(spark, sf_dir, se.Prep(method="ma", window=7)))


@query("history_stats")
def q_history_stats(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return se.history_stats(c.daily, se.prepare_series(c.daily))


@query("last_30_days")
def q_last_30_days(spark, sf_dir):
    return se.last_30_days(ctx(spark, sf_dir).daily)


@query("last_n_observations")
def q_last_n(spark, sf_dir):
    return se.last_n_observations(_prepared(spark, sf_dir, se.Prep()), 30)


# ---- D6-D11, E7, E12, F8: months ----------------------------------------

@query("monthly_sales")
def q_monthly_sales(spark, sf_dir):
    return ctx(spark, sf_dir).monthly


@query("monthly_summary")
def q_monthly_summary(spark, sf_dir):
    return mo.monthly_summary(ctx(spark, sf_dir).monthly)


@query("monthly_seasonality")
def q_monthly_seasonality(spark, sf_dir):
    return mo.monthly_seasonality(ctx(spark, sf_dir).monthly)


@query("recent_months")
def q_recent_months(spark, sf_dir):
    return mo.recent_months(ctx(spark, sf_dir).monthly, 6)


# ---- D12-D16: weekdays ----------------------------------------------------

@query("weekday_sales")
def q_weekday_sales(spark, sf_dir):
    return wk.weekday_sales(ctx(spark, sf_dir).daily)


@query("weekday_extremes")
def q_weekday_extremes(spark, sf_dir):
    return wk.weekday_extremes(wk.weekday_sales(ctx(spark, sf_dir).daily))


@query("weekday_strength")
def q_weekday_strength(spark, sf_dir):
    return wk.weekday_strength(wk.weekday_sales(ctx(spark, sf_dir).daily))


@query("week_weekday_matrix")
def q_week_weekday_matrix(spark, sf_dir):
    return wk.week_weekday_matrix(ctx(spark, sf_dir).daily)


# ---- H1-H4, E8-E10, C1, D1, D18-D25, F1-F6: products ----------------------

@query("product_trend")
def q_product_trend(spark, sf_dir):
    return ctx(spark, sf_dir).trend


@query("align_periods")
def q_align_periods(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return pr.align_periods(c.facts, c.daily)


@query("abc_classify")
def q_abc_classify(spark, sf_dir):
    return pr.abc_classify(ctx(spark, sf_dir).trend)


@query("abc_summary")
def q_abc_summary(spark, sf_dir):
    return pr.abc_summary(pr.abc_classify(ctx(spark, sf_dir).trend))


@query("top_class_a")
def q_top_class_a(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return pr.top_class_a(pr.abc_classify(c.trend), c.daily, 10)


@query("top_by_revenue")
def q_top_by_revenue(spark, sf_dir):
    return pr.top_by_revenue(ctx(spark, sf_dir).trend, 20)


@query("top_stable")
def q_top_stable(spark, sf_dir):
    return pr.top_stable(ctx(spark, sf_dir).trend, 20)


@query("top_declining")
def q_top_declining(spark, sf_dir):
    return pr.top_declining(ctx(spark, sf_dir).trend, 20)


@query("product_kpis")
def q_product_kpis(spark, sf_dir):
    return pr.product_kpis(ctx(spark, sf_dir).trend)


@query("top_models_by_segment")
def q_top_models_by_segment(spark, sf_dir):
    return pr.top_models_by_segment(ctx(spark, sf_dir).facts, 10)


@query("scope_kpis")
def q_scope_kpis(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return pr.scope_kpis(c.facts, c.daily)


@query("dataset_overview")
def q_dataset_overview(spark, sf_dir):
    return pr.dataset_overview(ctx(spark, sf_dir).facts)


@query("line_window_sums")
def q_line_window_sums(spark, sf_dir):
    return ctx(spark, sf_dir).line_sums


# ---- H5-H8, F7, C3: elasticity -------------------------------------------

def _elasticity(spark, sf_dir):
    return el.price_elasticity(el.price_bins(sales(spark, sf_dir)))


@query("price_bins")
def q_price_bins(spark, sf_dir):
    b = el.price_bins(sales(spark, sf_dir))
    return finish(b.groupBy("model", "bins", "edge_low", "edge_high").agg(
        F.sum("lines").alias("lines"),
        F.sum(F.when(F.col("price_bin") == "low", F.col("lines"))).alias("low_lines"),
        F.sum(F.when(F.col("price_bin") == "mid", F.col("lines"))).alias("mid_lines"),
        F.sum(F.when(F.col("price_bin") == "high", F.col("lines"))).alias("high_lines")))


@query("price_elasticity")
def q_price_elasticity(spark, sf_dir):
    return _elasticity(spark, sf_dir)


@query("elasticity_summary")
def q_elasticity_summary(spark, sf_dir):
    return el.elasticity_summary(_elasticity(spark, sf_dir))


@query("top_elasticity")
def q_top_elasticity(spark, sf_dir):
    return el.top_elasticity(_elasticity(spark, sf_dir), 20)


# ---- J, B6, C2, F9, G1: forecasts -----------------------------------------

@query("forecast_seasonal_index")
def q_forecast(spark, sf_dir):
    return kept(spark, sf_dir, lambda c: c.forecast)


@query("seasonal_coefficients")
def q_seasonal_coefficients(spark, sf_dir):
    return kept(spark, sf_dir, lambda c: c.model.coef)


@query("future_frame")
def q_future_frame(spark, sf_dir):
    return kept(spark, sf_dir, lambda c: fo.future_frame(c.model.coef, HORIZON))


@query("future_rows")
def q_future_rows(spark, sf_dir):
    return kept(spark, sf_dir, lambda c: fo.future_rows(c.forecast))


@query("actual_vs_fitted")
def q_actual_vs_fitted(spark, sf_dir):
    return kept(spark, sf_dir, lambda c: fo.actual_vs_fitted(c.prepared, c.forecast))


@query("forecast_accuracy")
def q_forecast_accuracy(spark, sf_dir):
    return kept(spark, sf_dir, lambda c: fo.accuracy(c.pairs))


@query("forecast_scenarios")
def q_forecast_scenarios(spark, sf_dir):
    return kept(spark, sf_dir, lambda c: fo.scenarios(c.forecast))


@query("first_forecast_days")
def q_first_forecast_days(spark, sf_dir):
    return kept(spark, sf_dir, lambda c: fo.first_forecast_days(c.forecast, 10))


@query("forecast_kpis")
def q_forecast_kpis(spark, sf_dir):
    return kept(spark, sf_dir, lambda c: c.forecast_kpis)


@query("forecast_monthly")
def q_forecast_monthly(spark, sf_dir):
    return kept(spark, sf_dir, lambda c: c.forecast_monthly)


@query("actual_vs_forecast")
def q_actual_vs_forecast(spark, sf_dir):
    return kept(spark, sf_dir, lambda c: fo.actual_vs_forecast(mo.recent_months(c.monthly, 6), c.forecast_monthly))


@query("forecast_csv_export")
def q_forecast_csv_export(spark, sf_dir):
    """The per-day forecast of every scope exported as CSV and read back."""
    path = _scratch(spark, "forecast_csv", sf_dir)
    sc_df = kept(spark, sf_dir, lambda c: fo.scenarios(c.forecast))
    src.export_forecast_csv(sc_df, path)
    return spark.read.schema(sc_df.schema).option("header", True).csv(path)


@query("forecast_fourier")
def q_forecast_fourier(spark, sf_dir):
    return kept(spark, sf_dir, lambda c: fu.forecast_fourier(c.prepared, HORIZON))


# ---- K: rules ---------------------------------------------------------------

def rule_indicators(c: SalesContext) -> DataFrame:
    return ru.indicators(
        pf.scope_profile(c.daily, c.forecast, c.horizon),
        monthly_summary=mo.monthly_summary(c.monthly), seasonality=mo.monthly_seasonality(c.monthly),
        fmonthly=c.forecast_monthly, line_sums=c.line_sums,
        pkpis=pr.product_kpis(c.trend), skpis=pr.scope_kpis(c.facts, c.daily, c.model_days), horizon=c.horizon)


@query("rule_hits")
def q_rule_hits(spark, sf_dir):
    return kept(spark, sf_dir, lambda c: ru.evaluate_rules(rule_indicators(c)), only=RULE_KEEP)


@query("rule_hits_h60")
def q_rule_hits_h60(spark, sf_dir):
    """Horizon 60: the forecast rules read the last 30 of its days."""
    return kept(spark, sf_dir, lambda c: ru.evaluate_rules(rule_indicators(c)), only=RULE_KEEP, horizon=60)
