"""The full report for every scope, as one Spark application.

    python -m shelfcast.plans.report --sales <path> [--format csv|parquet] --out <dir>

Reads and validates the sales table (A1-A6), writes the month-partitioned
snapshot (A7), builds the shared intermediates with reliable checkpoints in
``spark.checkpoint.dir`` (lineage is cut after the fact cube, the daily and
prepared series, the model fit and the forecast, so a lost executor costs a
re-read of a checkpoint, not a re-scan of the sales), then writes every
output table as Parquet and the per-day forecast as CSV (A8).
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession

from shelfcast.operators import elasticity as el
from shelfcast.operators import forecast as fo
from shelfcast.operators import monthly as mo
from shelfcast.operators import products as pr
from shelfcast.operators import rules as ru
from shelfcast.operators import series as se
from shelfcast.operators import weekday as wk
from shelfcast.operators.scope import filter_scope
from shelfcast.plans.context import SalesContext
from shelfcast.session import ensure_checkpoint_dir
from shelfcast.sources import sales as src


def report_tables(c: SalesContext) -> dict[str, DataFrame]:
    """Every output of one run, keyed by table name (lazy)."""
    from shelfcast.plans.catalog import rule_indicators
    monthly = c.monthly
    trend = c.trend
    abc = pr.abc_classify(trend)
    elastic = el.price_elasticity(el.price_bins(c.sales))
    weekdays = wk.weekday_sales(c.daily)
    return {
        "dataset_overview": pr.dataset_overview(c.facts),
        "daily_sales": c.daily,
        "prepared_series": c.prepared,
        "series_stats": se.series_stats(c.prepared),
        "history_stats": se.history_stats(c.daily, c.prepared),
        "segment_volatility": c.volatility,
        "monthly_sales": monthly,
        "monthly_summary": mo.monthly_summary(monthly),
        "monthly_seasonality": mo.monthly_seasonality(monthly),
        "weekday_sales": weekdays,
        "weekday_extremes": wk.weekday_extremes(weekdays),
        "weekday_strength": wk.weekday_strength(weekdays),
        "week_weekday_matrix": wk.week_weekday_matrix(c.daily),
        "product_trend": trend,
        "abc_classify": abc,
        "abc_summary": pr.abc_summary(abc),
        "top_class_a": pr.top_class_a(abc, c.daily),
        "top_by_revenue": pr.top_by_revenue(trend),
        "top_stable": pr.top_stable(trend),
        "top_declining": pr.top_declining(trend),
        "product_kpis": pr.product_kpis(trend),
        "top_models_by_segment": pr.top_models_by_segment(c.facts),
        "scope_kpis": pr.scope_kpis(c.facts, c.daily),
        "price_elasticity": elastic,
        "elasticity_summary": el.elasticity_summary(elastic),
        **({"seasonal_coefficients": c.model.coef} if c.method == "seasonal" else {}),
        "forecast": c.forecast,
        "forecast_accuracy": fo.accuracy(c.pairs),
        "forecast_scenarios": fo.scenarios(c.forecast),
        "forecast_kpis": c.forecast_kpis,
        "forecast_monthly": c.forecast_monthly,
        "actual_vs_forecast": fo.actual_vs_forecast(mo.recent_months(monthly, 6), c.forecast_monthly),
        "rule_hits": ru.evaluate_rules(rule_indicators(c)),
    }


def run_report(spark: SparkSession, sales: DataFrame, out_dir: str, prep: se.Prep = se.Prep(),
               horizon: int = 30, snapshot: bool = True, store: str | None = None, segment: str | None = None,
               method: str = "seasonal") -> list[str]:
    """Write all report tables under ``out_dir``; return their names.

    ``store`` / ``segment`` restrict the run to one selection; ``method``
    ``fourier`` takes the forecast and all that follows from it from J1b.
    """
    ensure_checkpoint_dir(spark)
    if snapshot:
        snap = os.path.join(out_dir, "snapshot")
        src.write_snapshot(sales, snap)
        sales = src.read_snapshot(spark, snap)
    sales = filter_scope(sales, store, segment)
    c = SalesContext(sales, prep, horizon, keep="checkpoint", method=method)
    tables = report_tables(c)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(out_dir, name))
    src.export_forecast_csv(
        fo.scenarios(c.forecast).join(fo.future_rows(c.forecast).select("store", "segment", "ds", "yhat"),
                                      ["store", "segment", "ds"]),
        os.path.join(out_dir, "forecast_csv"))
    return sorted(tables)


def main(argv=None):
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--sales", required=True)
    ap.add_argument("--format", default="csv", choices=["csv", "parquet"])
    ap.add_argument("--out", required=True)
    ap.add_argument("--horizon", type=int, default=30)
    ap.add_argument("--smooth", default=None, choices=[None, "ma", "ema", "savgol"])
    ap.add_argument("--window", type=int, default=7)
    ap.add_argument("--keep-outliers", action="store_true")
    ap.add_argument("--store", default=None)
    ap.add_argument("--segment", default=None)
    ap.add_argument("--method", default="seasonal", choices=["seasonal", "fourier"])
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("shelfcast-report").getOrCreate()
    sales = src.load_sales(src.read_sales(spark, a.sales, a.format))
    prep = se.Prep(remove_outliers=not a.keep_outliers, method=a.smooth, window=a.window)
    run_report(spark, sales, a.out, prep, a.horizon, store=a.store, segment=a.segment, method=a.method)


if __name__ == "__main__":
    main()
