"""Threshold findings as rows.

Every scope that can be forecast gets one indicator row (the profile of its
daily series and forecast, monthly summary, first/last sale lines, product KPIs). Each rule is a boolean condition over that row; the
hits are exploded into ``(store, segment, family, rule_code, severity,
value)``. The conditions are SQL expressions over the indicator columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.scope import SCOPE


@dataclass(frozen=True)
class Rule:
    family: str
    code: str
    severity: str
    condition: str
    value: str


# Rule thresholds. First match wins inside a family only where
# the conditions say so explicitly (``not`` of the earlier ones).
RULES = (
    Rule("K1", "monthly_drop_critical", "critical", "months >= 2 and last_month_qty < prev_month_qty * 0.8", "mom_growth_pct"),
    Rule("K1", "monthly_drop_warning", "warning",
         "months >= 2 and last_month_qty >= prev_month_qty * 0.8 and last_month_qty < prev_month_qty * 0.9", "mom_growth_pct"),
    Rule("K2", "price_rise", "warning", "months >= 3 and recent_price > early_price * 1.15", "recent_price / early_price"),
    Rule("K3", "assortment_cut", "warning", "months >= 2 and last_products < mean_products * 0.7", "last_products"),
    Rule("K4", "forecast_up", "info", "first_month_ratio > 1.3", "first_month_ratio"),
    Rule("K4", "forecast_down", "warning", "first_month_ratio < 0.8", "first_month_ratio"),
    Rule("K5", "high_seasonality", "info", "high_seasonality", "seasonality_std"),
    Rule("K6", "sales_growing", "info", "head_tail_last_qty > head_tail_first_qty * 1.2", "head_tail_last_qty"),
    Rule("K6", "sales_declining", "warning",
         "head_tail_last_qty <= head_tail_first_qty * 1.2 and head_tail_last_qty < head_tail_first_qty * 0.8",
         "head_tail_last_qty"),
    Rule("K6", "daily_volatility_high", "warning", "raw_cv > 0.5", "raw_cv"),
    Rule("K6", "forecast_above_recent", "info", "avg_forecast_tail > raw_last30_mean * 1.1", "avg_forecast_tail"),
    Rule("K6", "forecast_below_recent", "info",
         "avg_forecast_tail <= raw_last30_mean * 1.1 and avg_forecast_tail < raw_last30_mean * 0.9", "avg_forecast_tail"),
    Rule("K7", "model_quality_excellent", "info", "quality = 'excellent'", "mape"),
    Rule("K7", "model_quality_good", "info", "quality = 'good'", "mape"),
    Rule("K7", "model_quality_fair", "warning", "quality = 'fair'", "mape"),
    Rule("K8", "positive_trend", "success", "forecast_growth_pct > 10", "forecast_growth_pct"),
    Rule("K8", "negative_trend", "error", "forecast_growth_pct < -10", "forecast_growth_pct"),
    Rule("K8", "stable_trend", "info", "forecast_growth_pct between -10 and 10", "forecast_growth_pct"),
    Rule("K8", "low_volatility", "success", "processed_cv < 0.2", "processed_cv"),
    Rule("K8", "high_volatility", "warning", "processed_cv > 0.5", "processed_cv"),
    Rule("K8", "high_accuracy", "success", "mape < 15", "mape"),
    Rule("K8", "moderate_accuracy", "warning", "mape > 25", "mape"),
    Rule("K8", "uneven_weekdays", "info", "weekday_std > raw_daily_mean * 0.3", "weekday_std"),
    Rule("K9", "prices_rising", "info", "lines >= 30 and head_tail_last_price > head_tail_first_price * 1.1",
         "head_tail_last_price"),
    Rule("K9", "prices_falling", "info",
         "lines >= 30 and head_tail_last_price <= head_tail_first_price * 1.1 "
         "and head_tail_last_price < head_tail_first_price * 0.9", "head_tail_last_price"),
    Rule("K9", "prices_stable", "info",
         "lines >= 30 and head_tail_last_price <= head_tail_first_price * 1.1 "
         "and head_tail_last_price >= head_tail_first_price * 0.9", "head_tail_last_price"),
    Rule("K10", "weekend_peak", "info", "best_weekday in (5, 6)", "best_weekday"),
    Rule("K10", "weekday_peak", "info", "best_weekday not in (5, 6)", "best_weekday"),
    Rule("K10", "weak_days_promo", "info", "weak_day_gap", "weekday_min"),
    Rule("K10", "promo_campaign", "warning", "forecast_growth_pct < 0", "forecast_growth_pct"),
    Rule("K10", "just_in_time", "info", "processed_cv < 0.3", "processed_cv"),
    Rule("K10", "buffer_stock", "info", "processed_cv >= 0.3", "processed_cv"),
    Rule("K11", "priority_scale", "success", "forecast_growth_pct > 15", "forecast_growth_pct"),
    Rule("K11", "priority_crisis", "error", "forecast_growth_pct < -15", "forecast_growth_pct"),
    Rule("K11", "priority_stabilise", "warning",
         "forecast_growth_pct between -15 and 15 and processed_cv > 0.5", "processed_cv"),
    Rule("K11", "priority_optimise", "info",
         "forecast_growth_pct between -15 and 15 and processed_cv <= 0.5", "forecast_growth_pct"),
    Rule("K12", "concentration_risk", "warning", "top5_share_pct > 50", "top5_share_pct"),
    Rule("K12", "top10_concentration_risk", "warning", "top10_share_pct > 70", "top10_share_pct"),
    Rule("K12", "many_growing", "success", "growing_count > 10", "growing_count"),
    Rule("K12", "declining_critical", "critical", "declining_count > 10", "declining_count"),
    Rule("K12", "declining_attention", "warning", "declining_count between 1 and 10", "declining_count"),
    Rule("K12", "many_stable", "success", "stable_count > 20", "stable_count"),
    Rule("K12", "balanced_portfolio", "success", "top5_share_pct <= 50", "top5_share_pct"),
    Rule("K12", "top10_normal", "success", "top10_share_pct <= 70", "top10_share_pct"),
    Rule("K12", "few_growing", "warning", "growing_count <= 10", "growing_count"),
    Rule("K12", "declining_none", "success", "declining_count = 0", "declining_count"),
    Rule("K12", "few_stable", "warning", "stable_count <= 20", "stable_count"),
    Rule("K12", "ticket_normal", "success", "avg_ticket >= mean_line_amount * 0.8", "avg_ticket"),
    Rule("K12", "low_ticket", "info", "avg_ticket < mean_line_amount * 0.8", "avg_ticket"),
    Rule("K13", "confidence_excellent", "success", "confidence_score >= 80", "confidence_score"),
    Rule("K13", "confidence_good", "warning", "confidence_score >= 60 and confidence_score < 80", "confidence_score"),
    Rule("K13", "confidence_improve", "error", "confidence_score < 60", "confidence_score"),
    Rule("K14", "short_history", "info", "data_days < 90", "data_days"),
    Rule("K14", "seasonal_data", "info", "lines > 365", "lines"),
    Rule("K15", "horizon_short", "info", "horizon <= 14", "horizon"),
    Rule("K15", "horizon_medium", "info", "horizon > 14 and horizon <= 30", "horizon"),
    Rule("K15", "horizon_long", "info", "horizon > 30", "horizon"),
    Rule("K15", "buffer_none", "success", "mape < 10", "mape"),
    Rule("K15", "buffer_10_15", "info", "mape >= 10 and mape < 20", "mape"),
    Rule("K15", "buffer_20_30", "warning", "mape >= 20", "mape"),
    Rule("K15", "interval_confident", "success", "uncertainty_pct < 20", "uncertainty_pct"),
    Rule("K15", "interval_needs_buffer", "warning", "uncertainty_pct >= 20", "uncertainty_pct"),
)


def indicators(profile: DataFrame, *, monthly_summary: DataFrame, seasonality: DataFrame, fmonthly: DataFrame,
               line_sums: DataFrame, pkpis: DataFrame, skpis: DataFrame, horizon: int) -> DataFrame:
    """One row per scope of ``profile`` (``operators.profile``) with every column a rule reads."""
    k = list(SCOPE)
    pf = profile.select(*k, F.lit(True).alias("_wanted"), "raw_cv", "raw_daily_mean", "raw_last30_mean",
                        "forecast_growth_pct", "confidence_score", "uncertainty_pct", "avg_forecast_tail",
                        "processed_cv", "mape", "quality", "best_weekday", "weekday_std", "weekday_min",
                        "weak_day_gap", "data_days")
    ms = monthly_summary.select(*k, "months", F.col("last_qty").alias("last_month_qty"),
                                F.col("prev_qty").alias("prev_month_qty"), "mom_growth_pct",
                                "recent_price", "early_price", "last_products", "mean_products")
    se = seasonality.select(*k, "seasonality_std", "high_seasonality")
    fm = (fmonthly.filter("is_first")
                  .select(*k, F.try_divide(F.col("forecast_qty"), F.col("last_actual_qty")).alias("first_month_ratio")))
    lw = line_sums.select(*k, "lines", F.col("first_qty").alias("head_tail_first_qty"),
                          F.col("last_qty").alias("head_tail_last_qty"),
                          F.col("first_price").alias("head_tail_first_price"),
                          F.col("last_price").alias("head_tail_last_price"))
    pk = pkpis.select(*k, "top5_share_pct", "top10_share_pct", "growing_count", "declining_count", "stable_count")
    sk = skpis.select(*k, "avg_ticket", "mean_line_amount")
    # every part has at most one row per scope: stacked and combined in one shuffle, not joined one by one
    parts = [pf, ms, se, fm, lw, pk, sk]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    out = stacked.groupBy(*k).agg(*[F.max(c).alias(c) for c in stacked.columns if c not in k])
    return out.filter("_wanted").drop("_wanted").withColumn("horizon", F.lit(horizon))


def evaluate_rules(ind: DataFrame, rules=RULES) -> DataFrame:
    """Explode the rule hits of every scope into rows."""
    hits = F.array(*[
        F.when(F.expr(r.condition), F.struct(F.lit(r.family).alias("family"), F.lit(r.code).alias("rule_code"),
                                             F.lit(r.severity).alias("severity"),
                                             F.expr(r.value).cast("double").alias("value")))
        for r in rules])
    return (ind.select(*SCOPE, F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("hit"))
               .select(*SCOPE, "hit.family", "hit.rule_code", "hit.severity", "hit.value"))
