"""Every finding code hit and not hit on a literal indicator row."""

import pytest

from shelfcast.operators.rules import RULES, evaluate_rules

ROW = {
    "months": 6, "last_month_qty": 100.0, "prev_month_qty": 100.0, "mom_growth_pct": 0.0, "recent_price": 10.0, "early_price": 10.0,
    "last_products": 10, "mean_products": 10.0, "first_month_ratio": 1.0, "high_seasonality": False, "seasonality_std": 1.0,
    "head_tail_first_qty": 100.0, "head_tail_last_qty": 100.0, "raw_cv": 0.4, "avg_forecast_tail": 10.0, "raw_last30_mean": 10.0,
    "quality": "good", "mape": 18.0, "forecast_growth_pct": 0.0, "processed_cv": 0.4, "weekday_std": 1.0, "raw_daily_mean": 10.0,
    "lines": 100, "head_tail_first_price": 10.0, "head_tail_last_price": 10.0, "best_weekday": 2, "weak_day_gap": False,
    "weekday_min": 1.0, "top5_share_pct": 40.0, "top10_share_pct": 60.0, "growing_count": 5, "declining_count": 0, "stable_count": 10,
    "avg_ticket": 10.0, "mean_line_amount": 10.0, "confidence_score": 70.0, "data_days": 200, "horizon": 20, "uncertainty_pct": 10.0,
}

# code: indicator values that give it, and values just past the threshold that don't
CASES = {
    "monthly_drop_critical": ({"last_month_qty": 79.9}, {"last_month_qty": 80.0}),
    "monthly_drop_warning": ({"last_month_qty": 80.0}, {"last_month_qty": 90.0}),
    "price_rise": ({"recent_price": 11.51}, {"recent_price": 11.6, "months": 2}),
    "assortment_cut": ({"last_products": 6}, {"last_products": 7}),
    "forecast_up": ({"first_month_ratio": 1.31}, {"first_month_ratio": 1.3}),
    "forecast_down": ({"first_month_ratio": 0.79}, {"first_month_ratio": 0.8}),
    "high_seasonality": ({"high_seasonality": True}, {"high_seasonality": False}),
    "sales_growing": ({"head_tail_last_qty": 120.1}, {"head_tail_last_qty": 120.0}),
    "sales_declining": ({"head_tail_last_qty": 79.9}, {"head_tail_last_qty": 80.0}),
    "daily_volatility_high": ({"raw_cv": 0.51}, {"raw_cv": 0.5}),
    "forecast_above_recent": ({"avg_forecast_tail": 11.1}, {"avg_forecast_tail": 11.0}),
    "forecast_below_recent": ({"avg_forecast_tail": 8.9}, {"avg_forecast_tail": 9.0}),
    "model_quality_excellent": ({"quality": "excellent"}, {"quality": "good"}),
    "model_quality_good": ({"quality": "good"}, {"quality": "fair"}),
    "model_quality_fair": ({"quality": "fair"}, {"quality": "good"}),
    "positive_trend": ({"forecast_growth_pct": 10.1}, {"forecast_growth_pct": 10.0}),
    "negative_trend": ({"forecast_growth_pct": -10.1}, {"forecast_growth_pct": -10.0}),
    "stable_trend": ({"forecast_growth_pct": 10.0}, {"forecast_growth_pct": 10.1}),
    "low_volatility": ({"processed_cv": 0.19}, {"processed_cv": 0.2}),
    "high_volatility": ({"processed_cv": 0.51}, {"processed_cv": 0.5}),
    "high_accuracy": ({"mape": 14.9}, {"mape": 15.0}),
    "moderate_accuracy": ({"mape": 25.1}, {"mape": 25.0}),
    "uneven_weekdays": ({"weekday_std": 3.1}, {"weekday_std": 3.0}),
    "prices_rising": ({"head_tail_last_price": 11.1}, {"head_tail_last_price": 11.1, "lines": 29}),
    "prices_falling": ({"head_tail_last_price": 8.9}, {"head_tail_last_price": 9.0}),
    "prices_stable": ({"head_tail_last_price": 9.0}, {"head_tail_last_price": 8.9}),
    "weekend_peak": ({"best_weekday": 5}, {"best_weekday": 4}),
    "weekday_peak": ({"best_weekday": 4}, {"best_weekday": 6}),
    "weak_days_promo": ({"weak_day_gap": True}, {"weak_day_gap": False}),
    "promo_campaign": ({"forecast_growth_pct": -0.1}, {"forecast_growth_pct": 0.0}),
    "just_in_time": ({"processed_cv": 0.29}, {"processed_cv": 0.3}),
    "buffer_stock": ({"processed_cv": 0.3}, {"processed_cv": 0.29}),
    "priority_scale": ({"forecast_growth_pct": 15.1}, {"forecast_growth_pct": 15.0}),
    "priority_crisis": ({"forecast_growth_pct": -15.1}, {"forecast_growth_pct": -15.0}),
    "priority_stabilise": ({"processed_cv": 0.51}, {"processed_cv": 0.51, "forecast_growth_pct": 16.0}),
    "priority_optimise": ({"processed_cv": 0.5}, {"processed_cv": 0.51}),
    "concentration_risk": ({"top5_share_pct": 50.1}, {"top5_share_pct": 50.0}),
    "balanced_portfolio": ({"top5_share_pct": 50.0}, {"top5_share_pct": 50.1}),
    "top10_concentration_risk": ({"top10_share_pct": 70.1}, {"top10_share_pct": 70.0}),
    "top10_normal": ({"top10_share_pct": 70.0}, {"top10_share_pct": 70.1}),
    "many_growing": ({"growing_count": 11}, {"growing_count": 10}),
    "few_growing": ({"growing_count": 10}, {"growing_count": 11}),
    "declining_critical": ({"declining_count": 11}, {"declining_count": 10}),
    "declining_attention": ({"declining_count": 1}, {"declining_count": 11}),
    "declining_none": ({"declining_count": 0}, {"declining_count": 1}),
    "many_stable": ({"stable_count": 21}, {"stable_count": 20}),
    "few_stable": ({"stable_count": 20}, {"stable_count": 21}),
    "low_ticket": ({"avg_ticket": 7.9}, {"avg_ticket": 8.0}),
    "ticket_normal": ({"avg_ticket": 8.0}, {"avg_ticket": 7.9}),
    "confidence_excellent": ({"confidence_score": 80.0}, {"confidence_score": 79.9}),
    "confidence_good": ({"confidence_score": 60.0}, {"confidence_score": 80.0}),
    "confidence_improve": ({"confidence_score": 59.9}, {"confidence_score": 60.0}),
    "short_history": ({"data_days": 89}, {"data_days": 90}),
    "seasonal_data": ({"lines": 366}, {"lines": 365}),
    "horizon_short": ({"horizon": 14}, {"horizon": 15}),
    "horizon_medium": ({"horizon": 30}, {"horizon": 31}),
    "horizon_long": ({"horizon": 31}, {"horizon": 30}),
    "buffer_none": ({"mape": 9.9}, {"mape": 10.0}),
    "buffer_10_15": ({"mape": 10.0}, {"mape": 20.0}),
    "buffer_20_30": ({"mape": 20.0}, {"mape": 19.9}),
    "interval_confident": ({"uncertainty_pct": 19.9}, {"uncertainty_pct": 20.0}),
    "interval_needs_buffer": ({"uncertainty_pct": 20.0}, {"uncertainty_pct": 19.9}),
}


@pytest.fixture(scope="module")
def hits(spark):
    rows = [{"store": code, "segment": kind, **ROW, **values}
            for code, pair in CASES.items() for kind, values in zip(("hit", "miss"), pair)]
    found = evaluate_rules(spark.createDataFrame(rows)).collect()
    return {(r.store, r.segment, r.rule_code) for r in found}


def test_every_code_has_a_case():
    assert sorted(CASES) == sorted(r.code for r in RULES)


@pytest.mark.parametrize("code", sorted(CASES))
def test_code(hits, code):
    assert (code, "hit", code) in hits and (code, "miss", code) not in hits
