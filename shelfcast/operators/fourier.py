"""Piecewise-linear trend x (1 + Fourier seasonality), one series per task.

``y(t) = g(t) * (1 + s(t))`` with ``g`` a linear trend plus hinge terms at 25
knots over the first 80 % of the history, and ``s`` weekly (order 3) and
yearly (order 10) Fourier terms, as in the reference's model settings. Both
parts are ridge regressions solved alternately (a few rounds); the ridge
weights play the role of the trend-change and seasonality prior scales.

Spark groups the daily rows by scope and runs ``fit_one`` per group with
``applyInPandas`` (Arrow batches). A group is one daily series, bounded by the
number of calendar days, so no group grows with the number of sales.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelfcast.operators.forecast import Z80
from shelfcast.operators.scope import SCOPE

# The per-series solver is shipped with the task by value, so Python workers
# do not need this package installed (only numpy and pandas).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Model settings.
N_KNOTS = 25
KNOT_RANGE = 0.8
WEEKLY_ORDER = 3
YEARLY_ORDER = 10
TREND_CHANGE_SCALE = 0.05
SEASONALITY_SCALE = 10.0
ROUNDS = 8

OUTPUT_SCHEMA = T.StructType([
    T.StructField("store", T.StringType()), T.StructField("segment", T.StringType()),
    T.StructField("ds", T.DateType()), T.StructField("is_future", T.BooleanType()),
    T.StructField("y", T.DoubleType()), T.StructField("trend", T.DoubleType()),
    T.StructField("yhat_raw", T.DoubleType()), T.StructField("yhat", T.DoubleType()),
    T.StructField("yhat_lower", T.DoubleType()), T.StructField("yhat_upper", T.DoubleType()),
])


def _fourier(days: np.ndarray, period: float, order: int) -> np.ndarray:
    k = np.arange(1, order + 1)
    ang = 2.0 * np.pi * np.outer(days, k) / period
    return np.hstack([np.sin(ang), np.cos(ang)])


def _seasonal_features(days: np.ndarray) -> np.ndarray:
    return np.hstack([_fourier(days, 7.0, WEEKLY_ORDER), _fourier(days, 365.25, YEARLY_ORDER)])


def _trend_basis(s: np.ndarray, knots: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones_like(s), s, np.maximum(s[:, None] - knots[None, :], 0.0)])


def _ridge(x: np.ndarray, y: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    a = x.T @ x + np.diag(penalty)
    return np.linalg.solve(a, x.T @ y)


def fit_series(days: np.ndarray, y: np.ndarray, future_days: np.ndarray):
    """Fit on (days since start, y); return (trend, yhat) for history and future, and residual sd."""
    n = len(y)
    scale = float(np.max(np.abs(y))) or 1.0
    ys = y / scale
    span = float(days[-1] - days[0]) or 1.0
    s_hist = (days - days[0]) / span
    s_fut = (future_days - days[0]) / span
    cut = max(1, int(np.floor(KNOT_RANGE * n)))
    idx = np.unique(np.arange(N_KNOTS + 1) * (cut - 1) // N_KNOTS)[1:]
    knots = s_hist[idx] if len(idx) else np.array([])
    knots = np.unique(knots[(knots > 0) & (knots < 1)])
    bh, bf = _trend_basis(s_hist, knots), _trend_basis(s_fut, knots)
    fh, ff = _seasonal_features(days.astype(float)), _seasonal_features(future_days.astype(float))
    pen_g = np.concatenate([[1e-8, 1e-8], np.full(len(knots), 1.0 / (TREND_CHANGE_SCALE ** 2) * 1e-3)])
    pen_s = np.full(fh.shape[1], 1.0 / (SEASONALITY_SCALE ** 2) + 1e-3)
    beta = np.zeros(fh.shape[1])
    gamma = _ridge(bh, ys, pen_g)
    for _ in range(ROUNDS):
        mult = 1.0 + fh @ beta
        gamma = _ridge(bh * mult[:, None], ys, pen_g)
        g = bh @ gamma
        beta = _ridge(fh * g[:, None], ys - g, pen_s)
    g_hist, g_fut = bh @ gamma, bf @ gamma
    yhat_hist = g_hist * (1.0 + fh @ beta)
    yhat_fut = g_fut * (1.0 + ff @ beta)
    resid = ys - yhat_hist
    sd = float(np.std(resid, ddof=1)) if n > 1 else 0.0
    return g_hist * scale, yhat_hist * scale, g_fut * scale, yhat_fut * scale, sd * scale


def make_fit_one(horizon: int):
    def fit_one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        ds = pd.to_datetime(pdf["ds"]).to_numpy()
        y = pdf["y"].to_numpy(dtype=float)
        first = ds[0]
        days = ((ds - first) / np.timedelta64(1, "D")).astype(float)
        fut_ds = ds[-1] + np.arange(1, horizon + 1) * np.timedelta64(1, "D")
        fut_days = ((fut_ds - first) / np.timedelta64(1, "D")).astype(float)
        g_h, yh_h, g_f, yh_f, sd = fit_series(days, y, fut_days)
        half = Z80 * sd
        raw = np.concatenate([yh_h, yh_f])
        out = pd.DataFrame({
            "store": pdf["store"].iloc[0], "segment": pdf["segment"].iloc[0],
            "ds": np.concatenate([ds, fut_ds]).astype("datetime64[D]"),
            "is_future": np.concatenate([np.zeros(len(ds), bool), np.ones(horizon, bool)]),
            "y": np.concatenate([y, np.full(horizon, np.nan)]),
            "trend": np.concatenate([g_h, g_f]), "yhat_raw": raw,
            "yhat": np.maximum(raw, 0.0), "yhat_lower": np.maximum(raw - half, 0.0),
            "yhat_upper": np.maximum(raw + half, 0.0),
        })
        out["ds"] = pd.to_datetime(out["ds"]).dt.date
        return out
    return fit_one


def forecast_fourier(prepared: DataFrame, horizon: int = 30) -> DataFrame:
    """History and horizon rows with the same columns as the J1a forecast."""
    return (prepared.select(*SCOPE, "ds", "y")
                    .groupBy(*SCOPE).applyInPandas(make_fit_one(horizon), OUTPUT_SCHEMA))
