import datetime as dt

import numpy as np
import pandas as pd

from shelfcast.operators import forecast as fo
from shelfcast.operators import fourier as fu


def _synthetic(spark):
    rng = np.random.default_rng(42)
    n = 1095
    dates = pd.date_range("2020-01-01", periods=n)
    t = np.arange(n)
    y = ((100 + 0.05 * t) * (1 + 0.2 * np.sin(2 * np.pi * dates.weekday.to_numpy() / 7))
         * (1 + 0.3 * np.sin(2 * np.pi * dates.dayofyear.to_numpy() / 365.25)) * (1 + rng.normal(0, 0.03, n)))
    rows = [("S", "G", d.date(), float(v)) for d, v in zip(dates, y)]
    return spark.createDataFrame(rows[:-90], "store string, segment string, ds date, y double"), y[-90:], y[:-90]


def _quality(fc, holdout, train):
    hist = fc.filter(~fc.is_future).sort_values("ds")
    fut = fc.filter(fc.is_future).sort_values("ds") if hasattr(fc, "filter") else None
    return hist, fut


def _check(pdf, holdout, train):
    hist = pdf[~pdf.is_future].sort_values("ds")
    fut = pdf[pdf.is_future].sort_values("ds")
    r2 = 1 - np.sum((hist.y - hist.yhat_raw) ** 2) / np.sum((hist.y - hist.y.mean()) ** 2)
    mape = np.mean(np.abs((holdout - fut.yhat.to_numpy()) / holdout)) * 100
    mape_mean = np.mean(np.abs((holdout - train.mean()) / holdout)) * 100
    assert r2 > 0.9
    assert mape < mape_mean / 2
    assert (fut.yhat_lower <= fut.yhat).all() and (fut.yhat <= fut.yhat_upper).all()


def test_seasonal_index_quality(spark):
    prepared, holdout, train = _synthetic(spark)
    fc = fo.forecast(fo.fit_seasonal_index(prepared), 90).toPandas()
    _check(fc, holdout, train)


def test_one_pass_forecast_equals_the_fitted_model(spark):
    """Two scopes: one with every weekday and month, one of a few days with gaps (weekdays and months it never saw)."""
    prepared, _, _ = _synthetic(spark)
    few = spark.createDataFrame([("T", "G", dt.date(2024, 1, 29) + dt.timedelta(days=i), v) for i, v in ((0, 4.0), (1, 7.0), (7, 0.0))]
                                + [("U", "G", dt.date(2024, 2, 29), 3.0)], prepared.schema)
    both = prepared.union(few)
    order = ["store", "segment", "ds"]
    got = fo.fit_forecast(both, 40).toPandas().sort_values(order, ignore_index=True)
    want = fo.forecast(fo.fit_seasonal_index(both), 40).toPandas().sort_values(order, ignore_index=True)
    assert got.is_future.sum() == 120
    pd.testing.assert_frame_equal(got, want, rtol=1e-9, atol=1e-9)
    assert fo.fit_forecast(both.limit(0), 40).count() == 0


def test_fourier_quality(spark):
    prepared, holdout, train = _synthetic(spark)
    fc = fu.forecast_fourier(prepared, 90).toPandas()
    _check(fc, holdout, train)


def _plain_fourier(dates, y, horizon):
    """The Fourier model written out feature by feature, its ridge steps as least squares on rows added for the penalty."""
    n, scale = len(y), max(abs(v) for v in y) or 1.0
    days = [(d - dates[0]).days for d in dates] + [(dates[-1] - dates[0]).days + k for k in range(1, horizon + 1)]
    s = [d / ((dates[-1] - dates[0]).days or 1) for d in days]
    cut = max(1, int(0.8 * n))
    places = sorted({int(k * (cut - 1) / 25) for k in range(26)})[1:]
    knots = sorted({s[i] for i in places if 0 < s[i] < 1})
    trend = np.array([[1.0, t, *[max(t - k, 0.0) for k in knots]] for t in s])
    wave = lambda d, p, m: [f(2 * np.pi * d * k / p) for f in (np.sin, np.cos) for k in range(1, m + 1)]
    season = np.array([wave(d, 7.0, 3) + wave(d, 365.25, 10) for d in days])
    target = np.array(y) / scale

    def ridge(x, want, penalty):
        rows = np.vstack([x, np.diag(np.sqrt(penalty))])
        return np.linalg.lstsq(rows, np.concatenate([want, np.zeros(len(penalty))]), rcond=None)[0]
    of_trend = np.array([1e-8, 1e-8] + [1e-3 / 0.05**2] * len(knots))
    of_season = np.full(26, 1 / 10.0**2 + 1e-3)
    beta = np.zeros(26)
    for _ in range(8):
        gamma = ridge(trend[:n] * (1 + season[:n] @ beta)[:, None], target, of_trend)
        g = trend[:n] @ gamma
        beta = ridge(season[:n] * g[:, None], target - g, of_season)
    level = trend @ gamma
    raw = level * (1 + season @ beta)
    sd = float(np.std(target - raw[:n], ddof=1)) if n > 1 else 0.0
    return level * scale, raw * scale, sd * scale


def test_fourier_equals_a_plain_version(spark):
    """Every scope of the driver's tables against an independent solver: trend, forecast, interval and dates."""
    from shelfcast.plans.catalog import ctx
    c = ctx(spark, "/root/testdata/sf0.001")
    got = fu.forecast_fourier(c.prepared, 30).toPandas()
    want = c.prepared.toPandas()
    scopes = want.groupby(["store", "segment"])
    assert len(scopes) > 20 and len(got) == len(want) + 30 * len(scopes)
    by_scope = dict(list(got.groupby(["store", "segment"])))
    for key, rows in scopes:
        rows, fc = rows.sort_values("ds"), by_scope[key].sort_values("ds")
        level, raw, sd = _plain_fourier(list(rows.ds), list(rows.y), 30)
        size = max(rows.y.abs().max(), 1.0)
        assert np.abs(fc.trend.to_numpy() - level).max() < 1e-5 * size and np.abs(fc.yhat_raw.to_numpy() - raw).max() < 1e-5 * size
        assert np.abs(fc.yhat.to_numpy() - np.maximum(raw, 0)).max() < 1e-5 * size
        assert np.abs(fc.yhat_lower.to_numpy() - np.maximum(raw - fo.Z80 * sd, 0)).max() < 1e-5 * size
        assert np.abs(fc.yhat_upper.to_numpy() - np.maximum(raw + fo.Z80 * sd, 0)).max() < 1e-5 * size
        last = rows.ds.iloc[-1]
        assert list(fc[fc.is_future].ds) == [last + dt.timedelta(days=k) for k in range(1, 31)]


def test_zero_actuals_mape_zero(spark):
    rows = [("S", "G", dt.date(2024, 1, 1) + dt.timedelta(days=i), 0.0) for i in range(20)]
    prepared = spark.createDataFrame(rows, "store string, segment string, ds date, y double")
    fc = fo.forecast(fo.fit_seasonal_index(prepared), 7)
    a = fo.accuracy(fo.actual_vs_fitted(prepared, fc)).collect()[0]
    assert a.mape == 0.0 and a.r2 == 1.0


def test_iso_week_53(spark):
    from pyspark.sql import functions as F
    r = spark.range(1).select(F.weekofyear(F.lit("2021-01-03").cast("date")).alias("w")).collect()[0]
    assert r.w == 53


def test_future_frame_dates(spark):
    rows = [("S", "G", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(15)]
    prepared = spark.createDataFrame(rows, "store string, segment string, ds date, y double")
    model = fo.fit_seasonal_index(prepared)
    days = sorted(r.ds for r in fo.future_frame(model.coef, 7).collect())
    assert days[0] == dt.date(2024, 1, 16) and days[-1] == dt.date(2024, 1, 22) and len(days) == 7
