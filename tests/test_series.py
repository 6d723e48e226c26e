import numpy as np
import pandas as pd
import pytest

from shelfcast.operators import series as se
from shelfcast.operators.cube import fact_cube


def ys(df):
    return [r.y for r in df.orderBy("ds").collect()]


def test_short_series_not_winsorised(make_daily):
    assert ys(se.winsorize_iqr(make_daily([1, 100, 2]))) == [1, 100, 2]


def test_spike_clipped(make_daily):
    assert ys(se.winsorize_iqr(make_daily([1, 2, 3, 10]))) == [1, 2, 3, 9.25]


def test_ema_pinned(make_daily):
    assert ys(se.ema(make_daily([1, 2, 3]), span=3)) == pytest.approx([1, 1.5, 2.25])


def test_ema_matches_pandas_long(make_daily):
    vals = np.random.default_rng(1).gamma(2.0, 10.0, 400)
    for span in (1, 7, 21, 200):
        got = ys(se.ema(make_daily(vals), span=span))
        want = pd.Series(vals).ewm(span=span, adjust=False).mean().to_numpy()
        assert np.max(np.abs(np.array(got) - want)) < 1e-9


def test_moving_average_matches_pandas(make_daily):
    vals = np.random.default_rng(2).normal(50, 10, 60)
    for w in (2, 3, 4, 7, 10, 21):
        got = ys(se.moving_average(make_daily(vals), w))
        want = pd.Series(vals).rolling(w, min_periods=1, center=True).mean().to_numpy()
        assert np.max(np.abs(np.array(got) - want)) < 1e-9


def test_savgol_keeps_cubic(make_daily):
    x = np.arange(10)
    cubic = 0.5 * x ** 3 - 2 * x ** 2 + x + 4
    assert ys(se.savgol(make_daily(cubic), 5)) == pytest.approx(list(cubic), abs=1e-8)


def test_savgol_short_series_unchanged(make_daily):
    assert ys(se.savgol(make_daily([5, 1, 7, 2]), 7)) == [5, 1, 7, 2]


@pytest.mark.parametrize("window", [3, 5, 7, 21])
def test_savgol_matches_polyfit(make_daily, window):
    vals = np.random.default_rng(window).normal(20, 5, 50)
    got = np.array(ys(se.savgol(make_daily(vals), window)))
    m, order = window // 2, min(3, window - 1)
    want = vals.copy()
    x = np.arange(window)
    for i in range(len(vals)):
        if i < m:
            seg, pos = vals[:window], i
        elif i >= len(vals) - m:
            seg, pos = vals[-window:], window - (len(vals) - i)
        else:
            seg, pos = vals[i - m:i + m + 1], m
        want[i] = np.polyval(np.polyfit(x, seg, order), pos)
    assert np.max(np.abs(got - want)) < 1e-8


def test_one_day_scope_volatility_null(make_sales):
    s = make_sales([("S", "2024-01-01", "a", "m", "g", 1.0, 2, 2), ("S", "2024-01-01", "b", "m", "g", 1.0, 3, 3)])
    r = se.segment_volatility(se.daily_sales(fact_cube(s))).filter("store = 'S' and segment = 'g'").collect()[0]
    assert r.volatility is None


def test_single_line_scope_default_volatility(make_daily):
    assert se.segment_volatility(make_daily([5])).collect()[0].volatility == 0.3


def test_prepare_clips_negative(make_daily):
    out = se.prepare_series(make_daily([-3, 4, 5, 6]), se.Prep(remove_outliers=False))
    assert [r.y for r in out.orderBy("ds").collect()] == [0, 4, 5, 6]
