"""A run over one sales table: the shared intermediates, built once.

Every intermediate that several outputs read (fact cube, daily series,
prepared series, fitted model, forecast, monthly and product tables) is a
lazily built property. With ``keep="persist"`` they are persisted
(MEMORY_AND_DISK, rebuilt from lineage if an executor is lost) until
``release`` is called (or the context left, as a context manager); with
``keep="checkpoint"`` they are written eagerly to the reliable checkpoint
folder (``spark.checkpoint.dir``), which also cuts the lineage. A checkpoint
lives as long as any plan that reads it, and Spark deletes its files after that
(``spark.cleaner.referenceTracking.cleanCheckpoints``). All of them are bounded by scopes x days (or x models), except
the fact cube, which is the first combine of the sale lines.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from shelfcast.operators import cube as cu
from shelfcast.operators import forecast as fo
from shelfcast.operators import fourier as fu
from shelfcast.operators import monthly as mo
from shelfcast.operators import products as pr
from shelfcast.operators import scope as sc
from shelfcast.operators import series as se
from shelfcast.session import ensure_checkpoint_dir


class SalesContext:
    def __init__(self, sales: DataFrame, prep: se.Prep = se.Prep(), horizon: int = 30,
                 line_order: list[str] | None = None, keep: str | None = "persist",
                 only: frozenset[str] | None = None, method: str = "seasonal", facts: DataFrame | None = None):
        if method not in ("seasonal", "fourier"):
            raise ValueError(f"unknown forecast method {method!r}")
        self.method = method
        self.sales = sales
        self.given_facts = facts  # a fact cube kept between runs (``plans.refresh``)
        self.prep = prep
        self.horizon = horizon
        self.line_order = line_order
        self.keep_mode = keep
        self.only = only  # with "persist": keep just these intermediates

    def _kept(self, name: str) -> bool:
        return self.keep_mode is not None and (self.only is None or name in self.only)

    def keep(self, df: DataFrame, name: str = "") -> DataFrame:
        if not self._kept(name):
            return df
        if self.keep_mode == "persist":
            return df.persist(StorageLevel.MEMORY_AND_DISK)
        if self.keep_mode == "checkpoint":
            ensure_checkpoint_dir(self.sales.sparkSession)
            return df.checkpoint(eager=True)
        return df

    @cached_property
    def facts(self) -> DataFrame:
        """The fact cube when it is given or kept for many readers, else the lines in its columns."""
        if self.given_facts is not None:
            return self.given_facts
        if not self._kept("facts"):
            return cu.line_facts(self.sales)
        return self.keep(cu.fact_cube(self.sales), "facts")

    @cached_property
    def model_days(self) -> DataFrame:
        """The facts without articles where these are kept, else the facts."""
        if self.given_facts is not None or self._kept("facts") or not self._kept("model_days"):
            return self.facts
        return self.keep(cu.model_days(self.facts), "model_days")

    @cached_property
    def daily(self) -> DataFrame:
        return self.keep(se.daily_sales(self.model_days), "daily")

    @cached_property
    def guard(self) -> DataFrame:
        return sc.min_rows_guard(self.daily)

    @cached_property
    def prepared(self) -> DataFrame:
        return self.keep(fo.restrict_to_scopes(se.prepare_series(self.daily, self.prep), self.guard), "prepared")

    @cached_property
    def model(self) -> fo.SeasonalIndexModel:
        m = fo.fit_seasonal_index(self.prepared)
        if not self._kept("model"):
            return m
        if self.keep_mode == "persist":
            m.base.persist(StorageLevel.MEMORY_AND_DISK)
        elif self.keep_mode == "checkpoint":
            base = m.base.checkpoint(eager=True)
            m = fo.model_from_base(base)
        return m

    @cached_property
    def forecast(self) -> DataFrame:
        if self.method == "fourier":
            return self.keep(fu.forecast_fourier(self.prepared, self.horizon), "forecast")
        return self.keep(fo.fit_forecast(self.prepared, self.horizon), "forecast")

    @cached_property
    def monthly(self) -> DataFrame:
        return self.keep(mo.monthly_sales(self.facts, self.daily), "monthly")

    @cached_property
    def trend(self) -> DataFrame:
        return self.keep(pr.product_trend(self.model_days, self.daily), "trend")

    @cached_property
    def volatility(self) -> DataFrame:
        return se.segment_volatility(self.daily)

    @cached_property
    def pairs(self) -> DataFrame:
        """Actual and fitted values, from the history rows of the forecast."""
        return fo.fitted_rows(self.forecast)

    @cached_property
    def forecast_monthly(self) -> DataFrame:
        return fo.forecast_monthly(self.forecast, self.monthly)

    @cached_property
    def forecast_kpis(self) -> DataFrame:
        return fo.forecast_kpis(self.forecast, self.daily, self.volatility, self.horizon)

    @cached_property
    def line_sums(self) -> DataFrame:
        if self._kept("daily") and self._kept("ends"):
            return pr.line_window_sums(self.sales, 30, self.line_order, daily=self.daily, keep=lambda df: self.keep(df, "ends"))
        return pr.line_window_sums(self.sales, 30, self.line_order)

    def __enter__(self) -> SalesContext:
        return self

    def __exit__(self, *error) -> None:
        self.release()

    def release(self) -> None:
        """Drop persisted intermediates."""
        if self.keep_mode != "persist" or self.sales.sparkSession.sparkContext._jsc is None:
            return
        for name in ("facts", "daily", "prepared", "forecast", "monthly", "trend", "model_days"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()
        if "model" in self.__dict__:
            self.__dict__["model"].base.unpersist()
