"""Data of the reports: forecasts beside the past, histograms of errors, metrics of the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from . import forecast, panel, windows

#: Days that the dashboard can forecast.
HORIZONS = (7, 90)


def error_band(forecasts: DataFrame, keys: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """``forecasts`` with p05 and p95: the forecast moved by quantiles of the series' errors, p05 not under 0."""
    e = F.col("actual") - F.col("forecast")
    band = forecasts.groupBy(*keys).agg(F.percentile(e, low).alias("_lo"), F.percentile(e, high).alias("_hi"))
    moved = {"p05": F.greatest(F.col("forecast") + F.col("_lo"), F.lit(0.0)), "p95": F.col("forecast") + F.col("_hi")}
    return forecasts.join(band, keys).withColumns(moved).drop("_lo", "_hi")


def forecast_rows(past: DataFrame, forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, date, kind, value, lo, hi): history rows of ``past``, actual and forecast rows of ``forecasts`` with its p05 and p95."""
    none = F.lit(None).cast("double")
    kinds = F.array(
        F.struct(F.lit("actual").alias("kind"), F.col("actual").alias("value"), none.alias("lo"), none.alias("hi")),
        F.struct(F.lit("forecast").alias("kind"), F.col("forecast").alias("value"), F.col("p05").alias("lo"), F.col("p95").alias("hi")),
    )
    seen = past.select(*keys, "date", F.lit("history").alias("kind"), F.col("sales").alias("value"), none.alias("lo"), none.alias("hi"))
    return seen.unionByName(forecasts.select(*keys, "date", F.explode(kinds).alias("k")).select(*keys, "date", "k.*"))


def histogram(df: DataFrame, keys: list[str], value: str = "residual", bins: int = 50) -> DataFrame:
    """(keys, bin, lo, hi, n): counts of equal bins between a group's least and greatest value, empty bins too.

    The last bin holds the greatest value; a group of one value has all in bin 0. Null values don't count.
    """
    if bins <= 0:
        raise ValueError("bins must be positive")
    known = df.where(F.col(value).isNotNull())
    span = known.groupBy(*keys).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    at = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col(value) - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1))).otherwise(0).cast("long")
    n = known.join(span, keys).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))
    every = span.select(*keys, "a", "b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).withColumn("bin", F.col("bin").cast("long"))
    edge = lambda i: F.col("a") + (F.col("b") - F.col("a")) * i / bins
    return every.join(n, [*keys, "bin"], "left").select(*keys, "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def dashboard(sales: DataFrame, stores: list[int] | None = None, families: list[str] | None = None, horizon: int = 28) -> DataFrame:
    """(family, MAPE, RMSE, DirectionAccuracy, PeakCapture): the weekly-naive forecast of the last ``horizon`` days of the
    daily sales of the chosen stores and families (None: all)."""
    if not HORIZONS[0] <= horizon <= HORIZONS[1]:
        raise ValueError(f"the horizon must lie in {HORIZONS[0]}..{HORIZONS[1]}")
    chosen = sales if stores is None else sales.where(F.col("store_nbr").isin(stores))
    chosen = chosen if families is None else chosen.where(F.col("family").isin(families))
    daily = panel.complete(chosen.groupBy("date", "family").agg(F.sum("sales").alias("sales")), "family")
    sliced = windows.slice_windows(daily, windows.cv_windows(daily, ["family"], horizon, 1), ["family"])
    return metrics.metric_table(forecast.seasonal_naive(sliced, ["family"]), ["family"]).select("family", "MAPE", "RMSE", "DirectionAccuracy", "PeakCapture")
