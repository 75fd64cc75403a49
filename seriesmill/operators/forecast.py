"""Baselines, forecasts of the trend-and-season model, and out-of-sample residuals at rolling origins."""

from __future__ import annotations

import logging
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import TrendConfig
from . import windows as win
from .trend import origin_forecasts, trend_season

log = logging.getLogger(__name__)


def _keys_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by ``keys`` over several partitions a core, which aren't merged: what a fit takes doesn't follow its bytes,
    and merged by size many series' fits would run one after another in a few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism), *keys)


def seasonal_naive(sliced: DataFrame, keys: list[str], k: int = 7) -> DataFrame:
    """(keys, window, date, actual, forecast): the value k days before the forecast's cycle."""
    by = [*keys, "window"]
    last = sliced.where(f"split = 'train' and date > date_sub(train_end, {k})").select(*by, F.pmod(F.date_diff("date", "train_end") - 1 + k, F.lit(k)).alias("slot"), F.col("sales").alias("forecast"))
    val = sliced.where("split = 'val'").select(*by, "date", F.col("sales").alias("actual"), F.pmod(F.date_diff("date", "val_start"), F.lit(k)).alias("slot"))
    return val.join(last, [*by, "slot"]).drop("slot")


def moving_average(sliced: DataFrame, keys: list[str], n: int = 14, horizon: int = 28) -> DataFrame:
    """The mean of the last n values, forecasts fed back, as an array fold."""
    by = [*keys, "window"]
    last = sliced.where(f"split = 'train' and date > date_sub(train_end, {n})").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("date", "sales"))).alias("s"), F.first("val_start").alias("val_start"))
    seed = F.transform("s", lambda x: x["sales"])
    mean = lambda a: F.aggregate(F.slice(a, F.size(a) - n + 1, n), F.lit(0.0), lambda t, x: t + x) / n
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), seed, lambda a, _: F.concat(a, F.array(mean(a))))
    steps = last.where(F.size("s") == n).select(*by, "val_start", F.posexplode(F.slice(grown, n + 1, horizon)).alias("step", "forecast"))
    val = sliced.where("split = 'val'").select(*by, "date", F.col("sales").alias("actual"))
    return val.join(steps.select(*by, F.date_add("val_start", F.col("step")).alias("date"), "forecast"), [*by, "date"])


def smoothing_errors(y: np.ndarray, weights: np.ndarray, period: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sum of squared one-step errors, level, trend, seasons) of additive smoothing for rows of weights (level, trend, season).

    Error-correction form: each day's error moves the level by a, the trend by a b and the season by g (1 - a) of itself.
    """
    a, b, g = np.asarray(weights, float).T
    up, slope, turn = a.copy(), a * b, g * (1 - a)
    level0 = y[:period].mean()
    level, trend = np.full(len(a), level0), np.full(len(a), (y[period : 2 * period].mean() - level0) / period)
    season = np.repeat((y[:period] - level0)[:, None], len(a), axis=1)
    sse, e, part = np.zeros(len(a)), np.empty(len(a)), np.empty(len(a))
    for t, v in enumerate(y.tolist()):
        s = season[t % period]
        level += trend
        np.subtract(v, level, out=e)
        e -= s
        np.multiply(e, e, out=part)
        sse += part
        np.multiply(up, e, out=part)
        level += part
        np.multiply(slope, e, out=part)
        trend += part
        np.multiply(turn, e, out=part)
        s += part
    return sse, level, trend, season.T


def fitted_weights(y: np.ndarray, period: int = 7, rounds: int = 40) -> np.ndarray:
    """Smoothing weights in [0, 1] of least squared error: Nelder-Mead from many starts at once, kept inside by clipping.

    Every simplex moves in the same pass over the series, its candidates (reflected, expanded, contracted) being rows of it.
    """
    grid = np.array([(a, b, g) for a in (0.05, 0.2, 0.5) for b in (0.0, 0.02, 0.1) for g in (0.05, 0.2, 0.5)])
    error = lambda w: smoothing_errors(y, w.reshape(-1, 3), period)[0].reshape(w.shape[:-1])
    start = grid[np.argsort(error(grid))[:4]]
    # simplex, corner, weight
    points = np.clip(start[:, None] + np.concatenate([np.zeros((1, 3)), 0.1 * np.eye(3)]), 0, 1)
    values = error(points)
    for _ in range(rounds):
        order = np.argsort(values, axis=1)
        points, values = np.take_along_axis(points, order[..., None], 1), np.take_along_axis(values, order, 1)
        if (values[:, -1] - values[:, 0] <= 1e-7 * (np.abs(values[:, 0]) + 1e-12)).all():
            break
        centre = points[:, :-1].mean(axis=1)
        away = centre - points[:, -1]
        tried = np.clip(np.stack([centre + away, centre + 2 * away, centre + 0.5 * away, centre - 0.5 * away], axis=1), 0, 1)
        shrunk = np.clip(points[:, :1] + 0.5 * (points[:, 1:] - points[:, :1]), 0, 1)
        got = error(np.concatenate([tried, shrunk], axis=1))
        # the best of the four replaces the worst corner if it improves on it, else the simplex shrinks
        best = got[:, :4].argmin(axis=1)
        rows = np.arange(len(points))
        better = got[rows, best] < values[:, -1]
        points[better, -1], values[better, -1] = tried[rows, best][better], got[rows, best][better]
        points[~better, 1:], values[~better, 1:] = shrunk[~better], got[~better, 4:]
    i = np.unravel_index(values.argmin(), values.shape)
    return points[i]


def holt_winters(y: np.ndarray, horizon: int, period: int = 7, weights: tuple[float, float, float] | None = None) -> np.ndarray:
    """Additive trend and season; smoothing weights as given, else fitted."""
    y = np.asarray(y, float)
    if len(y) < 2 * period:
        return np.full(horizon, y.mean() if len(y) else 0.0)
    w = np.array([fitted_weights(y, period) if weights is None else weights])
    _, level, trend, season = smoothing_errors(y, w, period)
    h = np.arange(1, horizon + 1)
    return level[0] + h * trend[0] + season[0, (len(y) + h - 1) % period]


def _grouped(sliced: DataFrame, keys: list[str], columns: list[str], fn: Callable[[pd.DataFrame, pd.DataFrame], dict], fields: str) -> DataFrame:
    """Run ``fn(train, val) -> columns of val`` for each series and window; one group's rows are one series' history."""
    by = [*keys, "window"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        train, val = pdf[pdf["split"] == "train"], pdf[pdf["split"] == "val"]
        return val[[*by, "date"]].assign(actual=val["sales"].astype(float), **fn(train, val))

    names = list(dict.fromkeys([*by, "date", "sales", "split", *columns]))
    return dealt(sliced.select(*names), by).groupBy(*by).applyInPandas(one, f"{_keys_schema(sliced, by)}, date date, actual double, {fields}")


def exponential_smoothing(sliced: DataFrame, keys: list[str], weights: tuple[float, float, float] | None = None) -> DataFrame:
    return _grouped(sliced, keys, [], lambda t, v: {"forecast": holt_winters(t["sales"].to_numpy(), len(v), weights=weights)}, "forecast double")


def baseline_forecasts(sliced: DataFrame, keys: list[str], horizon: int = 28, weights: tuple[float, float, float] | None = None) -> DataFrame:
    """The three baselines with a ``model`` column; ``weights`` of exponential smoothing are fitted unless given."""
    cols = [*keys, "window", "date", "actual", "forecast"]
    parts = {"seasonal_naive": seasonal_naive(sliced, keys), "moving_average": moving_average(sliced, keys, horizon=horizon), "exponential_smoothing": exponential_smoothing(sliced, keys, weights)}
    out = None
    for name, df in parts.items():
        part = df.select(*cols, F.lit(name).alias("model"))
        out = part if out is None else out.unionByName(part)
    return out


def trend_forecast(sliced: DataFrame, keys: list[str], config: Callable[[pd.DataFrame], TrendConfig] | TrendConfig | None = None, regressors: list[str] | None = None) -> DataFrame:
    """(keys, window, date, actual, forecast, trend, sigma) of the trend-and-season model."""
    cols = regressors or []

    def fn(train, val):
        cfg = config(val) if callable(config) else config or TrendConfig()
        gone = [f"{c}: {n}" for c, n in (*train[cols].isna().sum().items(), *val[cols].isna().sum().items()) if n]
        if gone:
            log.info("missing covariate values count as 0: %s", ", ".join(gone))
        x, fx = (f[cols].fillna(0).to_numpy(float) for f in (train, val))
        r = trend_season(train["sales"].to_numpy(float), train["date"], val["date"], cfg, x, fx)
        return {"forecast": r["yhat"][len(train) :], "trend": r["trend"][len(train) :], "sigma": r["sigma"][len(train) :]}

    return _grouped(sliced, keys, cols, fn, "forecast double, trend double, sigma double")


#: (y, dates, horizon) -> forecasts; with regressors also their past and future rows.
Forecaster = Callable[..., np.ndarray]
#: Origins that one task forecasts from.
ORIGINS_A_TASK = 24


def trend_forecaster(y: np.ndarray, dates: np.ndarray, horizon: int, x: np.ndarray | None = None, fx: np.ndarray | None = None, config: TrendConfig | None = None) -> np.ndarray:
    future = np.asarray(dates, "datetime64[D]")[-1] + np.arange(1, horizon + 1)
    return trend_season(y, dates, future, config or TrendConfig(), x, fx)["yhat"][-horizon:]


def flat_forecaster(days: int = 28) -> Forecaster:
    """The mean of the last ``days`` values, as a plain stand-in for a model."""
    return lambda y, dates, horizon, *_: np.full(horizon, y[-days:].mean())


def residuals_at(y: np.ndarray, dates: np.ndarray, horizon: int, starts: list[int], forecaster: Forecaster | None, x: np.ndarray | None = None, config: TrendConfig | None = None) -> dict[int, tuple[int, float]]:
    """Out-of-sample residual of each position after the first origin, from the latest origin before it: {position: (origin,
    residual)}. Without a ``forecaster`` the trend model is fitted at all origins from one pass over the series."""
    made = origin_forecasts(y, dates, horizon, starts, config or TrendConfig(), x) if forecaster is None else {}
    out: dict[int, tuple[int, float]] = {}
    for o in starts:
        p = made[o] if forecaster is None else forecaster(y[:o], dates[:o], horizon, *(() if x is None else (x[:o], x[o : o + horizon])))
        if len(p) != horizon:
            raise ValueError(f"origin {o} gave {len(p)} values, not {horizon}")
        for i in range(horizon):
            out[o + i] = (o, float(y[o + i] - p[i]))
    if out and len(out) != max(out) - min(out) + 1:
        raise ValueError("residuals have gaps")
    return out


def residuals_of(y: np.ndarray, dates: np.ndarray, horizon: int, min_train: int, stride: int, forecaster: Forecaster | None = None, x: np.ndarray | None = None) -> dict[int, tuple[int, float]]:
    """The residuals of all origins of a series."""
    return residuals_at(y, dates, horizon, win.origins(len(y), horizon, min_train, stride), forecaster, x)


def in_sample_residuals(df: DataFrame, keys: list[str], config: TrendConfig | None = None, target: str = "sales", regressors: list[str] | None = None) -> DataFrame:
    """(keys, date, fitted, residual) of the trend model on the days it was fitted to: a diagnostic, never to train on."""
    log.warning("in-sample residuals understate errors; train on rolling_origin_residuals")
    cfg, cols = config or TrendConfig(), regressors or []

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        y, x = pdf[target].to_numpy(float), pdf[cols].fillna(0).to_numpy(float)
        fitted = trend_season(y, pdf["date"], pdf["date"].iloc[:0], cfg, x, x[:0])["yhat"]
        return pdf[[*keys, "date"]].assign(fitted=fitted, residual=y - fitted)

    return dealt(df.where(f"{target} is not null").select(*keys, "date", target, *cols), keys).groupBy(*keys).applyInPandas(one, f"{_keys_schema(df, keys)}, date date, fitted double, residual double")


def min_residual_length(lags: list[int] | None) -> int:
    return max(map(abs, lags)) + 1 if lags else 2


def rolling_origin_residuals(df: DataFrame, keys: list[str], horizon: int = 28, min_train: int = 365, stride: int | None = None, forecaster: Forecaster | None = None, target: str = "sales", regressors: list[str] | None = None, config: Callable[[pd.DataFrame], TrendConfig] | TrendConfig | None = None) -> DataFrame:
    """(keys, date, origin, origin_end, residual) of each daily series long enough, each day from the latest origin before it.

    ``origin`` is the length of the training prefix, ``origin_end`` its last day. A task has ``ORIGINS_A_TASK`` origins of one
    series and the rows up to the last of them; without a ``forecaster`` it fits the trend model at all of them from one pass.
    ``config`` may depend on a group's rows.
    """
    step, cols = stride or horizon, regressors or []
    by_date = W.partitionBy(*keys)
    placed = df.where(F.col(target).isNotNull()).select(*keys, "date", target, *cols)
    placed = placed.withColumns({"_i": F.row_number().over(by_date.orderBy("date")) - 1, "_n": F.count("*").over(by_date)}).where(F.col("_n") - horizon >= min_train)
    # origins go back from n - horizon; blocks count from the first
    count = F.floor((F.col("_n") - horizon - min_train) / step) + 1
    first = F.col("_n") - horizon - (count - 1) * step
    blocks = placed.withColumns({"_count": count, "_first": first}).withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_count") - 1) / ORIGINS_A_TASK).cast("int"))))
    last = F.least(F.col("_count"), (F.col("_block") + 1) * ORIGINS_A_TASK) - 1
    blocks = blocks.where(F.col("_i") < F.col("_first") + last * step + horizon)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").reset_index(drop=True)
        n, block = int(pdf["_n"].iloc[0]), int(pdf["_block"].iloc[0])
        starts = win.origins(n, horizon, min_train, step)[block * ORIGINS_A_TASK : (block + 1) * ORIGINS_A_TASK]
        x = pdf[cols].fillna(0).to_numpy(float) if cols else None
        own = config(pdf) if callable(config) else config
        r = residuals_at(pdf[target].to_numpy(float), pdf["date"].to_numpy(), horizon, starts, forecaster, x, own)
        at = sorted(r)
        return pdf.loc[at, [*keys, "date"]].assign(origin=[r[i][0] for i in at], origin_end=pdf["date"].to_numpy()[[r[i][0] - 1 for i in at]], residual=[r[i][1] for i in at])

    out = dealt(blocks.drop("_i", "_count", "_first"), [*keys, "_block"]).groupBy(*keys, "_block").applyInPandas(one, f"{_keys_schema(df, keys)}, date date, origin long, origin_end date, residual double")
    return out if step == horizon else win.keep_latest(out, keys)


def lagged_residuals(residuals: DataFrame, keys: list[str], lags: list[int], value: str = "residual", known: str | None = "origin_end") -> DataFrame:
    """``residuals`` with a column own_lag_{n} for each lag: the series' own value n days before, if it was known.

    As-of join in two stages: a day's value is that of the latest origin before the day, and a row takes the value n days
    back only where that day isn't after the row's own origin (``known``, the last day that its forecast may use).
    """
    days = [abs(n) for n in lags]
    if not days or min(days) == 0:
        raise ValueError("lags must be days back")
    past = residuals.where(F.col(value).isNotNull()).select(*keys, F.col("date").alias("_seen"), F.col(value).alias("_v"), F.explode(F.array(*map(F.lit, days))).alias("_n"))
    past = past.groupBy(*keys, F.date_add("_seen", F.col("_n")).alias("date")).agg(*[F.max(F.when(F.col("_n") == n, F.col("_v"))).alias(f"own_lag_{n}") for n in days])
    out = residuals.join(past, [*keys, "date"], "left")
    if known is None:
        return out
    return out.withColumns({f"own_lag_{n}": F.when(F.date_sub("date", n) <= F.col(known), F.col(f"own_lag_{n}")) for n in days})


def decomposition(df: DataFrame, keys: list[str], horizon: int = 28, regressors: list[str] | None = None) -> DataFrame:
    """(keys, window, date, actual, trend, seasonality, residual) over the last ``horizon`` days."""
    end = F.date_sub(F.max("date").over(W.partitionBy(*keys)), horizon)
    sliced = df.withColumn("split", F.when(F.col("date") <= end, "train").otherwise("val")).withColumn("window", F.lit(0))
    return components(trend_forecast(sliced, keys, regressors=regressors), keys)


def components(f: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, window, date, actual, trend, seasonality, residual) of forecasts that carry their trend."""
    return f.select(*keys, "window", "date", "actual", "trend", F.try_divide("forecast", "trend").alias("seasonality"), (F.col("actual") - F.col("forecast")).alias("residual"))


def best_trial(trials: DataFrame) -> DataFrame:
    return trials.orderBy("objective", "trial").limit(1)
