"""Backtests of the routed models beside the baselines: one task fits one series in one window.

A group holds one series' history up to a window's end, so its size is bounded by the calendar; series, windows and
tuning trials are rows of one plan and run in parallel.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import BaseConfig
from ..functions import transforms as tf
from ..sources.tables import kept
from . import forecast, segments
from .boosting import GaussianTrees

log = logging.getLogger(__name__)

#: Names of the learned models by route.
MODELS = {"hybrid": "hybrid", "direct": "direct_catboost"}
FIELDS = "date date, model string, actual double, forecast double, p05 double, p95 double"


def filter_series(df: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the series named in ``series``."""
    return df.join(series.select(*keys).distinct(), keys, "left_semi")


def prefix_totals(history: DataFrame, ends: DataFrame, keys: list[str], target: str = "sales") -> DataFrame:
    """(train_end, keys, total): what each series has sold up to each of ``ends`` (train_end), from its first sale on.

    History is read once whatever the number of ends: a row counts from the first end that isn't before it, running sums go
    along a series' ends, and an end without new sales takes the sum of the one before. There are at most as many ends as days.
    """
    days = ends.where("train_end is not null").select("train_end").distinct().agg(F.sort_array(F.collect_list("train_end")))
    slots = history.select(*keys, "date", target, days.scalar().alias("_ends")).select(*keys, target, F.size(F.filter("_ends", lambda e: e < F.col("date"))).alias("_slot")).where(F.col("_slot") < F.size(days.scalar()))
    sums = slots.groupBy(*keys, "_slot").agg(F.sum(target).alias("_sum"))
    w = W.partitionBy(*keys).orderBy("_slot")
    running = sums.select(*keys, "_slot", F.sum("_sum").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("total"), F.coalesce(F.lead("_slot").over(w), F.size(days.scalar())).alias("_next"))
    spread = running.withColumn("_at", F.explode(F.sequence(F.col("_slot"), F.col("_next") - 1)))
    return spread.select(F.element_at(days.scalar(), F.col("_at") + 1).alias("train_end"), *keys, "total")


def window_routes(catalog: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, window, train_end, abc_class, route): each series' class among the whole catalog's sales up to its window's
    train end; a series unknown by then is of class C."""
    classes = segments.abc_classes(prefix_totals(catalog, windows, keys), keys, "total", by=["train_end"])
    return segments.route(classes, windows.select(*keys, "window", "train_end"), [*keys, "train_end"])


#: Settings of a group's rows: one for all, or by its columns (a trial's).
Settings = Callable[[pd.DataFrame], BaseConfig]


def own_targets(sliced: DataFrame, by: list[str], lags: list[int], known: list[str], config: BaseConfig, settings: Settings | None = None) -> DataFrame:
    """Rows of ``sliced`` that the boosted model fits (train) or forecasts (val), with ``target``, ``base`` and own_lag_{n}.

    The target transform is fitted on a window's train rows alone. hybrid: the target is the out-of-sample residual of the
    trend model, on the days that have one, and ``base`` is the trend model's forecast of the val days; direct: the transformed
    sales themselves. own_lag_{n} is the target n days before, for lags that reach the horizon: of residuals as their origins
    knew them. A series too short for residual origins, or with fewer residuals than its lags need, goes the direct way.
    """
    c = config.pipeline
    steps = c.forecast_horizon
    if min(map(abs, lags)) < steps:
        raise ValueError(f"lags {lags} are shorter than the horizon of {steps} days")
    train, val = sliced.where("split = 'train'"), sliced.where("split = 'val'")
    params = kept(tf.fit(train, by, c.target_transform), "params")
    boxed = tf.transform(train, params, by, out="_z")
    length = F.col("fit_size") - F.when(F.col("method") == "difference", 1).otherwise(0)
    # residuals run from the first origin to the end: at least so many, and enough for the longest lag
    origins = F.floor((length - steps - c.residual_min_train_size) / steps) + 1
    enough = (length - steps >= c.residual_min_train_size) & (origins * steps >= forecast.min_residual_length(lags))
    hybrid = (F.col("route") == "hybrid") & enough
    boxed = boxed.withColumn("_hybrid", hybrid)
    ahead = val.join(params, by).withColumn("_hybrid", hybrid)
    parts = boxed.where("_hybrid").select(*by, "date", "_z", *known)
    trend_config = (lambda pdf: settings(pdf).trend) if settings else config.trend
    residuals = forecast.rolling_origin_residuals(parts, by, steps, c.residual_min_train_size, steps, target="_z", regressors=known, config=trend_config)
    both = parts.withColumn("split", F.lit("train")).unionByName(ahead.where("_hybrid").select(*by, "date", F.lit(None).cast("double").alias("_z"), *known, F.lit("val").alias("split")))
    trend = forecast.trend_forecast(both.withColumnRenamed("_z", "sales"), [k for k in by if k != "window"], trend_config, known)
    # own values by day and when they were known: a val day's row may use what its window's train end knew
    end = F.col("train_end")
    targets = residuals.select(*by, "date", F.col("residual").alias("target"), F.col("origin_end").alias("_known"))
    targets = targets.unionByName(boxed.where("not _hybrid").select(*by, "date", F.col("_z").alias("target"), F.date_sub("date", steps).alias("_known")))
    targets = targets.unionByName(ahead.select(*by, "date", F.lit(None).cast("double").alias("target"), end.alias("_known")))
    lagged = forecast.lagged_residuals(kept(targets, "targets"), by, lags, "target", "_known").drop("_known")
    base = trend.select(*by, "date", F.col("forecast").alias("base"))
    return sliced.join(params, by).join(lagged, [*by, "date"]).join(base, [*by, "date"], "left").withColumn("base", F.coalesce("base", F.lit(0.0)))


def boosted(train: pd.DataFrame, val: pd.DataFrame, columns: list[str], own: list[str], config: BaseConfig) -> dict[str, np.ndarray]:
    """Median and 5 % and 95 % quantiles of ``val``'s days in units of sales, never under 0: ``base`` plus boosted trees on
    ``target`` over ``columns`` and the target's own lags. Rows before the longest lag have none and go, as far as 10 remain.
    A loss without uncertainty gives three equal values."""
    whole = train[own].notna().all(axis=1).to_numpy()
    train = train[whole] if whole.sum() >= 10 else train
    features = [*columns, *own]
    x, fx = (f[features].to_numpy(float) for f in (train, val))
    mu, sigma = GaussianTrees(config.boost).fit(x, train["target"].to_numpy(float)).predict(fx)
    if config.boost.loss_function != "RMSEWithUncertainty":
        sigma = np.zeros_like(sigma)
    first = val.iloc[0]
    params = {k: first[k] for k in ("method", "lam", "shift")}
    base = val["base"].to_numpy(float)
    return {name: np.maximum(tf.inverse_values(base + mu + NormalDist().inv_cdf(q) * sigma, params, first["last_value"]), 0.0) for name, q in (("forecast", 0.5), ("p05", 0.05), ("p95", 0.95))}


def learned_forecasts(sliced: DataFrame, keys: list[str], columns: list[str], known: list[str], config: BaseConfig | None = None, lags: list[int] | None = None) -> DataFrame:
    """(keys, window, date, model, actual, forecast, p05, p95) of each series and window by its ``route``.

    ``sliced``: feature rows with window, split (train, val) and route; features reach the horizon, so val rows hold
    nothing from after the train end. ``lags`` of the model's own target default to four from the horizon on.
    """
    c = config or BaseConfig()
    lags = lags or segments.direct_lags(c.pipeline.forecast_horizon)
    by, own = [*keys, "window"], [f"own_lag_{abs(n)}" for n in lags]
    rows = kept(sliced.select(*dict.fromkeys([*by, "date", "sales", "split", "train_end", "route", *columns, *known])), "sliced")
    frame = own_targets(rows, by, lags, known, c)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        train, val = pdf[pdf["split"] == "train"], pdf[pdf["split"] == "val"]
        model = MODELS[pdf["route"].iloc[0]]
        if not len(train) or not len(val):
            return val[[*by, "date"]].assign(model=model, actual=np.nan, forecast=np.nan, p05=np.nan, p95=np.nan).iloc[:0]
        return val[[*by, "date"]].assign(model=model, actual=val["sales"].astype(float), **boosted(train, val, columns, own, c))

    need = list(dict.fromkeys([*by, "date", "sales", "split", "route", "target", "base", "method", "lam", "shift", "last_value", *columns, *own]))
    return forecast.dealt(frame.select(*need), by).groupBy(*by).applyInPandas(one, f"{forecast._keys_schema(sliced, by)}, {FIELDS}")


def scored_forecasts(sliced: DataFrame, learned: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """Forecasts of the three baselines and of a learned model on the same windows, with a ``model`` column."""
    cols = [*keys, "window", "date", "actual", "forecast", "model"]
    return forecast.baseline_forecasts(sliced, keys, horizon).select(*cols).unionByName(learned.select(*cols))


#: (train rows, val rows without their sales) -> forecasts of the val days, or these and the name of the model that made them.
ForecastFn = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray | tuple[np.ndarray, str]]


def forecasts_of(sliced: DataFrame, keys: list[str], forecast_fn: ForecastFn, covariates: list[str] | None = None, model_name: str = "hybrid") -> DataFrame:
    """(keys, window, date, actual, forecast, model) of a caller's function, run for each series and window in a task of its own.

    It sees the window's train rows (date, sales, keys, covariates) and the val rows without sales. A forecast of another
    length than the val days, or val days that don't follow the train rows, are errors.
    """
    by, cols = [*keys, "window"], covariates or []

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").reset_index(drop=True)
        train, val = pdf[pdf["split"] == "train"].drop(columns="split"), pdf[pdf["split"] == "val"].drop(columns="split")
        if not len(val):
            return val[[*by, "date"]].assign(actual=np.nan, forecast=np.nan, model=model_name)
        if not len(train) or val["date"].iloc[0] <= train["date"].iloc[-1]:
            raise ValueError("validation days must follow training days")
        made = forecast_fn(train, val.drop(columns="sales"))
        values, name = made if isinstance(made, tuple) else (made, model_name)
        if len(values) != len(val):
            raise ValueError(f"forecast_fn gave {len(values)} values for {len(val)} days")
        return val[[*by, "date"]].assign(actual=val["sales"].astype(float), forecast=np.asarray(values, float), model=str(name))

    need = list(dict.fromkeys([*by, "date", "sales", "split", *cols]))
    return forecast.dealt(sliced.select(*need), by).groupBy(*by).applyInPandas(one, f"{forecast._keys_schema(sliced, by)}, date date, actual double, forecast double, model string")


def flat_forecasts(sliced: DataFrame, keys: list[str], days: int = 28) -> DataFrame:
    """The mean of the last ``days`` training days, as a plain stand-in for a learned model."""
    by = [*keys, "window"]
    mean = sliced.where(f"split = 'train' and date > date_sub(train_end, {days})").groupBy(*by).agg((F.sum("sales") / days).alias("forecast"))
    return sliced.where("split = 'val'").select(*by, "date", F.col("sales").alias("actual")).join(mean, by).withColumn("model", F.lit("flat"))


def log_trials(trials: DataFrame) -> None:
    """One log line for each trial of a search and one for the best; trials are few by ``n_trials``."""
    rows = trials.orderBy("trial").collect()
    for r in rows:
        log.info("trial %s", r.asDict())
    if rows:
        log.info("best trial %s", min(rows, key=lambda r: (r.objective is None, r.objective, r.trial)).asDict())


class ParzenSampler:
    """Tree-structured Parzen estimator (after Bergstra et al. 2011) over named choices and ranges.

    After ``startup`` random trials, each value is drawn from a kernel density of the best quarter of trials, the candidate of
    highest density against the rest's being taken; a failed trial counts with the rest.
    """

    def __init__(self, space: dict, seed: int = 42, startup: int = 5, candidates: int = 24):
        self.space, self.rng, self.startup, self.candidates = space, np.random.default_rng(seed), startup, candidates
        self.seen: list[tuple[dict, float]] = []

    def tell(self, values: dict, objective: float | None) -> None:
        self.seen.append((values, np.inf if objective is None or not np.isfinite(objective) else float(objective)))

    def _scale(self, name, v) -> float:
        kind, lo, hi = self.space[name]
        lo, hi, v = (np.log(lo), np.log(hi), np.log(v)) if kind == "log" else (lo - 0.5, hi + 0.5, v) if kind == "int" else (lo, hi, v)
        return (v - lo) / (hi - lo)

    def _value(self, name, u: float):
        kind, lo, hi = self.space[name]
        if kind == "log":
            return float(np.exp(np.log(lo) + u * (np.log(hi) - np.log(lo))))
        return int(np.clip(np.floor(lo + u * (hi - lo + 1)), lo, hi)) if kind == "int" else float(lo + u * (hi - lo))

    def _density(self, at: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Mixture of kernels at ``at`` and a flat one, at ``u`` in 0 to 1."""
        width = max(1 / (len(at) + 1), 0.05)
        kernels = np.exp(-0.5 * ((u[:, None] - at) / width) ** 2) / (width * np.sqrt(2 * np.pi))
        return (kernels.sum(axis=1) + 1) / (len(at) + 1)

    def ask(self) -> dict:
        order = sorted(self.seen, key=lambda s: s[1])
        good = [v for v, f in order[: max(1, int(np.ceil(len(order) / 4)))] if np.isfinite(f)]
        rest = [v for v, _ in order[len(good) :]]
        out, random = {}, len(self.seen) < self.startup or not good
        for name, spec in self.space.items():
            if spec[0] == "choice":
                options = spec[1]
                p, q = (np.array([1 + sum(v[name] == o for v in vs) for o in options], float) for vs in (good, rest))
                drawn = self.rng.choice(len(options), self.candidates, p=p / p.sum())
                best = drawn[np.argmax((p / p.sum() / (q / q.sum()))[drawn])]
                out[name] = options[int(self.rng.integers(len(options))) if random else int(best)]
                continue
            if random:
                out[name] = self._value(name, float(self.rng.uniform()))
                continue
            a, b = (np.array([self._scale(name, v[name]) for v in vs]) for vs in (good, rest))
            width = max(1 / (len(a) + 1), 0.05)
            u = np.where(self.rng.uniform(size=self.candidates) < 1 / (len(a) + 1), self.rng.uniform(size=self.candidates), self.rng.choice(a, self.candidates) + width * self.rng.normal(size=self.candidates))
            u = np.clip(u, 0, 1 - 1e-9)
            out[name] = self._value(name, float(u[np.argmax(self._density(a, u) / self._density(b, u))]))
        return out


def search_space(lag_sets: list[str]) -> dict:
    """Ranges of the four values that a search draws."""
    return {"changepoint_prior_scale": ("log", 0.001, 0.5), "learning_rate": ("log", 0.01, 0.3), "depth": ("int", 4, 10), "lags": ("choice", sorted(lag_sets))}


def _trial_forecasts(columns: list[str], lags: dict[int, list[str]], settings: dict[int, BaseConfig]):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        train, val = pdf[pdf["split"] == "train"], pdf[pdf["split"] == "val"]
        i = int(pdf["trial"].iloc[0])
        out = boosted(train, val, columns, lags[i], settings[i])
        return pd.DataFrame({"trial": val["trial"].astype("int32"), "actual": val["sales"].astype(float), "forecast": out["forecast"]})

    return one


_TRIAL = "trial int, changepoint_prior_scale double, learning_rate double, depth int, lags string"


def tune(sliced: DataFrame, keys: list[str], columns: list[str], known: list[str], lag_sets: dict[str, list[int]], n_trials: int = 5, batch: int = 5, seed: int = 42, config: BaseConfig | None = None) -> DataFrame:
    """Search over four values of the hybrid model: (trial, its values, wape, tracking, objective).

    ``lag_sets`` has the own lags of each choice. A batch of trials is rows of one plan, so its fits run side by side; the next
    batch is drawn by what the earlier ones told. A batch's scores, a row a trial, come to the driver.
    """
    from dataclasses import replace

    base, spark = config or BaseConfig(), sliced.sparkSession
    sampler, told = ParzenSampler(search_space(list(lag_sets)), seed), []
    by, longest = [*keys, "window", "trial"], sorted({abs(n) for lags in lag_sets.values() for n in lags})
    own = [f"own_lag_{n}" for n in longest]
    sliced = kept(sliced.select(*dict.fromkeys([*keys, "window", "date", "sales", "split", "train_end", "route", *columns, *known])), "sliced")
    while len(told) < n_trials:
        drawn = {len(told) + i: sampler.ask() for i in range(min(batch, n_trials - len(told)))}
        settings = {i: replace(base, trend=replace(base.trend, changepoint_prior_scale=v["changepoint_prior_scale"]), boost=replace(base.boost, learning_rate=v["learning_rate"], depth=v["depth"])) for i, v in drawn.items()}
        each = sliced.withColumn("trial", F.explode(F.array(*map(F.lit, drawn))))
        frame = own_targets(each, by, longest, known, base, lambda pdf, s=settings: s[int(pdf["trial"].iloc[0])])

        need = list(dict.fromkeys([*by, "date", "sales", "split", "target", "base", "method", "lam", "shift", "last_value", *columns, *own]))
        lags = {i: [f"own_lag_{abs(n)}" for n in lag_sets[v["lags"]]] for i, v in drawn.items()}
        out = forecast.dealt(frame.select(*need), by).groupBy(*by).applyInPandas(_trial_forecasts(columns, lags, settings), "trial int, actual double, forecast double")
        e = F.abs(F.col("actual") - F.col("forecast"))
        s = out.groupBy("trial").agg((F.try_divide(F.sum(e), F.sum(F.abs("actual"))) * 100).alias("wape"), F.coalesce(F.try_divide(F.sum(F.col("actual") - F.col("forecast")), F.avg(e)), F.lit(0.0)).alias("tracking"))
        s = s.withColumn("objective", F.col("wape") + F.when(F.abs("tracking") > 4, 1000.0).otherwise(0.0))
        scores = {r.trial: (r.wape, r.tracking, r.objective) for r in s.collect()}
        for i, v in drawn.items():
            row = scores.get(i, (None, None, None))
            sampler.tell(v, row[2])
            told.append((i, v["changepoint_prior_scale"], v["learning_rate"], v["depth"], v["lags"], *row))
    return spark.createDataFrame(told, _TRIAL + ", wape double, tracking double, objective double")
