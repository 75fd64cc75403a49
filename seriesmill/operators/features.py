"""Leak-checked features: lags, rolling and expanding statistics, promotion, oil and transactions.

Each feature column carries its role and lag in its metadata; ``leaks`` reads these and the names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window as W

from ..config import FeatureConfig
from ..functions.dates import add_calendar

_LAG = re.compile(r"(?:^|_)lag_?(\d+)")


def safe_lags(lags: list[int] | None, horizon: int) -> list[int]:
    """Lags no shorter than the horizon; the horizon itself if none is left."""
    kept = [n for n in (lags or [1, 7, 14, 28]) if n >= horizon]
    return kept or [horizon]


def _order(keys: list[str]):
    return W.partitionBy(*keys).orderBy("date")


def _tag(c: Column, name: str, role: str, lag: int | None) -> Column:
    return c.alias(name, metadata={"role": role, "lag": -1 if lag is None else lag})


def _stat(name: str, c: Column, frame) -> Column:
    if name == "median":
        return F.percentile(c, 0.5).over(frame)
    kinds = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    if name not in kinds:
        raise ValueError(f"unknown statistic {name!r}")
    return kinds[name](c).over(frame)


def add_lags(df: DataFrame, keys: list[str], lags: list[int] | None, horizon: int, target: str = "sales", prefix: str = "lag") -> DataFrame:
    if target not in df.columns:
        raise KeyError(target)
    w = _order(keys)
    return df.select("*", *[_tag(F.lag(target, n).over(w), f"{prefix}_{n}", "shifted", n) for n in safe_lags(lags, horizon)])


def add_rolling(df: DataFrame, keys: list[str], base_lags: list[int], windows: list[int], functions: list[str], horizon: int, target: str = "sales") -> DataFrame:
    """rolling_{f}_lag{N}_w{W}: statistics of the W latest rows of the target's lag N."""
    bases = safe_lags(base_lags, horizon)
    made = {n: f"lag_{n}" if f"lag_{n}" in df.columns else f"_lag_{n}" for n in bases}
    fresh = [F.lag(target, n).over(_order(keys)).alias(c) for n, c in made.items() if c.startswith("_")]
    if not (bases and windows and functions):
        raise RuntimeError("no rolling features")
    out = df.select("*", *fresh)
    cols = [_tag(_stat(f, F.col(c), _order(keys).rowsBetween(1 - w, 0)), f"rolling_{f}_lag{n}_w{w}", "shifted", n) for n, c in made.items() for w in windows for f in functions]
    return out.select("*", *cols).drop(*[c for c in made.values() if c.startswith("_")])


def add_expanding(df: DataFrame, keys: list[str], functions: list[str], min_periods: int, horizon: int, target: str = "sales") -> DataFrame:
    """expanding_{f} of the smallest lag that reaches the horizon; null until ``min_periods`` values."""
    have = sorted(int(c[4:]) for c in df.columns if re.fullmatch(r"lag_\d+", c) and int(c[4:]) >= horizon)
    lag = have[0] if have else horizon
    out = df if have else df.withColumn("_base", F.lag(target, horizon).over(_order(keys)))
    base = F.col(f"lag_{lag}" if have else "_base")
    frame = _order(keys).rowsBetween(W.unboundedPreceding, 0)
    bad = set(functions) - {"mean", "std"}
    if bad:
        raise ValueError(f"unknown statistics {sorted(bad)}")
    return out.select("*", *[_tag(F.when(F.count(base).over(frame) >= min_periods, _stat(f, base, frame)), f"expanding_{f}", "shifted", lag) for f in functions]).drop("_base")


def add_emas(df: DataFrame, c: str, spans: list[int], keys: list[str], name) -> DataFrame:
    """Exponential means of ``c`` as columns ``name(span)``: weights (1 - a)^i, a = 2 / (span + 1), down to under 1e-12.

    A scan by doubling: after k steps a row holds the weighted sum of its last 2^k rows, and takes in that of the row 2^k
    back. All spans share the steps, one sort serves them, and the weights' sum has a closed form. ``c`` holds no nulls.
    """
    w = _order(keys)
    decay = {n: 1 - 2.0 / (n + 1) for n in spans}
    out = df.withColumns({f"_ema_{n}": F.col(c).cast("double") for n in spans} | {"_row": F.row_number().over(w)})
    reach = 1
    while any(d**reach >= 1e-12 for d in decay.values()):
        more = {n: d for n, d in decay.items() if d**reach >= 1e-12}
        out = out.withColumns({f"_ema_{n}": F.col(f"_ema_{n}") + d**reach * F.coalesce(F.lag(f"_ema_{n}", reach).over(w), F.lit(0.0)) for n, d in more.items()})
        reach *= 2
    means = [_tag(F.col(f"_ema_{n}") * (1 - d) / (1 - F.pow(F.lit(d), "_row")), name(n), "planned", None) for n, d in decay.items()]
    return out.select("*", *means).drop("_row", *[f"_ema_{n}" for n in spans])


def add_external(df: DataFrame, keys: list[str], oil_lags: list[int], horizon: int, promotion: bool = True, transactions: bool = True) -> DataFrame:
    """Oil lags, planned promotions (lead, lag, sums, maxima, exponential means), and the transactions' lag."""
    w, cols = _order(keys), []
    if "dcoilwtico" in df.columns:
        cols += [_tag(F.lag("dcoilwtico", n).over(w), f"oil_lag_{n}", "planned", n) for n in safe_lags(oil_lags, horizon)]
    if promotion and "onpromotion" in df.columns:
        p = F.coalesce("onpromotion", F.lit(0.0))
        df = df.withColumn("onpromotion", p)
        cols += [_tag(F.coalesce(F.lead("onpromotion", 1).over(w), F.lit(0.0)), "onpromotion_lead_1", "planned", None), _tag(F.coalesce(F.lag("onpromotion", 1).over(w), F.lit(0.0)), "onpromotion_lag_1", "planned", None)]
        cols.append(_tag(F.sum("onpromotion").over(w.rowsBetween(-6, 0)), "onpromotion_roll_sum_7", "planned", None))
        for n in (3, 7, 14):
            cols.append(_tag(F.max("onpromotion").over(w.rowsBetween(1 - n, 0)), f"onpromotion_roll_max_{n}", "planned", None))
        df = add_emas(df, "onpromotion", [3, 7, 14], keys, "onpromotion_ema_{}".format)
    if transactions and "transactions" in df.columns:
        cols.append(_tag(F.lag("transactions", horizon).over(w), f"transactions_lag_{horizon}", "shifted", horizon))
    return df.select("*", *cols)


def build(df: DataFrame, keys: list[str], horizon: int = 28, config: FeatureConfig | None = None, validate: bool = True) -> DataFrame:
    """All features of a panel. One exchange on the series key and one sort serve every window."""
    c = config or FeatureConfig()
    out = add_external(add_calendar(df, c.calendar), keys, c.oil_lags, horizon, c.include_promotion, c.include_transactions)
    out = add_lags(out, keys, c.lags, horizon)
    out = add_rolling(out, keys, c.rolling_base_lags, c.rolling_windows, c.rolling_functions, horizon)
    out = add_expanding(out, keys, c.expanding_functions, c.expanding_min_periods, horizon)
    if validate and leaks(out, horizon):
        raise ValueError(f"Leakage validation failed: {leaks(out, horizon)}")
    return out


def drop_warmup(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have all of ``columns``; a column that isn't there is an error."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"no columns {missing}")
    return df.na.drop(subset=columns)


def numeric(df: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` and all numeric ones."""
    return df.select(*[f.name for f in df.schema if f.name in keep or isinstance(f.dataType, NumericType)])


def leaks(df: DataFrame, horizon: int) -> list[str]:
    """Feature columns whose lag, by metadata or by name, is shorter than the horizon; planned promotions may look ahead."""
    bad = []
    for f in df.schema.fields:
        m = _LAG.search(f.name)
        lag = f.metadata.get("lag", -1)
        lag = int(m[1]) if lag < 0 and m else lag
        if not f.name.startswith("onpromotion_") and 0 <= lag < horizon:
            bad.append(f.name)
    return bad


def covariates(df: DataFrame, role: str) -> list[str]:
    """Names of feature columns by role (planned or shifted); calendar columns are planned."""
    calendar = [c for c in add_calendar(df.select("date").limit(0)).columns if c != "date" and c in df.columns] if role == "planned" else []
    return calendar + [f.name for f in df.schema.fields if f.metadata.get("role") == role]


def expanding_check(df: DataFrame, keys: list[str], horizon: int, min_periods: int = 28, target: str = "sales") -> DataFrame:
    """For each series: does ``expanding_mean`` equal the mean of the shifted target, and not that of the raw one?"""
    frame = _order(keys).rowsBetween(W.unboundedPreceding, 0)
    out = df.withColumn("_b", F.lag(target, horizon).over(_order(keys)))
    out = out.select(*keys, "expanding_mean", F.when(F.count("_b").over(frame) >= min_periods, F.avg("_b").over(frame)).alias("shifted"), F.avg(target).over(frame).alias("raw"))
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-8 + 1e-5 * F.abs(F.col(b))
    return out.where("expanding_mean is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.bool_and(close("expanding_mean", "shifted")).cast("int").alias("matches_shifted"), F.bool_and(close("expanding_mean", "raw")).cast("int").alias("matches_raw"))
