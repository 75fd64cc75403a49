"""Reversible target transforms: parameters by group, columns by expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

METHODS = ("difference", "log", "box_cox", "none")
EDGE = 1e-6


def boxcox(x: Column, lam: Column, shift: Column | float = 0.0) -> Column:
    s = x + shift
    return F.when(lam == 0, F.log(s)).otherwise((F.pow(s, lam) - 1) / F.when(lam == 0, F.lit(1.0)).otherwise(lam))


def clip_to_domain(y: Column, lam: Column) -> Column:
    """The nearest value that has an inverse; unchanged for lambda 0."""
    edge = F.try_divide(F.lit(-1.0), lam)
    return F.when(lam < 0, F.least(y, edge - EDGE)).when(lam > 0, F.greatest(y, edge + EDGE)).otherwise(y)


def inverse_boxcox(y: Column, lam: Column, shift: Column | float = 0.0) -> Column:
    safe = F.when(lam == 0, F.lit(1.0)).otherwise(lam)
    return F.when(lam == 0, F.exp(y)).otherwise(F.pow(clip_to_domain(y, lam) * safe + 1, 1 / safe)) - shift


def boxcox_likelihood(x: np.ndarray, lam: float) -> float:
    """Gaussian profile log-likelihood (Box and Cox 1964)."""
    logs = np.log(x)
    y = logs if abs(lam) < 1e-12 else np.expm1(lam * logs) / lam
    v = y.var()
    return -np.inf if v <= 0 or not np.isfinite(v) else (lam - 1) * logs.sum() - len(x) / 2 * np.log(v)


def boxcox_lambda(x: np.ndarray, lo: float = -2.0, hi: float = 2.0) -> float:
    """Maximum-likelihood lambda by golden section."""
    g = (np.sqrt(5) - 1) / 2
    a, b = lo, hi
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = boxcox_likelihood(x, c), boxcox_likelihood(x, d)
    while b - a > 1e-7:
        if fc > fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = boxcox_likelihood(x, c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = boxcox_likelihood(x, d)
    return (a + b) / 2


def boxcox_policy(df: DataFrame, keys: list[str], target: str = "sales") -> DataFrame:
    """(keys, n, n_finite, is_constant, shift, method): what box_cox comes to in each group, from aggregates of its finite
    values alone: a shift of 1 where one isn't positive; for a constant, log, or none if it is negative."""
    x = F.col(target)
    good = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    s = df.groupBy(*keys).agg(F.count(x).alias("n"), F.count(good).alias("n_finite"), F.min(good).alias("a"), F.max(good).alias("b"))
    s = s.withColumn("is_constant", F.col("b") - F.col("a") <= 1e-8)
    method = F.when(~F.col("is_constant"), "box_cox").when(F.col("a") >= 0, "log").when(F.col("a") < 0, "none")
    return s.select(*keys, "n", "n_finite", "is_constant", F.when(~F.col("is_constant") & (F.col("a") <= 0), 1.0).otherwise(0.0).alias("shift"), method.alias("method"))


def fit_values(x: np.ndarray, method: str) -> dict:
    """Parameters of one series: the method in force, lambda, shift, first and last value, size."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    x = np.asarray(x, float)
    if not len(x):
        raise ValueError("empty series")
    out = {"method": method, "lam": 1.0, "shift": 0.0, "first_value": float(x[0]), "last_value": float(x[-1]), "fit_size": len(x)}
    if method == "log" and x.min() < 0:
        raise ValueError("log needs values of 0 or more")
    if method == "box_cox":
        shift = 1.0 if x.min() <= 0 else 0.0
        if x.min() + shift <= 0:
            raise ValueError("box_cox needs values over -1")
        if np.ptp(x) <= 1e-8:
            return out | {"method": "log" if x.min() >= 0 else "none"}
        return out | {"lam": boxcox_lambda(x + shift), "shift": shift}
    return out


def forward_values(x: np.ndarray, params: dict) -> np.ndarray:
    """One series under fitted parameters; a difference is one value shorter."""
    m, lam = params["method"], params["lam"]
    if m == "difference":
        return np.diff(x)
    if m == "log":
        return np.log1p(x)
    if m == "box_cox":
        s = np.asarray(x, float) + params["shift"]
        return np.log(s) if abs(lam) < 1e-12 else np.expm1(lam * np.log(s)) / lam
    return np.asarray(x, float)


def inverse_values(y: np.ndarray, params: dict, anchor: float | None = None) -> np.ndarray:
    """Back to the series' units, values outside the transform's range at its edge; ``anchor`` is the level before a difference."""
    m, lam = params["method"], params["lam"]
    if m == "difference":
        if anchor is None or not np.isfinite(anchor):
            raise ValueError("a difference needs the last observed level")
        return anchor + np.cumsum(y)
    if m == "log":
        return np.expm1(y)
    if m == "box_cox":
        if abs(lam) < 1e-12:
            return np.exp(y) - params["shift"]
        edge = -1 / lam
        y = np.minimum(y, edge - EDGE) if lam < 0 else np.maximum(y, edge + EDGE)
        return np.power(y * lam + 1, 1 / lam) - params["shift"]
    return np.asarray(y, float)


PARAMS = "method string, lam double, shift double, first_value double, last_value double, fit_size long"


#: Lambdas tried on either side of a centre, and their distance in each pass over the data.
GRID, STEPS = 16, (2 / 16, 2 / 16**2, 2 / 16**3)


def boxcox_lambdas(df: DataFrame, keys: list[str], logs: str) -> DataFrame:
    """(keys, lam): the maximum-likelihood lambda in -2 to 2 of each group, from its values' logarithms ``logs``.

    A pass is one aggregate of all groups and of all lambdas of a grid: Gaussian profile log-likelihoods (Box and Cox 1964) from
    the transform's variance, which tasks merge. Passes narrow the grid round each group's best lambda; the top of the parabola
    through the last three points is the answer. No group is gathered anywhere; a pass joins a row a group to the data.
    """
    centre = None
    for step in STEPS:
        rows = df.select(*keys, F.col(logs).alias("_x"), F.lit(0.0).alias("_c")) if centre is None else df.select(*keys, F.col(logs).alias("_x")).join(centre, keys)
        rows = rows.select(*keys, "_x", "_c", F.explode(F.sequence(F.lit(-GRID), F.lit(GRID))).alias("_k")).withColumn("_l", F.col("_c") + F.col("_k") * step)
        boxed = F.when(F.abs("_l") < 1e-12, F.col("_x")).otherwise(F.expm1(F.col("_l") * F.col("_x")) / F.when(F.abs("_l") < 1e-12, F.lit(1.0)).otherwise(F.col("_l")))
        tried = rows.groupBy(*keys, "_c", "_k").agg(F.count("*").alias("_n"), F.sum("_x").alias("_s"), F.var_pop(boxed).alias("_v"))
        value = F.when(F.col("_v") > 0, (F.col("_c") + F.col("_k") * step - 1) * F.col("_s") - F.col("_n") / 2 * F.log("_v"))
        best = tried.withColumn("_f", value).where("_f is not null").groupBy(*keys, "_c").agg(F.max(F.struct("_f", (-F.col("_k")).alias("k"))).alias("_top"), F.map_from_entries(F.collect_list(F.struct("_k", "_f"))).alias("_all"))
        k, f = -F.col("_top.k"), F.col("_top._f")
        moved = k
        if step == STEPS[-1]:
            a, c = (F.try_element_at("_all", (k + d).cast("int")) for d in (-1, 1))
            moved = k + F.coalesce(F.try_divide(a - c, 2 * (a - 2 * f + c)), F.lit(0.0))
        centre = best.select(*keys, F.greatest(F.least(F.col("_c") + moved * step, F.lit(2.0)), F.lit(-2.0)).alias("_c"))
    return centre.withColumnRenamed("_c", "lam")


def fit(df: DataFrame, keys: list[str], method: str, target: str = "sales") -> DataFrame:
    """Parameters of each group (``PARAMS``), from aggregates alone: a group may be of any size.

    Negative values under ``log``, and values of -1 or less under ``box_cox``, are errors when the rows are read.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    x = F.col(target)
    good = df.where(x.isNotNull() & ~F.isnan(x)).select(*keys, "date", x.cast("double").alias(target))
    ends = good.groupBy(*keys).agg(F.min_by(target, "date").alias("first_value"), F.max_by(target, "date").alias("last_value"), F.count("*").alias("fit_size"), F.min(target).alias("_lo"), F.max(target).alias("_hi"))
    text, zero = F.lit(method), F.lit(0.0)
    lam, shift = F.lit(1.0), zero
    if method == "log":
        text = F.when(F.col("_lo") >= 0, text).otherwise(F.raise_error(F.lit("log needs values of 0 or more")))
    if method == "box_cox":
        low = F.when(F.col("_lo") <= 0, 1.0).otherwise(0.0)
        varied = F.col("_hi") - F.col("_lo") > 1e-8
        text = F.when(F.col("_lo") + low <= 0, F.raise_error(F.lit("box_cox needs values over -1"))).when(varied, text).when(F.col("_lo") >= 0, F.lit("log")).otherwise(F.lit("none"))
        shift = F.when(varied, low).otherwise(zero)
        own = good.join(ends.where(varied & (F.col("_lo") + low > 0)).select(*keys, low.alias("_shift")), keys).select(*keys, F.log(F.col(target) + F.col("_shift")).alias("_log"))
        ends = ends.join(boxcox_lambdas(own, keys, "_log"), keys, "left")
        lam = F.coalesce("lam", F.lit(1.0))
    return ends.select(*keys, text.alias("method"), lam.alias("lam"), shift.alias("shift"), "first_value", "last_value", "fit_size")


def transform(df: DataFrame, params: DataFrame, keys: list[str], target: str = "sales", out: str = "transformed") -> DataFrame:
    """Apply fitted parameters; under ``difference`` a series' first row goes."""
    joined = df.join(params, keys)
    x, m = F.col(target), F.col("method")
    prev = F.lag(target).over(W.partitionBy(*keys).orderBy("date"))
    done = joined.withColumns({out: F.when(m == "log", F.log1p(x)).when(m == "box_cox", boxcox(x, F.col("lam"), F.col("shift"))).when(m == "difference", x - prev).otherwise(x), "_first": prev.isNull()})
    return done.where("not (method = 'difference' and _first)").drop("_first")


def invert(df: DataFrame, keys: list[str], value: str = "transformed", out: str = "restored", anchor: str = "first_value") -> DataFrame:
    """Undo ``transform`` for rows that carry its parameters; ``anchor`` is the level before the first difference, and a null
    one is an error when the rows are read."""
    y, m = F.col(value), F.col("method")
    total = F.sum(value).over(W.partitionBy(*keys).orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    level = F.when(F.col(anchor).isNull() | F.isnan(F.col(anchor)), F.raise_error(F.lit("a difference needs the last observed level")).cast("double")).otherwise(F.col(anchor))
    return df.withColumn(out, F.when(m == "log", F.expm1(y)).when(m == "box_cox", inverse_boxcox(y, F.col("lam"), F.col("shift"))).when(m == "difference", level + total).otherwise(y))


def round_trip_error(df: DataFrame, keys: list[str], method: str, target: str = "sales", tolerance: float | None = None) -> DataFrame:
    """(keys, max_error) of transform and inverse; an error over ``tolerance`` fails when the rows are read."""
    done = invert(transform(df, fit(df, keys, method, target), keys, target), keys)
    worst = F.max(F.abs(F.col(target) - F.col("restored")))
    out = done.groupBy(*keys).agg(worst.alias("max_error"))
    if tolerance is None:
        return out
    failed = F.raise_error(F.concat(F.lit(f"{method} doesn't round-trip within {tolerance}: "), F.col("max_error").cast("string"))).cast("double")
    return out.withColumn("max_error", F.when(F.col("max_error") <= tolerance, F.col("max_error")).otherwise(failed))


def fit_transform(df: DataFrame, keys: list[str], method: str, target: str = "sales", out: str = "transformed", tolerance: float = 1e-5) -> DataFrame:
    """``transform`` with its parameters fitted, of series that round-trip within ``tolerance``; another is an error."""
    params = fit(df, keys, method, target)
    checked = invert(transform(df, params, keys, target, out), keys, out, "_back")
    off = F.abs(F.col("_back") - F.col(target)) > tolerance * F.greatest(F.lit(1.0), F.abs(target))
    return checked.withColumn(out, F.when(off, F.raise_error(F.lit(f"{method} doesn't round-trip within {tolerance}")).cast("double")).otherwise(F.col(out))).drop("_back")
