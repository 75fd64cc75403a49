"""Stationarity (ADF, KPSS), differencing order and Ljung-Box by series."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: KPSS level quantiles (1992); response surfaces of the Dickey-Fuller t with a constant, in powers of 1 / n
#: (MacKinnon 2010); its approximate distribution below and above -1.61, and where it is 0 and 1 (MacKinnon 1994).
KPSS_QUANTILES = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
DF_SURFACE = {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.040), "10%": (-2.56677, -1.5384, -2.809, 0.0)}
DF_SMALL, DF_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
DF_TURN, DF_LEAST, DF_MOST = -1.61, -18.83, 2.74


def df_critical_values(n: int) -> dict[str, float]:
    """Critical values of the Dickey-Fuller t for ``n`` regression rows."""
    return {level: sum(b / n**i for i, b in enumerate(surface)) for level, surface in DF_SURFACE.items()}


def df_p_value(t: float) -> float:
    if t <= DF_LEAST or t >= DF_MOST:
        return float(t >= DF_MOST)
    return NormalDist().cdf(sum(b * t**i for i, b in enumerate(DF_SMALL if t <= DF_TURN else DF_LARGE)))


def _ols_t(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """t of the first coefficient, and AIC."""
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ b
    n, k = x.shape
    s2 = max(float(e @ e) / max(n - k, 1), 1e-300)
    cov = s2 * np.linalg.pinv(x.T @ x)
    return float(b[0] / math.sqrt(max(cov[0, 0], 1e-300))), n * math.log(max(float(e @ e) / n, 1e-300)) + 2 * k


def adf(y: np.ndarray) -> tuple[float, float, int]:
    """(statistic, p, regression rows) of the augmented Dickey-Fuller test with a constant, lags by AIC."""
    if len(y) < 3:
        raise ValueError("fewer than 3 values")
    if not np.isfinite(y).all():
        raise ValueError("values that aren't finite")
    if np.ptp(y) == 0:
        return 0.0, 1.0, len(y) - 1
    d = np.diff(y)
    most = max(0, min(int(np.ceil(12 * (len(y) / 100) ** 0.25)), len(y) // 2 - 2))

    def design(lags, start):
        return np.column_stack([y[start:-1], np.ones(len(d) - start), *[d[start - i : len(d) - i] for i in range(1, lags + 1)]]), d[start:]

    lags = min(range(most + 1), key=lambda k: _ols_t(*design(k, most))[1])
    t = _ols_t(*design(lags, lags))[0]
    return t, df_p_value(t), len(d) - lags


def kpss_lags(e: np.ndarray) -> int:
    """Bandwidth of the Bartlett kernel from the data (Hobijn, Franses and Ooms 1998)."""
    n = len(e)
    cov = [float(e[k:] @ e[: n - k]) / n for k in range(int(n ** (2 / 9)) + 1)]
    s0, s1 = cov[0] + 2 * sum(cov[1:]), 2 * sum(k * c for k, c in enumerate(cov))
    if s0 == 0:
        return 0
    return int(min(np.floor(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1))


def kpss(y: np.ndarray) -> tuple[float, float]:
    """(statistic, p) of the KPSS test around a level; p stays within 0.01 to 0.1."""
    n = len(y)
    e = y - y.mean()
    lags = kpss_lags(e)
    s2 = e @ e / n + 2 / n * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))
    stat = float((np.cumsum(e) ** 2).sum() / n**2 / s2) if s2 > 0 else 0.0
    return stat, float(np.interp(stat, [q for q, _ in KPSS_QUANTILES], [p for _, p in KPSS_QUANTILES]))


def verdict(adf_p: float, kpss_p: float, alpha: float = 0.05) -> str:
    a, k = adf_p < alpha, kpss_p >= alpha
    return {(True, True): "stationary", (False, False): "non-stationary", (False, True): "trend-stationary", (True, False): "difference-stationary"}[a, k]


def differencing_order(y: np.ndarray, most: int = 2) -> int:
    for d in range(most + 1):
        if len(y) < 3:
            return max(d - 1, 0)
        if verdict(adf(y)[1], kpss(y)[1]) in ("stationary", "trend-stationary"):
            return d
        y = np.diff(y)
    return most


def series_label(keys: list[str]) -> Column:
    """A series' keys as one text."""
    return F.concat_ws(" | ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])


_STATIONARITY = "group string, adf_p double, kpss_p double, verdict string, recommended_d long, adf_critical_values map<string,double>, error string"


def stationarity(df: DataFrame, keys: list[str], target: str = "sales") -> DataFrame:
    """(group, adf_p, kpss_p, verdict, recommended_d, maps of critical values, error) of each series of 3 values or more.

    Critical values of the Dickey-Fuller t follow the number of rows. A series that can't be analysed is a row that holds its
    error and nothing else; it doesn't end the job.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {"group": pdf["_g"].iloc[0], "adf_p": None, "kpss_p": None, "verdict": None, "recommended_d": None, "adf_critical_values": None, "error": None}
        try:
            y = pdf.sort_values("date")[target].dropna().to_numpy(float)
            if len(y) < 3:
                return pd.DataFrame(columns=list(row))
            (_, a, n), k = adf(y), kpss(y)[1]
            row |= {"adf_p": a, "kpss_p": k, "verdict": verdict(a, k), "recommended_d": differencing_order(y), "adf_critical_values": df_critical_values(n)}
        except (ValueError, TypeError, ArithmeticError, np.linalg.LinAlgError) as e:
            row["error"] = f"{type(e).__name__}: {e}"
        return pd.DataFrame([row])

    named = df.select(series_label(keys).alias("_g"), "date", target)
    kpss_values = F.create_map(*[F.lit(x) for q, p in KPSS_QUANTILES for x in (f"{p * 100:g}%", q)])
    out = named.groupBy("_g").applyInPandas(one, _STATIONARITY)
    return out.withColumn("kpss_critical_values", F.when(F.col("error").isNull(), kpss_values))


def ljung_box(df: DataFrame, keys: list[str], target: str = "sales", lags: int = 14) -> DataFrame:
    """(keys, n, q_stat, p_value, white_noise): autocorrelations by lag windows, chi-square tail in closed form (even lags)."""
    if lags % 2:
        raise ValueError("lags must be even")
    w, mean = W.partitionBy(*keys).orderBy("date"), F.avg(target).over(W.partitionBy(*keys))
    e = df.where(f"{target} is not null").withColumn("_e", F.col(target) - mean)
    e = e.withColumns({f"_l{k}": F.lag("_e", k).over(w) for k in range(1, lags + 1)})
    s = e.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("_e") * F.col("_e")).alias("v"), *[F.sum(F.col("_e") * F.col(f"_l{k}")).alias(f"c{k}") for k in range(1, lags + 1)]).where(F.col("n") > lags)
    n = F.col("n").cast("double")
    q = n * (n + 2) * sum(F.pow(F.try_divide(F.col(f"c{k}"), F.col("v")), 2) / (n - k) for k in range(1, lags + 1))
    x = F.col("q_stat") / 2
    tail = F.exp(-x) * sum(F.pow(x, i) / math.factorial(i) for i in range(lags // 2))
    return s.select(*keys, "n", q.alias("q_stat")).withColumn("p_value", tail).withColumn("white_noise", F.col("p_value") > 0.05)
