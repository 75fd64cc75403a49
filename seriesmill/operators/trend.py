"""The trend-and-season model: a piecewise-linear trend with sparse change points, Fourier seasons, holidays and regressors.

Maximum a posteriori fit (after Taylor and Letham 2018): Laplace priors on the changes of slope, which leave most of them at
exactly 0, normal priors on everything else, the noise's variance found along the way. The fit reads nothing but moments:
sums of t^m z z' (m = 0, 1, 2) over the stretches between change points, where z holds 1, the season columns and the target.
A trend is linear in t on a stretch, so both an additive and a multiplicative model's normal equations follow from them.
Moments of prefixes are differences of one running sum, so all rolling origins of a series are fitted from one pass over it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from ..config import TrendConfig
from ..functions.dates import holiday_design

#: Change points and the share of the history that holds them, Fourier orders by period in days, and prior scales.
CHANGE_POINTS, CHANGE_RANGE = 25, 0.8
ORDERS = (("yearly_seasonality", 365.25, 10), ("weekly_seasonality", 7.0, 3), ("daily_seasonality", 1.0, 4))
TREND_SCALE, SEASON_SCALE = 5.0, 10.0
#: Days between kept running sums; rounds of the fit; days that make one unit of t inside the moments.
GRID, ROUNDS, UNIT = 16, 6, 1000.0


def seasonality_mode(y: np.ndarray, configured: str) -> str:
    return "additive" if configured == "multiplicative" and len(y) and np.min(y) <= 0 else configured


def change_points(n: int) -> np.ndarray:
    """Positions of change points in a history of ``n`` days, ascending and distinct."""
    most = int(np.floor(n * CHANGE_RANGE))
    return np.unique(np.round(np.linspace(0, max(most - 1, 0), min(CHANGE_POINTS, max(most - 1, 0)) + 1)).astype(int))[1:]


def sparse_solve(a: np.ndarray, c: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """argmin b'ab / 2 - c'b + sum penalty |b|, exactly (an active set as of Lawson and Hanson); 0 penalty leaves b free."""
    n, free = len(c), penalty == 0
    sign = np.zeros(n)
    b, sign_free = np.zeros(n), free.copy()
    # relative to each coefficient's own scale
    tol = 1e-10 * (np.abs(c) + penalty + 1e-12)
    for _ in range(20 * n):
        on = sign_free | (sign != 0)
        while on.any():
            s = np.zeros(n)
            s[on] = np.linalg.solve(a[np.ix_(on, on)], (c - penalty * sign)[on])
            wrong = on & ~free & (s * sign <= 0)
            if not wrong.any():
                b = s
                break
            # step until the first coefficient reaches 0, and drop it
            share = np.where(wrong, b / np.where(wrong, b - s, 1.0), np.inf)
            j = int(np.argmin(share))
            b = b + min(max(share[j], 0.0), 1.0) * (s - b)
            b[j], sign[j] = 0.0, 0.0
            on = sign_free | (sign != 0)
        pull = c - a @ b
        over = np.where(~free & (sign == 0), np.abs(pull) - penalty - tol, -np.inf)
        j = int(np.argmax(over))
        if over[j] <= 0:
            break
        sign[j] = np.sign(pull[j])
    return b


def season_columns(dates, config: TrendConfig) -> tuple[np.ndarray, np.ndarray]:
    """Fourier and holiday columns of days from the first one on, and the length of history that each needs."""
    d = pd.DatetimeIndex(np.asarray(dates, "datetime64[D]"))
    day = (d - d[0]).days.to_numpy().astype(float)
    out, need = [], []
    for name, period, order in ORDERS:
        for k in range(1, order + 1) if getattr(config, name) else ():
            out += [np.sin(2 * np.pi * k * day / period), np.cos(2 * np.pi * k * day / period)]
            need += [period, period]
    holidays = holiday_design(d, config.holidays_country)
    return np.column_stack([*out, holidays]) if out else holidays, np.array(need + [0.0] * holidays.shape[1])


class Moments:
    """Running sums of t^m z z' over a series' days, kept every ``GRID`` days; any day's is put together from the next ones."""

    def __init__(self, z: np.ndarray):
        self.z, n = z, len(z)
        self.t = np.arange(n) / UNIT
        cuts = range(0, n, GRID)
        steps = np.stack([self._sum(i, min(i + GRID, n)) for i in cuts])
        self.kept = np.concatenate([np.zeros((1, *steps.shape[1:])), steps.cumsum(axis=0)])

    def _sum(self, lo: int, hi: int) -> np.ndarray:
        z, t = self.z[lo:hi], self.t[lo:hi, None]
        return np.stack([z.T @ z, (t * z).T @ z, (t * t * z).T @ z])

    def until(self, n: int) -> np.ndarray:
        """Sums over the first ``n`` days."""
        i = n // GRID
        return self.kept[i] + self._sum(i * GRID, n) if n % GRID else self.kept[i]

    def stretches(self, cuts) -> np.ndarray:
        """Sums between consecutive cuts."""
        return np.diff(np.stack([self.until(int(c)) for c in cuts]), axis=0)


class TrendFit:
    """A model fitted to the first ``n`` days from their moments. ``z`` columns: 1, seasons, regressors, target."""

    def __init__(self, moments: Moments, n: int, need: np.ndarray, n_regressors: int, mode: str, size: float, config: TrendConfig):
        self.n, self.size, self.mult = n, max(size, 1e-9), mode == "multiplicative"
        self.knots = change_points(n)
        m = moments.stretches([0, *self.knots, n])
        p = m.shape[2] - 2
        whole = m.sum(axis=0)
        # columns that the history is long enough for; regressors by their mean and deviation within it
        self.take = np.concatenate([np.flatnonzero(n - 1 >= need), len(need) + np.arange(n_regressors)])
        shift, scale = np.zeros(p), np.ones(p)
        own = 1 + len(need) + np.arange(n_regressors)
        mean = whole[0, 0, own] / n
        var = np.maximum(np.diagonal(whole[0])[own] / n - mean**2, 0.0)
        varied = var > 1e-12 * (mean**2 + 1e-12)
        shift[own - 1], scale[own - 1] = mean, np.where(varied, np.sqrt(np.where(varied, var, 1.0)), 1.0)
        self.shift, self.scale = shift[self.take], scale[self.take]
        # to 1, standardised columns, and the target in units of its size
        at, off, unit = np.concatenate([[0], 1 + self.take, [p + 1]]), np.concatenate([[0], self.shift, [0]]), np.concatenate([[1], self.scale, [self.size]])
        m = m[:, :, at][..., at]
        m = (m - off[:, None] * m[:, :, :1] - m[..., :1] * off + off[:, None] * off * m[:, :, :1, :1]) / (unit[:, None] * unit)
        self._fit(m, config)

    def _trend_rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Trend columns on each stretch as a + b t."""
        span = max(self.n - 1, 1) / UNIT
        k = self.knots / UNIT
        on = np.tri(len(k) + 1, len(k), -1)
        a = np.column_stack([np.ones(len(k) + 1), np.zeros(len(k) + 1), -on * k / span])
        b = np.column_stack([np.zeros(len(k) + 1), np.full(len(k) + 1, 1 / span), on / span])
        return a, b

    def _fit(self, m: np.ndarray, config: TrendConfig) -> None:
        a, b = self._trend_rows()
        n, k, p = self.n, a.shape[1], m.shape[2] - 2
        one, seasons, target = 0, slice(1, p + 1), p + 1

        def trend_gram(w):  # sums of weights w (stretch, m)
            return np.einsum("q,qi,qj->ij", w[:, 0], a, a) + np.einsum("q,qi,qj->ij", w[:, 1], a, b) + np.einsum("q,qi,qj->ij", w[:, 1], b, a) + np.einsum("q,qi,qj->ij", w[:, 2], b, b)

        def trend_side(u):
            return u[:, 0] @ a + u[:, 1] @ b

        total = m.sum(axis=0)[0]
        yy = total[target, target]
        noise = max(yy / n - (total[one, target] / n) ** 2, 1e-8)
        season = np.zeros(p)
        for _ in range(ROUNDS):
            prior = np.concatenate([np.full(2, 1 / TREND_SCALE**2), np.full(k - 2, 1e-9)]) * noise
            lasso = np.concatenate([np.zeros(2), np.full(k - 2, noise / config.changepoint_prior_scale)])
            ridge = np.eye(p) * noise / SEASON_SCALE**2 + np.eye(p) * 1e-9 * n
            if self.mult:
                v = np.concatenate([[1.0], season])
                f = m[:, :, : p + 1, : p + 1] @ v @ v
                trend = sparse_solve(trend_gram(f) + np.diag(prior), trend_side(m[:, :, target, : p + 1] @ v), lasso)
                lo, hi = a @ trend, b @ trend
                square = np.einsum("q,qij->ij", lo * lo, m[:, 0]) + np.einsum("q,qij->ij", 2 * lo * hi, m[:, 1]) + np.einsum("q,qij->ij", hi * hi, m[:, 2])
                cross = np.einsum("q,qi->i", lo, m[:, 0, target]) + np.einsum("q,qi->i", hi, m[:, 1, target])
                season = np.linalg.solve(square[seasons, seasons] + ridge, cross[seasons] - square[seasons, one]) if p else season
                v = np.concatenate([[1.0], season])
                rss = yy - 2 * cross[: p + 1] @ v + v @ square[: p + 1, : p + 1] @ v
            else:
                t_t, t_y = trend_gram(m[:, :, one, one]), trend_side(m[:, :, one, target])
                t_s = np.einsum("qi,qj->ij", a, m[:, 0, one, seasons]) + np.einsum("qi,qj->ij", b, m[:, 1, one, seasons])
                s_s, s_y = total[seasons, seasons], total[seasons, target]
                back = np.linalg.solve(s_s + ridge, np.column_stack([t_s.T, s_y])) if p else np.zeros((0, k + 1))
                trend = sparse_solve(t_t - t_s @ back[:, :-1] + np.diag(prior), t_y - t_s @ back[:, -1], lasso)
                season = back[:, -1] - back[:, :-1] @ trend
                rss = yy - 2 * (trend @ t_y + season @ s_y) + trend @ t_t @ trend + 2 * trend @ t_s @ season + season @ s_s @ season
            noise = max(rss / n, 1e-8)
        self.trend, self.season, self.sigma = trend, season, float(np.sqrt(max(rss / n, 0.0))) * self.size

    def predict(self, lo: int, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(yhat, trend) of the days from position ``lo`` on, whose columns (without 1 and target) are ``z``."""
        t, span = np.arange(lo, lo + len(z)) / UNIT, max(self.n - 1, 1) / UNIT
        rows = np.column_stack([np.ones(len(t)), t / span, np.maximum(t[:, None] - self.knots / UNIT, 0) / span])
        level = rows @ self.trend
        part = (z[:, self.take] - self.shift) / self.scale @ self.season
        return (level * (1 + part) if self.mult else level + part) * self.size, level * self.size


class TrendSeason:
    """One series' columns and moments, from which the model of any prefix follows."""

    def __init__(self, y: np.ndarray, dates, config: TrendConfig, x: np.ndarray | None = None, future=(), fx: np.ndarray | None = None):
        self.y, self.config = np.asarray(y, float), config
        days = np.concatenate([np.asarray(dates, "datetime64[D]"), np.asarray(future, "datetime64[D]")])
        columns, self.need = season_columns(days, config)
        self.n_regressors = 0 if x is None else x.shape[1]
        if self.n_regressors:
            columns = np.column_stack([columns, np.concatenate([x, fx]) if fx is not None and len(future) else x])
        self.columns, n = columns, len(self.y)
        self.moments = Moments(np.column_stack([np.ones(n), columns[:n], self.y]))

    def fit(self, n: int | None = None) -> TrendFit:
        n = len(self.y) if n is None else n
        own = self.y[:n]
        return TrendFit(self.moments, n, self.need, self.n_regressors, seasonality_mode(own, self.config.seasonality_mode), float(np.abs(own).max()), self.config)


def trend_season(y: np.ndarray, dates, future, config: TrendConfig, x: np.ndarray | None = None, fx: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """yhat, trend and sigma for the fitted and future dates (daily, without gaps) together."""
    model = TrendSeason(y, dates, config, x, future, fx)
    fit = model.fit()
    yhat, level = fit.predict(0, model.columns)
    return {"yhat": yhat, "trend": level, "sigma": np.full(len(yhat), fit.sigma)}


def origin_forecasts(y: np.ndarray, dates, horizon: int, origins: list[int], config: TrendConfig, x: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """Forecasts of the ``horizon`` days from each origin (length of a training prefix), all from one pass over the series."""
    model = TrendSeason(y, dates, config, x)
    return {o: model.fit(o).predict(o, model.columns[o : o + horizon])[0] for o in origins}
