import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesmill.config import BaseConfig, BoostConfig, FeatureConfig, PipelineConfig, TrendConfig, from_yaml
from seriesmill.functions import metrics
from seriesmill.functions import transforms as tf
from seriesmill.functions.dates import add_calendar
from seriesmill.operators import backtest, boosting, diagnostics, features, forecast, panel, report, segments, trend, windows
from seriesmill.sources.tables import TableLoader, validate_schema

DAY0 = dt.date(2020, 1, 1)


def series(spark, values, **keys):
    rows = [{"date": DAY0 + dt.timedelta(days=i), "sales": float(v), **keys} for i, v in enumerate(values)]
    return spark.createDataFrame(pd.DataFrame(rows))


def test_lag_guard():
    assert features.safe_lags([1, 7, 14], 28) == [28]
    assert features.safe_lags([28, 35, 7], 28) == [28, 35]
    assert features.safe_lags(None, 28) == [28]


def test_lags_rolling_expanding_match_pandas(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 100, 120)
    out = features.add_expanding(features.add_rolling(features.add_lags(series(spark, x, family="A"), ["family"], [28], 28), ["family"], [7], [7], ["mean", "std", "median"], 28), ["family"], ["mean"], 28, 28)
    got = out.orderBy("date").toPandas()
    lag = pd.Series(x).shift(28)
    np.testing.assert_allclose(got["lag_28"].to_numpy(float), lag, equal_nan=True)
    for f in ("mean", "std", "median"):
        np.testing.assert_allclose(got[f"rolling_{f}_lag28_w7"].to_numpy(float), getattr(lag.rolling(7, min_periods=1), f)(), equal_nan=True)
    np.testing.assert_allclose(got["expanding_mean"].to_numpy(float), lag.expanding(28).mean(), equal_nan=True)


def test_ema_matches_pandas(spark):
    x = [0, 0, 5, 0, 2, 7, 1]
    df = series(spark, x, family="A").withColumnRenamed("sales", "onpromotion")
    got = features.add_external(df, ["family"], [28], 28).orderBy("date").toPandas()
    for n in (3, 7, 14):
        np.testing.assert_allclose(got[f"onpromotion_ema_{n}"], pd.Series(x, dtype=float).ewm(span=n, min_periods=1).mean())


def test_leak_validation(spark):
    df = series(spark, range(40), family="A")
    assert features.leaks(df.withColumn("lag_1", df.sales), 28) == ["lag_1"]
    with pytest.raises(ValueError, match="Leakage validation failed"):
        features.build(df.withColumn("lag_1", df.sales), ["family"], 28, FeatureConfig())


def test_paydays(spark):
    days = ["2020-02-14", "2020-02-15", "2020-02-16", "2020-02-29", "2021-02-28", "2020-12-31", "2021-01-01"]
    df = spark.createDataFrame([(dt.date.fromisoformat(x),) for x in days], "date date")
    got = {str(r.date): (r.days_until_next_payday, r.days_since_last_payday) for r in add_calendar(df).collect()}
    assert got == {"2020-02-14": (1, 14), "2020-02-15": (0, 0), "2020-02-16": (13, 1), "2020-02-29": (0, 0), "2021-02-28": (0, 0), "2020-12-31": (0, 0), "2021-01-01": (14, 1)}


def test_gap_day_is_filled(spark):
    rows = [(DAY0, 1, "F", 5.0, 0.0, 40.0, 3, "Q", "P", "A", 13, 1), (DAY0 + dt.timedelta(days=2), 1, "F", 6.0, 0.0, 42.0, 4, "Q", "P", "A", 13, 0)]
    df = spark.createDataFrame(rows, "date date, store_nbr int, family string, sales double, onpromotion double, dcoilwtico double, transactions long, city string, state string, type string, cluster int, is_localized_holiday int")
    got = panel.complete(df).orderBy("date").collect()
    assert len(got) == 3
    assert (got[1].sales, got[1].dcoilwtico, got[1].city, got[1].cluster, got[1].is_localized_holiday) == (0.0, 40.0, "Q", 13, 0)


def test_holidays_localise(spark):
    stores = spark.createDataFrame([(1, "Q", "P"), (2, "G", "R")], "store_nbr int, city string, state string")
    h = [("Holiday", "National", "E", "n", True), ("Holiday", "Regional", "P", "r", False), ("Event", "Local", "G", "l", False), ("Holiday", "Local", "X", "m", None)]
    df = spark.createDataFrame([(DAY0, *x) for x in h], "date date, type string, locale string, locale_name string, description string, transferred boolean")
    got = {r.store_nbr: r.description for r in panel.active_holidays(df, stores).collect()}
    assert got == {1: "r", 2: "l"}


def test_metrics(spark):
    df = spark.createDataFrame([(DAY0 + dt.timedelta(days=i), a, f) for i, (a, f) in enumerate([(10.0, 11.0), (20.0, 18.0), (100.0, 90.0), (0.0, 5.0)])], "date date, actual double, forecast double")
    r = metrics.metric_table(df.withColumn("k", F.lit(1)), ["k"]).first()
    assert r.MAPE == pytest.approx(10.0) and r.WAPE == pytest.approx(100 * 18 / 130) and r.PeakCapture == 1.0 and r.DirectionAccuracy == pytest.approx(1.0)
    zero = df.withColumns({"actual": F.lit(0.0), "forecast": F.lit(0.0), "k": F.lit(1)})
    r = metrics.metric_table(zero, ["k"]).first()
    assert r.WAPE is None and r.PBIAS is None and r.CV is None and r.TrackingSignal == 0.0


def test_wins_ties_lose(spark):
    rows = [("A", w, m, v) for w, vs in ((0, (1.0, 5.0, 5.0)), (1, (5.0, 5.0, 9.0))) for m, v in zip(("hybrid", "seasonal_naive", "moving_average"), vs, strict=True)]
    got = metrics.wins(spark.createDataFrame(rows, "family string, window int, model string, WAPE double"), ["family"]).collect()
    assert [(r.wins, r.n) for r in got] == [(1, 2)]


def test_weekly_series_has_no_naive_error(spark):
    s = series(spark, [i % 7 + 1 for i in range(51)], family="A")
    w = windows.cv_windows(s, ["family"], 7, 3, 7)
    assert w.count() == 3
    sliced = windows.slice_windows(s, w, ["family"])
    assert forecast.seasonal_naive(sliced, ["family"]).where("actual <> forecast").count() == 0
    assert forecast.moving_average(sliced, ["family"], horizon=7).where("abs(actual - forecast) > 0").count() > 0
    assert sliced.where("date > val_end").count() == 0


def test_abc(spark):
    df = spark.createDataFrame([(1, "X", 30.0), (2, "X", 70.0)], "store_nbr int, family string, sales double")
    got = {r.store_nbr: r.abc_class for r in segments.abc_classes(df, ["store_nbr", "family"]).collect()}
    assert got == {2: "A", 1: "C"}
    assert segments.direct_lags(28) == [-28, -35, -42, -56]


@pytest.mark.parametrize("method", ["difference", "log", "box_cox", "none"])
def test_round_trip(spark, method):
    s = series(spark, [10, 15, 14, 20, 25, 0, 3], family="A")
    assert tf.round_trip_error(s, ["family"], method).first().max_error <= 1e-5


def test_transform_rules():
    assert tf.fit_values(np.zeros(12), "box_cox")["method"] == "log"
    assert tf.fit_values(np.arange(5.0), "box_cox")["shift"] == 1.0
    with pytest.raises(ValueError):
        tf.fit_values(np.array([-1.0, 2.0]), "log")
    with pytest.raises(ValueError):
        tf.fit_values(np.array([]), "none")


def test_residuals_keep_the_shortest_lead():
    y, dates = 10 + np.arange(16.0), np.arange(16)
    r = forecast.residuals_of(y, dates, 4, 8, 2, lambda t, _, h: np.full(h, float(len(t))))
    assert r[11] == (10, 11.0) and sorted(r) == list(range(8, 16))
    assert windows.origins(22, 4, 10, 4) == [10, 14, 18]
    with pytest.raises(ValueError):
        windows.origins(10, 4, 8, 4)
    assert forecast.min_residual_length([-4, -8]) == 9


def test_trend_model_knows_holidays():
    days = np.arange("2014-01-01", "2017-01-01", dtype="datetime64[D]")
    xmas = np.array([str(x)[5:] == "12-25" for x in days])
    y = np.where(xmas, 40.0, 20.0)
    n = len(y) - 28
    yhat = trend.trend_season(y[:n], days[:n], days[n:], TrendConfig())["yhat"][n:]
    assert yhat[xmas[n:]][0] > 30 and yhat[~xmas[n:]].max() < 25
    with pytest.raises(ValueError):
        trend.trend_season(y[:n], days[:n], days[n:], TrendConfig(holidays_country="XX"))


def test_residual_origins_take_regressors(spark):
    rng = np.random.default_rng(2)
    promo = rng.integers(0, 2, 120).astype(float)
    df = series(spark, 20 + 10 * promo, family="A")
    p = spark.createDataFrame([(DAY0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(promo)], "date date, promo double")
    df = df.join(p, "date")
    worst = {}
    for x in (None, ["promo"]):
        r = [abs(v.residual) for v in forecast.rolling_origin_residuals(df, ["family"], 28, 60, regressors=x).collect()]
        worst[x and x[0]] = max(r)
    assert worst["promo"] < 1 < 3 < worst[None]


def test_stationarity():
    rng = np.random.default_rng(1)
    noise = rng.normal(size=300)
    assert diagnostics.verdict(diagnostics.adf(noise)[1], diagnostics.kpss(noise)[1]) == "stationary"
    assert diagnostics.differencing_order(np.cumsum(rng.normal(size=400))) >= 1


def test_loader(spark, tmp_path):
    (tmp_path / "stores.csv").write_text("store_nbr,city,state,type,cluster,more\n1,Q,P,A,13,x\n")
    loader = TableLoader(spark, str(tmp_path), str(tmp_path / "cache"))
    for _ in range(2):
        assert loader.load("stores").select("store_nbr", "cluster").collect() == [(1, 13)]
    with pytest.raises(FileNotFoundError):
        loader.load("oil")
    with pytest.raises(ValueError, match="missing"):
        validate_schema(spark.range(1), "oil")


def test_config(tmp_path):
    (tmp_path / "e.yaml").write_text("")
    assert from_yaml(PipelineConfig, str(tmp_path / "e.yaml")).forecast_horizon == 28
    with pytest.raises(ValueError):
        PipelineConfig(aggregation_level="store_item")
    with pytest.raises(ValueError):
        PipelineConfig(cv_stride=0)


def test_config_sections(tmp_path):
    (tmp_path / "b.yaml").write_text("prophet:\n  changepoint_prior_scale: 0.1\ncatboost:\n  iterations: 7\n  loss_function: RMSE\npipeline:\n  target_transform: log\n")
    c = from_yaml(BaseConfig, str(tmp_path / "b.yaml"))
    assert (c.trend.changepoint_prior_scale, c.boost.iterations, c.boost.depth, c.pipeline.target_transform) == (0.1, 7, 6, "log")
    assert (BoostConfig().iterations, BoostConfig().depth) == (1000, 6)
    (tmp_path / "b.yaml").write_text("catboost:\n  trees: 7\n")
    with pytest.raises(ValueError, match="trees"):
        from_yaml(BaseConfig, str(tmp_path / "b.yaml"))


@pytest.mark.parametrize("method", ["difference", "log", "box_cox", "none"])
def test_values_round_trip(method):
    x = np.array([10.0, 15, 14, 20, 25, 0, 3])
    p = tf.fit_values(x, method)
    back = tf.inverse_values(tf.forward_values(x, p), p, x[0])
    np.testing.assert_allclose(back, x[1:] if method == "difference" else x, atol=1e-5)


def test_trees_learn_mean_and_spread():
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, (1500, 3))
    wide = x[:, 1] > 0.5
    y = 10 * (x[:, 0] > 0.3) + rng.normal(size=1500) * np.where(wide, 3.0, 0.5)
    m = boosting.GaussianTrees(BoostConfig(iterations=200, depth=3)).fit(x, y)
    mu, sigma = m.predict(np.array([[0.1, 0.1, 0.5], [0.9, 0.9, 0.5]]))
    assert abs(mu[0]) < 1 and abs(mu[1] - 10) < 1.5 and sigma[0] < 1 < 2 < sigma[1] < 4.5
    assert len(m.trees) < 200
    flat = boosting.GaussianTrees(BoostConfig(iterations=5)).fit(np.zeros((20, 2)), np.ones(20)).predict(np.zeros((3, 2)))
    assert flat[0] == pytest.approx(1) and (flat[1] < 1e-3).all()


def test_backtest_routes_by_window(spark):
    """A series is A by the history of one window and C by a later one, in which another outsells it."""
    days = [DAY0 + dt.timedelta(days=i) for i in range(60)]
    rows = [(d, s, "F", v) for i, d in enumerate(days) for s, v in ((1, 50.0), (2, 30.0), (3, 10.0 if i < 40 else 20000.0))]
    catalog = spark.createDataFrame(rows, "date date, store_nbr int, family string, sales double")
    cv = spark.createDataFrame([(1, "F", 0, days[38]), (1, "F", 1, days[59]), (9, "F", 1, days[59])], "store_nbr int, family string, window int, train_end date")
    got = {(r.store_nbr, r.window): (r.abc_class, r.route) for r in backtest.window_routes(catalog, cv, ["store_nbr", "family"]).collect()}
    assert got == {(1, 0): ("A", "hybrid"), (1, 1): ("C", "direct"), (9, 1): ("C", "direct")}
    assert backtest.filter_series(catalog, cv, ["store_nbr", "family"]).select("store_nbr").distinct().collect() == [(1,)]


@pytest.mark.parametrize("method", ["difference", "box_cox"])
def test_learned_forecasts(spark, method):
    rng = np.random.default_rng(5)
    promo = rng.integers(0, 2, 200).astype(float)
    y = 30 + 5 * (np.arange(200) % 7 == 3) + 20 * promo
    df = series(spark, y, family="A").join(spark.createDataFrame([(DAY0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(promo)], "date date, promo double"), "date")
    config = BaseConfig(boost=BoostConfig(iterations=60, depth=3), pipeline=PipelineConfig(target_transform=method, residual_min_train_size=60))
    sliced = windows.slice_windows(df, windows.cv_windows(df, ["family"], 28, 2, 14), ["family"]).withColumn("route", F.when(F.col("window") == 0, "hybrid").otherwise("direct"))
    learned = backtest.learned_forecasts(sliced, ["family"], ["promo"], ["promo"], config)
    both = backtest.scored_forecasts(sliced, learned, ["family"], 28)
    got = {(r.window, r.model): r for r in metrics.metric_table(both, ["family", "window", "model"]).collect()}
    assert {m for _, m in got} == {*metrics.BASELINES, "hybrid", "direct_catboost"} and len(got) == 8
    assert all(r.n_days == 28 for r in got.values())
    if method == "box_cox":
        assert got[0, "hybrid"].WAPE < min(got[0, m].WAPE for m in metrics.BASELINES)
    rows = learned.collect()
    assert all(0 <= r.p05 <= r.forecast <= r.p95 for r in rows)


def test_small_operators(spark):
    s = series(spark, [1, 2, 3], family="A")
    assert [r.position for r in windows.positions(s, ["family"]).orderBy("date").collect()] == [0, 1, 2]
    twice = s.selectExpr("*", "1 as origin").union(s.selectExpr("*", "2 as origin"))
    assert {r.origin for r in windows.keep_latest(twice, ["family"]).collect()} == {2}
    late = spark.createDataFrame([(0, DAY0, "A"), (1, DAY0 - dt.timedelta(days=1), "A"), (2, DAY0, "A")], "id int, date date, family string")
    assert [r.id for r in windows.unsorted_rows(late, ["family"], "id").collect()] == [1]
    trials = spark.createDataFrame([(0, 3.0), (1, 2.0), (2, 2.0)], "trial int, objective double")
    assert forecast.best_trial(trials).first().trial == 1


def test_panel_windows(spark):
    s = series(spark, range(20), family="A").where("sales <> 5")
    got = windows.panel_windows(s, 4, 2, 3).orderBy("window").collect()
    days = [DAY0 + dt.timedelta(days=i) for i in range(20)]
    assert [(r.window, r.train_end, r.val_start, r.val_end) for r in got] == [(0, days[12], days[13], days[16]), (1, days[15], days[16], days[19])]
    for i, few in ((8, True), (9, False)):  # 8 dates remain of the first 9
        rows = windows.panel_windows(s.where(f"sales < {i}"), 4, 2, 3)
        if few:
            with pytest.raises(Exception, match="too few dates"):
                rows.collect()
        else:
            assert rows.count() == 2
    with pytest.raises(ValueError):
        windows.panel_windows(s, 0)


def test_slices_and_checks(spark):
    s = series(spark, range(10), family="A")
    day = lambda i: str(DAY0 + dt.timedelta(days=i))
    assert windows.time_slice(s, ["family"], day(2), day(4)).count() == 3
    with pytest.raises(Exception, match="cover"):
        windows.time_slice(s, ["family"], day(2), day(11)).collect()
    assert [r.sales for r in panel.holdout(s, 2).orderBy("date").collect()] == [8, 9]
    twice = windows.unique_dates(s.union(s.limit(1)), ["family"]).first()
    assert (twice.n_rows, twice.n_dates, twice.is_unique) == (11, 10, False)
    more = series(spark, range(3), family="B")
    assert panel.complete(s.unionByName(more), "family", scope="panel").count() == 20
    catalog = segments.series_catalog([s, more, s], ["family"])
    assert sorted(r.family for r in catalog.collect()) == ["A", "B"]
    for parts in ([], [s.limit(0)]):
        with pytest.raises(ValueError):
            segments.series_catalog(parts, ["family"])
    with pytest.raises(ValueError, match="lag_28"):
        features.drop_warmup(s, ["lag_28"])
    assert features.numeric(s, ["date"]).columns == ["date", "sales"]


def test_reports(spark):
    s = series(spark, [0, 1, 2, 3, 10], family="A").withColumnRenamed("sales", "residual")
    h = report.histogram(s.unionByName(s.withColumn("residual", F.lit(None).cast("double"))), ["family"], bins=5).orderBy("bin").collect()
    assert [r.n for r in h] == [2, 2, 0, 0, 1] and [r.lo for r in h] == [0, 2, 4, 6, 8] and h[-1].hi == 10
    flat = report.histogram(series(spark, [4, 4], family="A"), ["family"], "sales", 3).collect()
    assert sorted((r.bin, r.n) for r in flat) == [(0, 2), (1, 0), (2, 0)]
    f = series(spark, [5, 6], family="A").select("family", "date", F.col("sales").alias("actual"), F.lit(4.0).alias("forecast"))
    rows = report.forecast_rows(series(spark, [1], family="A"), report.error_band(f, ["family"]), ["family"]).collect()
    assert sorted(r.kind for r in rows) == ["actual", "actual", "forecast", "forecast", "history"]
    assert {(round(r.lo, 2), round(r.hi, 2)) for r in rows if r.kind == "forecast"} == {(5.05, 5.95)}
    weekly = series(spark, [i % 7 + 1 for i in range(80)], store_nbr=1, family="A")
    got = report.dashboard(weekly, stores=[1], horizon=14).first()
    assert (got.MAPE, got.RMSE, got.DirectionAccuracy) == (0, 0, 1)
    assert report.dashboard(weekly, stores=[2]).count() == 0
    with pytest.raises(ValueError):
        report.dashboard(weekly, horizon=91)


def test_in_sample_residuals_and_trial_log(spark, caplog):
    y = [20 + 5 * (i % 7 == 3) for i in range(100)]
    r = forecast.in_sample_residuals(series(spark, y, family="A"), ["family"]).collect()
    assert len(r) == 100 and max(abs(x.residual) for x in r) < 1.5 and "understate" in caplog.text
    trials = spark.createDataFrame([(0, 3.0), (1, None), (2, 2.0)], "trial int, objective double")
    with caplog.at_level("INFO"):
        backtest.log_trials(trials)
    assert "best trial {'trial': 2" in caplog.text


def test_boxcox_policy_follows_the_fit(spark):
    cases = {"a": [1, 2, 3], "b": [0, 2, 3], "c": [4, 4], "d": [-0.5, -0.5], "e": [0, 0]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in cases.items() for v in vs] + [("a", float("nan")), ("a", None)], "k string, sales double")
    got = {r.k: r for r in tf.boxcox_policy(df, ["k"]).collect()}
    assert (got["a"].n, got["a"].n_finite) == (4, 3)
    for k, vs in cases.items():
        p = tf.fit_values(np.array(vs, float), "box_cox")
        assert (got[k].method, got[k].shift) == (p["method"], p["shift"])


def test_critical_values(spark):
    rng = np.random.default_rng(0)
    r = diagnostics.stationarity(series(spark, rng.normal(size=60), family="A"), ["family"]).first()
    assert r.kpss_critical_values["2.5%"] == 0.574 and r.error is None
    assert -2.95 < r.adf_critical_values["5%"] < -2.90


def test_published_critical_values():
    """Dickey-Fuller with a constant, as MacKinnon (2010) and Fuller (1976) print them."""
    for n, want in ((25, (-3.72, -2.99, -2.63)), (50, (-3.57, -2.92, -2.60)), (100, (-3.50, -2.89, -2.58)), (10**9, (-3.43, -2.86, -2.57))):
        assert tuple(round(v, 2) for v in diagnostics.df_critical_values(n).values()) == want
    for t, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert diagnostics.df_p_value(t) == pytest.approx(p, abs=0.002)
    assert (diagnostics.df_p_value(-30.0), diagnostics.df_p_value(3.0)) == (0, 1)


def test_bandwidth_follows_the_data():
    rng = np.random.default_rng(13)
    noise = rng.normal(size=2000)
    slow = np.convolve(rng.normal(size=2400), 0.9 ** np.arange(60))[:2000]
    a, b = (diagnostics.kpss_lags(y - y.mean()) for y in (noise, slow))
    assert a < 12 < b and diagnostics.kpss_lags(np.zeros(9)) == 0


def test_a_bad_series_does_not_end_the_job(spark):
    good = series(spark, np.random.default_rng(0).normal(size=60), family="A")
    bad = series(spark, [1, 2, float("inf"), 4], family="B")
    got = {r.group: r for r in diagnostics.stationarity(good.unionByName(bad).unionByName(series(spark, [1, 2], family="C")), ["family"]).collect()}
    assert set(got) == {"A", "B"} and got["A"].verdict == "stationary" and got["A"].error is None
    assert "finite" in got["B"].error and got["B"].verdict is None and got["B"].kpss_critical_values is None


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


# --- models of one series ---------------------------------------------------------------------------------------------


def daily(n):
    return np.arange(np.datetime64("2015-01-01"), np.datetime64("2015-01-01") + n, dtype="datetime64[D]")


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_origins_equal_refits(mode):
    rng = np.random.default_rng(4)
    n = 500
    x = rng.normal(size=(n, 3)) + 5
    y = (40 + 0.05 * np.arange(n)) * (1 + 0.2 * np.sin(2 * np.pi * np.arange(n) / 7)) + x[:, 0] + rng.normal(size=n)
    config = TrendConfig(seasonality_mode=mode)
    starts = windows.origins(n, 28, 100, 28)
    made = trend.origin_forecasts(y, daily(n), 28, starts, config, x)
    assert sorted(made) == starts
    for o in starts:
        again = trend.trend_season(y[:o], daily(n)[:o], daily(n)[o : o + 28], config, x[:o], x[o : o + 28])["yhat"][o:]
        np.testing.assert_allclose(made[o], again, rtol=1e-6, atol=1e-6)


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_planted_change_points(mode):
    rng = np.random.default_rng(6)
    n = 1500
    knots = trend.change_points(n)
    assert len(knots) == 25 and knots[-1] == int(0.8 * n) - 1
    t = np.arange(n)
    level = 100 + 0.05 * t + 0.3 * np.maximum(t - knots[7], 0) - 0.5 * np.maximum(t - knots[16], 0)
    y = level + 4 * np.sin(2 * np.pi * t / 7) + rng.normal(size=n)
    model = trend.TrendSeason(y, daily(n), TrendConfig(seasonality_mode=mode, holidays_country=""))
    fit = model.fit()
    slopes = fit.trend[2:]
    assert slopes[7] > 0 > slopes[16] and (slopes == 0).sum() >= 12
    assert np.abs(slopes[[7, 16]]).sum() > 0.8 * np.abs(slopes).sum()
    yhat, found = fit.predict(0, model.columns)
    assert np.abs(found - level).max() < 4 and 0.8 < fit.sigma < 1.5


def test_sparse_solve_against_the_optimality_conditions():
    rng = np.random.default_rng(0)
    for _ in range(20):
        x = rng.normal(size=(60, 12)).cumsum(axis=0)
        a, c = x.T @ x / 60, x.T @ rng.normal(size=60) / 6
        penalty = np.concatenate([[0, 0], rng.uniform(0.1, 3, 10)])
        b = trend.sparse_solve(a, c, penalty)
        pull = c - a @ b
        on = b != 0
        np.testing.assert_allclose(pull[on], (penalty * np.sign(b))[on], atol=1e-6)
        assert (np.abs(pull) <= penalty + 1e-6)[~on].all() and on[:2].all()


def test_daily_seasonality_is_read():
    off, on = (trend.season_columns(daily(20), TrendConfig(daily_seasonality=d))[0].shape[1] for d in (False, True))
    assert on == off + 8


def test_short_and_constant_series():
    for y in (np.ones(5), np.zeros(9), np.arange(3.0), np.array([7.0])):
        out = trend.trend_season(y, daily(len(y)), daily(len(y) + 4)[-4:], TrendConfig())
        assert np.isfinite(out["yhat"]).all() and len(out["yhat"]) == len(y) + 4


def test_smoothing_weights_beat_the_grid_and_recover():
    rng = np.random.default_rng(7)
    n, (a, b, g) = 700, (0.35, 0.05, 0.15)
    level, slope, season, y = 50.0, 0.0, [5, -3, 0, 2, -4, 1, -1], []
    for t in range(n):
        e = rng.normal()
        v = level + slope + season[t % 7] + e
        new = level + slope + a * e
        slope += a * b * e
        season[t % 7] += g * (1 - a) * e
        level = new
        y.append(v)
    y = np.array(y)
    w = forecast.fitted_weights(y)
    grid = np.array([(i, j, k) for i in (0.05, 0.2, 0.5) for j in (0.0, 0.02, 0.1) for k in (0.05, 0.2, 0.5)])
    best, least = (forecast.smoothing_errors(y, x)[0] for x in (np.array([w]), grid))
    assert best[0] <= least.min() + 1e-9 and (0 <= w).all() and (w <= 1).all()
    assert abs(w[0] - a) < 0.12 and abs(w[2] - g) < 0.12
    assert best[0] <= forecast.smoothing_errors(y, np.array([(a, b, g)]))[0][0] + 1e-9
    flat = forecast.holt_winters(np.full(30, 4.0), 3)
    np.testing.assert_allclose(flat, 4)


def test_lambda_equals_golden_section(spark):
    rng = np.random.default_rng(8)
    cases = {"a": rng.gamma(2, 10, 400), "b": np.exp(rng.normal(size=300)), "c": rng.integers(0, 60, 500).astype(float), "d": 50 + rng.normal(size=200), "e": np.full(9, 3.0)}
    rows = [(k, DAY0 + dt.timedelta(days=i), float(v)) for k, vs in cases.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame([*rows, ("a", DAY0, None), ("b", DAY0, float("nan"))], "family string, date date, sales double")
    got = {r.family: r for r in tf.fit(df, ["family"], "box_cox").collect()}
    for k, vs in cases.items():
        want = tf.fit_values(vs, "box_cox")
        assert (got[k].method, got[k].shift, got[k].first_value, got[k].last_value, got[k].fit_size) == tuple(want[f] for f in ("method", "shift", "first_value", "last_value", "fit_size"))
        assert got[k].lam == pytest.approx(want["lam"], abs=2e-6)
    for bad, method in ((-1.0, "box_cox"), (-0.1, "log")):
        with pytest.raises(Exception, match="needs values"):
            tf.fit(series(spark, [1.0, bad], family="A"), ["family"], method).collect()


def test_round_trips_that_fail(spark):
    s = series(spark, [10, 15, 14], family="A")
    assert tf.fit_transform(s, ["family"], "log").count() == 3
    assert tf.round_trip_error(s, ["family"], "box_cox", tolerance=1e-5).first().max_error <= 1e-5
    with pytest.raises(Exception, match="round-trip"):
        tf.round_trip_error(s, ["family"], "box_cox", tolerance=-1.0).collect()
    with pytest.raises(Exception, match="round-trip"):
        tf.fit_transform(s, ["family"], "box_cox", tolerance=-1.0).collect()
    with pytest.raises(ValueError, match="last observed"):
        tf.inverse_values(np.ones(2), tf.fit_values(np.arange(3.0), "difference"))
    done = tf.transform(s, tf.fit(s, ["family"], "difference"), ["family"]).withColumn("first_value", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="last observed"):
        tf.invert(done, ["family"]).collect()


def test_no_lag_is_younger_than_its_origin(spark):
    """Residuals that name the day and the origin they came from: each lag was known at the origin of the row it is in."""
    s = series(spark, np.arange(120.0) * 1000, family="A")
    spy = lambda y, dates, horizon: np.full(horizon, -float(len(y)))
    r = forecast.rolling_origin_residuals(s, ["family"], 14, 40, 7, forecaster=spy)
    lags = [14, 20, 27]
    rows = forecast.lagged_residuals(r, ["family"], lags).orderBy("date").collect()
    first = min(x.origin for x in rows)
    assert first == 43 and [(x.date - DAY0).days for x in rows] == list(range(first, 120)) and rows[-1].origin == 106
    known = 0
    for x in rows:
        day = (x.date - DAY0).days
        assert x.origin <= day and (x.origin_end - DAY0).days == x.origin - 1
        for n in lags:
            lag = x[f"own_lag_{n}"]
            assert (lag is None) == (day - n < first)
            if lag is not None:
                seen, made = divmod(int(lag), 1000)
                assert seen == day - n and seen < x.origin and made <= seen
                known += 1
    assert known > 100
    young = forecast.lagged_residuals(r, ["family"], [3]).collect()
    assert all((x.own_lag_3 is None) == ((x.date - DAY0).days - 3 >= x.origin or (x.date - DAY0).days - 3 < first) for x in young)
    with pytest.raises(ValueError):
        forecast.lagged_residuals(r, ["family"], [])


def test_origin_blocks_equal_one_task(spark, monkeypatch):
    rng = np.random.default_rng(9)
    s = series(spark, rng.normal(size=200) + 30, family="A").unionByName(series(spark, rng.normal(size=45), family="short"))
    whole = forecast.residuals_of(np.array([r.sales for r in s.where("family = 'A'").orderBy("date").collect()]), daily(200), 10, 30, 5, forecast.flat_forecaster(7))
    got = {(r.date - DAY0).days: (r.origin, r.residual) for r in forecast.rolling_origin_residuals(s, ["family"], 10, 30, 5, forecaster=forecast.flat_forecaster(7)).collect() if r.family == "A"}
    assert len(windows.origins(200, 10, 30, 5)) > forecast.ORIGINS_A_TASK and set(got) == set(whole)
    assert all(got[i][0] == whole[i][0] and got[i][1] == pytest.approx(whole[i][1]) for i in got)


def test_own_lags_carry_a_pattern(spark):
    """Sales that follow those of 28 days ago and nothing else: the boosted model learns it from its own lag."""
    rng = np.random.default_rng(10)
    y = list(rng.choice([10.0, 60.0], 28))
    while len(y) < 420:
        y.append(y[-28] if rng.uniform() < 0.97 else float(rng.choice([10.0, 60.0])))
    df = series(spark, y, family="A").withColumn("none", F.lit(0.0))
    config = BaseConfig(boost=BoostConfig(iterations=120, depth=3), pipeline=PipelineConfig(target_transform="none", residual_min_train_size=60))
    sliced = windows.slice_windows(df, windows.cv_windows(df, ["family"], 28, 1, 14), ["family"]).withColumn("route", F.lit("direct"))
    got = backtest.learned_forecasts(sliced, ["family"], ["none"], [], config).collect()
    assert np.mean([abs(r.actual - r.forecast) for r in got]) < 8
    with pytest.raises(ValueError, match="shorter than the horizon"):
        backtest.learned_forecasts(sliced, ["family"], ["none"], [], config, [-7])


def test_loss_without_uncertainty(spark):
    frame = pd.DataFrame({"x": np.arange(40.0), "own_lag_28": np.arange(40.0), "target": np.arange(40.0), "base": 0.0, "method": "none", "lam": 1.0, "shift": 0.0, "last_value": 0.0})
    out = backtest.boosted(frame[:30], frame[30:], ["x"], ["own_lag_28"], BaseConfig(boost=BoostConfig(iterations=9, depth=2, loss_function="RMSE")))
    np.testing.assert_array_equal(out["p05"], out["p95"])
    with pytest.raises(ValueError, match="loss"):
        BoostConfig(loss_function="Huber")


# --- sums over many series ------------------------------------------------------------------------------------------


def test_shares_over_ranges_and_ties(spark):
    rng = np.random.default_rng(11)
    rows = [(i, w, float(v)) for w in range(3) for i, v in enumerate(rng.integers(0, 9, 3000))] + [(9000, 0, None), (9001, 1, -2.0)]
    df = spark.createDataFrame(rows, "k long, w int, sales double").repartition(5)
    got = segments.abc_classes(df, ["k"], by=["w"]).toPandas()
    plan = segments.abc_classes(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_range" in plan and "rangepartitioning" not in plan
    for w, own in got.groupby("w"):
        own = own.sort_values(["total", "k"], ascending=[False, True], na_position="last")
        want = own["total"].fillna(0).cumsum() / own["total"].sum()
        np.testing.assert_allclose(own["cum_perc"].astype(float), want)
        assert (own["abc_class"] == np.where(want <= 0.8, "A", np.where(want <= 0.95, "B", "C"))).all()


def test_prefix_totals_by_window_end(spark):
    days = [DAY0 + dt.timedelta(days=i) for i in range(30)]
    rows = [(d, s, float(i + s)) for s in (1, 2, 3) for i, d in enumerate(days) if (i * s) % 4 != 1 and i < 25 + s and i >= 10 * (s - 1)]
    df = spark.createDataFrame(rows, "date date, s int, sales double")
    ends = spark.createDataFrame([(days[i],) for i in (4, 4, 9, 10, 20, 29)] + [(None,)], "train_end date")
    got = {(r.train_end, r.s): r.total for r in backtest.prefix_totals(df, ends, ["s"]).collect()}
    want = {}
    for i in (4, 9, 10, 20, 29):
        for s in (1, 2, 3):
            own = [v for d, k, v in rows if k == s and d <= days[i]]
            if own:
                want[days[i], s] = sum(own)
    assert got == want


def test_sampler_beats_random_search():
    def objective(v):
        return (np.log(v["scale"] / 0.03)) ** 2 + (v["depth"] - 7) ** 2 / 4 + (0.0 if v["lags"] == "b" else 3.0)

    space = {"scale": ("log", 0.001, 0.5), "depth": ("int", 4, 10), "lags": ("choice", ["a", "b", "c"]), "u": ("real", 0.0, 1.0)}
    learned, random = [], []
    for seed in range(12):
        for startup, out in ((6, learned), (10**6, random)):
            s = backtest.ParzenSampler(space, seed, startup)
            for i in range(40):
                v = s.ask()
                assert 0.001 <= v["scale"] <= 0.5 and 4 <= v["depth"] <= 10 and v["lags"] in "abc" and 0 <= v["u"] <= 1
                s.tell(v, None if i == 3 else objective(v))
            out.append(min(f for _, f in s.seen))
    assert np.mean(learned) < 0.5 * np.mean(random)
    twice = [backtest.ParzenSampler(space, 5).ask() for _ in range(2)]
    assert twice[0] == twice[1]


def test_tuning_runs_in_batches(spark):
    rng = np.random.default_rng(12)
    df = series(spark, 30 + 5 * (np.arange(200) % 7 == 3) + rng.normal(size=200), family="A").withColumn("none", F.lit(0.0))
    config = BaseConfig(boost=BoostConfig(iterations=10, depth=2), pipeline=PipelineConfig(target_transform="none", residual_min_train_size=60))
    sliced = windows.slice_windows(df, windows.cv_windows(df, ["family"], 28, 1, 14), ["family"]).withColumn("route", F.lit("hybrid"))
    trials = backtest.tune(sliced, ["family"], ["none"], [], {"two": [-28, -56], "one": [-28]}, n_trials=3, batch=2, config=config).orderBy("trial").collect()
    assert [r.trial for r in trials] == [0, 1, 2] and all(r.objective > 0 and r.lags in ("one", "two") for r in trials)


# --- configuration and protocols --------------------------------------------------------------------------------------


def test_feature_file_sections(tmp_path):
    text = """
lags: [28, 56]
rolling: {windows: [7], functions: [mean, max], base_lags: [35]}
expanding: {functions: [std], min_periods: 14}
calendar: {features: [month], binary: [is_weekend]}
external: {oil_lags: [30], include_promotion: false}
categorical: {features: [family]}
"""
    (tmp_path / "f.yaml").write_text(text)
    c = from_yaml(FeatureConfig, str(tmp_path / "f.yaml"))
    assert (c.lags, c.rolling_windows, c.rolling_functions, c.rolling_base_lags) == ([28, 56], [7], ["mean", "max"], [35])
    assert (c.expanding_functions, c.expanding_min_periods, c.calendar, c.oil_lags) == (["std"], 14, ["month", "is_weekend"], [30])
    assert (c.include_promotion, c.include_transactions, c.categorical) == (False, True, ["family"])
    (tmp_path / "f.yaml").write_text("calendar: {binary: [is_payday]}\nrolling:\n")
    c = from_yaml(FeatureConfig, str(tmp_path / "f.yaml"))
    assert c.calendar == ["day_of_week", "month", "quarter", "day_of_month", "week_of_year", "is_payday"] and c.rolling_windows == [7, 14, 28]
    for bad in ("rolling: {width: 7}", "expanding: {min_periods: 0}", "calendar: {moon: 1}", "seasons: {}", "lags: [0]"):
        (tmp_path / "f.yaml").write_text(bad)
        with pytest.raises(ValueError):
            from_yaml(FeatureConfig, str(tmp_path / "f.yaml"))


def test_sizes_come_from_the_configuration(spark):
    s = series(spark, range(60), family="A")
    config = PipelineConfig(forecast_horizon=7, cv_windows=3, cv_stride=5, residual_min_train_size=30)
    assert windows.cv_windows(s, ["family"], config=config).count() == windows.panel_windows(s, config=config).count() == 3
    ends = sorted((r.val_end - r.train_end).days for r in windows.cv_windows(s, ["family"], n_windows=2, config=config).collect())
    assert ends == [7, 7]
    assert sorted(r.origin for r in windows.residual_origins(s, ["family"], config=config).collect()) == [32, 39, 46, 53]


def test_split_counts_dates(spark):
    s = series(spark, range(10), family="A")
    got = {r.date: r.split for r in windows.split(s, 2, 3).collect()}
    assert [got[DAY0 + dt.timedelta(days=i)] for i in range(10)] == ["train"] * 5 + ["val"] * 3 + ["test"] * 2
    with pytest.raises(Exception, match="too few dates"):
        windows.split(s, 5, 5).collect()


def test_forecast_functions(spark):
    s = series(spark, range(40), family="A").withColumn("promo", F.col("sales") * 2)
    sliced = windows.slice_windows(s, windows.cv_windows(s, ["family"], 5, 2, 5), ["family"])

    def routed(train, val):
        assert "sales" not in val and train["date"].max() < val["date"].min()
        return val["promo"].to_numpy() / 2, "exact" if val["window"].iloc[0] else "early"

    got = backtest.forecasts_of(sliced, ["family"], routed, ["promo"]).collect()
    assert {(r.window, r.model) for r in got} == {(0, "early"), (1, "exact")} and all(r.actual == r.forecast for r in got) and len(got) == 10
    assert {r.model for r in backtest.forecasts_of(sliced, ["family"], lambda t, v: np.zeros(len(v)), model_name="zero").collect()} == {"zero"}
    with pytest.raises(Exception, match="gave 1 values for 5 days"):
        backtest.forecasts_of(sliced, ["family"], lambda t, v: [1.0]).collect()
    days = [r.date for r in panel.ordered(s.withColumn("store_nbr", F.lit(1)), ["store_nbr"]).collect()]
    assert days == sorted(days)
