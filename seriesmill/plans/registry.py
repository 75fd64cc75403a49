"""Registered queries and, where SQL can express them, their DuckDB SQL over the same tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FeatureConfig
from ..functions import metrics
from ..functions import transforms as tf
from ..functions.dates import add_calendar
from ..operators import backtest, diagnostics, features, forecast, panel, report, segments, windows
from ..sources.tables import TableLoader, from_star_schema, kept, scratch_folder, write_csv

SERIES, FAMILY, H = ["store_nbr", "family"], ["family"], 28

# --- inputs ---------------------------------------------------------------------------------------------------------


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return from_star_schema(spark, d)


def _family_sales(spark, d) -> DataFrame:
    """Gapless daily sales and promotions by family."""
    by = _tables(spark, d)["train"].groupBy("date", "family").agg(F.sum("sales").alias("sales"), F.sum("onpromotion").alias("onpromotion"))
    return panel.complete(by, "family")


def _family_panel(spark, d) -> DataFrame:
    """Gapless family panel with oil and transactions too."""
    return panel.complete(panel.aggregate(panel.enrich(_tables(spark, d)), "family"), "family")


def _sliced(spark, d) -> DataFrame:
    s = _family_sales(spark, d)
    return windows.slice_windows(s, windows.cv_windows(s, FAMILY), FAMILY)


def _regressors(f: DataFrame) -> list[str]:
    """Covariates known for the whole horizon: the planned ones, and oil at lags that reach it."""
    return [*features.covariates(f, "planned"), *[c for c in features.covariates(f, "shifted") if c.startswith("oil_lag_")]]


def _planned_sales(spark, d) -> tuple[DataFrame, list[str]]:
    """Daily sales by family with the covariates that the trend model takes, and those covariates' names."""
    f = features.add_external(add_calendar(_family_panel(spark, d)), FAMILY, [28, 35, 42], H, transactions=False)
    cols = _regressors(f)
    return f.select("date", *FAMILY, "sales", *cols), cols


def _scores(spark, d) -> DataFrame:
    """Scores by family, window and model; the mean of two baselines (blend) stands for a learned model, as SQL can follow it."""
    s = _sliced(spark, d)
    by = [*FAMILY, "window", "date", "actual"]
    both = forecast.seasonal_naive(s, FAMILY).join(forecast.moving_average(s, FAMILY).withColumnRenamed("forecast", "average"), by)
    models = {"seasonal_naive": F.col("forecast"), "moving_average": F.col("average"), "blend": (F.col("forecast") + F.col("average")) / 2}
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), c.alias("forecast")) for name, c in models.items()]))
    return metrics.metric_table(both.select(*by, each.alias("m")).select(*by, "m.model", "m.forecast"), [*FAMILY, "window", "model"])


# --- queries --------------------------------------------------------------------------------------------------------

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


CTE = {
    "train": "SELECT CAST(l_shipdate AS DATE) AS date, s_nationkey AS store_nbr, p_type AS family, sum(l_quantity) AS sales, CAST(count(*) FILTER (WHERE l_discount >= 0.08) AS DOUBLE) AS onpromotion FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3",
    "stores": "SELECT n_nationkey AS store_nbr, n_name AS city, r_name AS state, chr(CAST(65 + n_nationkey % 5 AS INTEGER)) AS type, n_regionkey AS cluster FROM nation JOIN region ON n_regionkey = r_regionkey",
    "oil": "SELECT CAST(o_orderdate AS DATE) AS date, (sum(CAST(round(o_totalprice * 100) AS BIGINT)) // count(*)) / 100.0::DOUBLE AS dcoilwtico FROM orders WHERE isodow(o_orderdate) <= 5 GROUP BY 1",
    "holidays": "SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS type, CASE o_orderkey % 3 WHEN 0 THEN 'National' WHEN 1 THEN 'Regional' ELSE 'Local' END AS locale, CASE o_orderkey % 3 WHEN 0 THEN 'World' WHEN 1 THEN r_name ELSE n_name END AS locale_name, 'event ' || o_orderkey AS description, o_orderstatus = 'P' AS transferred FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "transactions": "SELECT CAST(l_shipdate AS DATE) AS date, s_nationkey AS store_nbr, count(DISTINCT l_orderkey) AS transactions FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
    "active": "SELECT h.date, s.store_nbr, h.type AS holiday_type, locale, locale_name, description, transferred FROM holidays h JOIN stores s ON (locale = 'National' OR (locale = 'Regional' AND locale_name = state) OR (locale = 'Local' AND locale_name = city)) WHERE transferred IS DISTINCT FROM true AND h.type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY h.date, s.store_nbr ORDER BY CASE locale WHEN 'National' THEN 0 WHEN 'Regional' THEN 1 ELSE 2 END, h.type, description) = 1",
    "enriched": "SELECT t.date, t.store_nbr, t.family, CASE WHEN t.sales < 0 THEN 0 ELSE t.sales END AS sales, t.onpromotion, s.city, s.state, s.type, s.cluster, o.dcoilwtico, a.holiday_type, a.locale, a.locale_name, a.description, a.transferred, CAST(a.holiday_type IS NOT NULL AS INTEGER) AS is_localized_holiday, x.transactions FROM train t LEFT JOIN stores s USING (store_nbr) LEFT JOIN oil o USING (date) LEFT JOIN active a ON a.date = t.date AND a.store_nbr = t.store_nbr LEFT JOIN transactions x ON x.date = t.date AND x.store_nbr = t.store_nbr",
    "by_family": "SELECT date, family, sum(sales) AS sales, sum(onpromotion) AS onpromotion, coalesce(sum(transactions), 0)::BIGINT AS transactions, round(avg(dcoilwtico), 4) AS dcoilwtico FROM enriched GROUP BY 1, 2",
    "f0": "SELECT date, family, sum(sales) AS sales, sum(onpromotion) AS onpromotion FROM train GROUP BY 1, 2",
    "fs": "SELECT g.date, g.family, coalesce(f.sales, 0) AS sales, coalesce(f.onpromotion, 0) AS onpromotion FROM (SELECT family, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM f0 GROUP BY family) g LEFT JOIN f0 f USING (date, family)",
    "fg": "SELECT g.date, g.family, coalesce(f.sales, 0) AS sales, coalesce(f.onpromotion, 0) AS onpromotion, coalesce(f.transactions, 0) AS transactions, dcoilwtico AS o FROM (SELECT family, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM by_family GROUP BY family) g LEFT JOIN by_family f USING (date, family)",
    "fp": "SELECT date, family, sales, onpromotion, transactions, coalesce(last_value(o IGNORE NULLS) OVER (PARTITION BY family ORDER BY date ROWS UNBOUNDED PRECEDING), first_value(o IGNORE NULLS) OVER (PARTITION BY family ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS dcoilwtico FROM fg",
    "cv": "SELECT family, w AS window_, CAST(hi - CAST((4 - w) * 14 + 28 AS INTEGER) AS DATE) AS train_end, CAST(hi - CAST((4 - w) * 14 + 27 AS INTEGER) AS DATE) AS val_start, CAST(hi - CAST((4 - w) * 14 AS INTEGER) AS DATE) AS val_end FROM (SELECT family, min(date) AS lo, max(date) AS hi FROM fs GROUP BY family), (SELECT unnest(range(5)) AS w) WHERE hi - lo + 1 > 84",
    "naive": "SELECT v.family, c.window_, v.date, v.sales AS actual, t.sales AS forecast FROM cv c JOIN fs v ON v.family = c.family AND v.date BETWEEN c.val_start AND c.val_end JOIN fs t ON t.family = c.family AND t.date = c.train_end - 6 + CAST((v.date - c.val_start) % 7 AS INTEGER)",
    "ma": "SELECT c.family, c.window_, 0 AS step, c.val_start, list(t.sales ORDER BY t.date) AS a FROM cv c JOIN fs t ON t.family = c.family AND t.date > c.train_end - 14 AND t.date <= c.train_end GROUP BY ALL UNION ALL SELECT family, window_, step + 1, val_start, list_append(a[2:], list_reduce(list_prepend(0.0::DOUBLE, a), lambda x, y: x + y) / 14) FROM ma WHERE step < 28",
    "average": "SELECT ma.family, ma.window_, v.date, v.sales AS actual, ma.a[14] AS forecast FROM ma JOIN fs v ON v.family = ma.family AND v.date = ma.val_start + CAST(ma.step - 1 AS INTEGER) WHERE step > 0",
    "forecasts": "SELECT *, 'seasonal_naive' AS model FROM naive UNION ALL SELECT *, 'moving_average' FROM average UNION ALL SELECT n.family, n.window_, n.date, n.actual, (n.forecast + a.forecast) / 2, 'blend' FROM naive n JOIN average a USING (family, window_, date)",
    "scored": "SELECT *, sign(actual - lag(actual) OVER w) = sign(forecast - lag(forecast) OVER w) AS same, quantile_cont(actual, 0.9) OVER (PARTITION BY family, window_, model) AS bar FROM forecasts WINDOW w AS (PARTITION BY family, window_, model ORDER BY date)",
}
_NEEDS = {
    "active": ["holidays", "stores"], "enriched": ["train", "stores", "oil", "active", "transactions"], "by_family": ["enriched"], "f0": ["train"], "fs": ["f0"], "fg": ["by_family"], "fp": ["fg"], "cv": ["fs"],
    "naive": ["cv", "fs"], "ma": ["cv", "fs"], "average": ["ma", "fs"], "forecasts": ["naive", "average"], "scored": ["forecasts"],
}


#: The SQL of queries without a column of holidays keeps its earlier, smaller table of them; their rows don't depend on it.
_EARLIER = CTE | {"holidays": CTE["holidays"] + " WHERE o_totalprice >= 495000"}


def _with(body: str, *names: str, ctes: dict[str, str] = _EARLIER) -> str:
    order: list[str] = []

    def add(n):
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    recursive = "RECURSIVE " if "ma" in order else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({ctes[n]})" for n in order) + "\n" + body






@query(_with("SELECT c.family, sum(abs(n.actual - n.forecast)) / nullif(sum(abs(n.actual)), 0) * 100 AS wape, count(*) AS n_days FROM naive n JOIN cv c ON n.family = c.family AND n.window_ = c.window_ WHERE n.window_ = 4 GROUP BY c.family", "naive", "cv"))
def flagship_wape(spark, d):
    f = forecast.seasonal_naive(_sliced(spark, d), FAMILY).where("window = 4")
    return f.groupBy("family").agg(metrics.metric_expressions()["WAPE"].alias("wape"), F.count("*").alias("n_days"))


@query(_with("SELECT * FROM train", "train"))
def train_panel(spark, d):
    return _tables(spark, d)["train"]


@query(_with("SELECT * FROM stores", "stores"))
def stores_dim(spark, d):
    return _tables(spark, d)["stores"]


@query(_with("SELECT * FROM oil", "oil"))
def oil_daily(spark, d):
    return _tables(spark, d)["oil"]


@query(_with("SELECT * FROM holidays", "holidays", ctes=CTE))
def holidays_dim(spark, d):
    return _tables(spark, d)["holidays"]


@query(_with("SELECT * FROM transactions", "transactions"))
def transactions_daily(spark, d):
    return _tables(spark, d)["transactions"]


@query(_with("SELECT date, store_nbr, family, CASE WHEN sales - 60 < 0 THEN 0 ELSE sales - 60 END AS sales FROM train", "train"))
def clip_sales(spark, d):
    t = _tables(spark, d)["train"]
    return panel.clip_sales(t.withColumn("sales", F.col("sales") - 60)).select("date", "store_nbr", "family", "sales")


@query(_with("SELECT count(*) AS n_rows, count(*) FILTER (WHERE dcoilwtico IS NULL) AS null_dcoilwtico, count(*) FILTER (WHERE transactions IS NULL) AS null_transactions, count(*) FILTER (WHERE dcoilwtico < 0) AS negative_dcoilwtico, count(*) FILTER (WHERE transactions < 0) AS negative_transactions FROM enriched", "enriched"))
def missing_counts(spark, d):
    return panel.missing_counts(panel.enrich(_tables(spark, d)), ["dcoilwtico", "transactions"])


@query(_with("SELECT * FROM enriched", "enriched", ctes=CTE))
def enriched_sales(spark, d):
    return panel.enrich(_tables(spark, d))


@query(_with("SELECT date, store_nbr, holiday_type, locale, description FROM active", "active", ctes=CTE))
def localized_holidays(spark, d):
    t = _tables(spark, d)
    return panel.active_holidays(t["holidays"], t["stores"]).select("date", "store_nbr", "holiday_type", "locale", "description")


@query(_with("SELECT * FROM by_family", "by_family"))
def agg_family(spark, d):
    return panel.aggregate(panel.enrich(_tables(spark, d)), "family")


@query(_with("SELECT date, store_nbr, sum(sales) AS sales, sum(onpromotion) AS onpromotion, coalesce(sum(transactions), 0)::BIGINT AS transactions, round(avg(dcoilwtico), 4) AS dcoilwtico FROM enriched GROUP BY 1, 2", "enriched"))
def agg_store(spark, d):
    return panel.aggregate(panel.enrich(_tables(spark, d)), "store")


@query(_with("SELECT date, sum(sales) AS sales, sum(onpromotion) AS onpromotion, coalesce(sum(transactions), 0)::BIGINT AS transactions, round(avg(dcoilwtico), 4) AS dcoilwtico FROM enriched GROUP BY 1", "enriched"))
def agg_total(spark, d):
    return panel.aggregate(panel.enrich(_tables(spark, d)), "total")


@query(_with("SELECT CASE WHEN grouping(store_nbr) = 0 AND grouping(family) = 0 THEN 'store_family' WHEN grouping(family) = 0 THEN 'family' WHEN grouping(store_nbr) = 0 THEN 'store' ELSE 'total' END AS level, date, store_nbr, family, sum(sales) AS sales, sum(onpromotion) AS onpromotion FROM train GROUP BY GROUPING SETS ((date, store_nbr, family), (date, family), (date, store_nbr), (date))", "train"))
def agg_all_levels(spark, d):
    return panel.aggregate_all(_tables(spark, d)["train"])


@query(_with("""SELECT g.date, g.store_nbr, g.family, coalesce(t.sales, 0) AS sales, coalesce(t.onpromotion, 0) AS onpromotion
FROM (SELECT store_nbr, family, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM train GROUP BY store_nbr, family) g LEFT JOIN train t USING (date, store_nbr, family)""", "train"))
def dense_panel(spark, d):
    return panel.complete(_tables(spark, d)["train"].select("date", *SERIES, "sales", "onpromotion")).select("date", *SERIES, "sales", "onpromotion")


@query(_with("SELECT date, family, sales, onpromotion, transactions, dcoilwtico FROM fp", "fp"))
def oil_filled(spark, d):
    return _family_panel(spark, d)


@query(_with("""SELECT g.date, g.store_nbr, g.family, coalesce(e.sales, 0) AS sales, s.city, s.state, s.type, s.cluster, coalesce(e.is_localized_holiday, 0) AS is_localized_holiday
FROM (SELECT store_nbr, family, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM enriched GROUP BY store_nbr, family) g LEFT JOIN enriched e USING (date, store_nbr, family) LEFT JOIN stores s ON s.store_nbr = g.store_nbr""", "enriched", ctes=CTE))
def static_filled(spark, d):
    t = _tables(spark, d)
    return panel.complete(panel.enrich(t), stores=t["stores"]).select("date", *SERIES, "sales", "city", "state", "type", "cluster", "is_localized_holiday")


_CALENDAR = """isodow(date) - 1 AS day_of_week, month(date) AS month, quarter(date) AS quarter, day(date) AS day_of_month, week(date) AS week_of_year, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST(day(date) = 1 AS INTEGER) AS is_month_start, CAST(date = last_day(date) AS INTEGER) AS is_month_end, CAST(day(date) = 15 OR date = last_day(date) AS INTEGER) AS is_payday,
CASE WHEN day(date) <= 15 THEN 15 - day(date) ELSE date_diff('day', date, last_day(date)) END AS days_until_next_payday,
CASE WHEN date = last_day(date) THEN 0 WHEN day(date) >= 15 THEN day(date) - 15 ELSE day(date) END AS days_since_last_payday"""


@query(_with(f"SELECT date, {_CALENDAR} FROM (SELECT DISTINCT date FROM train)", "train"))
def calendar_features(spark, d):
    return add_calendar(_tables(spark, d)["train"].select("date").distinct())


@query(_with("SELECT date, family, sales, " + ", ".join(f"lag(sales, {n}) OVER w AS lag_{n}" for n in (28, 35, 42, 56, 90)) + " FROM fs WINDOW w AS (PARTITION BY family ORDER BY date)", "fs"))
def target_lags(spark, d):
    return features.add_lags(_family_sales(spark, d).select("date", "family", "sales"), FAMILY, FeatureConfig().lags, H)


def _rolling_sql(fn: str) -> str:
    sql = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "median": "median"}[fn]
    wrap = (lambda x: f"round({x}, 6)") if fn == "std" else (lambda x: x)
    cols = ", ".join(wrap(f"{sql}(l{n}) OVER (PARTITION BY family ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)") + f" AS rolling_{fn}_lag{n}_w{w}" for n in (28, 35) for w in (7, 14, 28))
    return _with(f"SELECT date, family, {cols} FROM (SELECT *, lag(sales, 28) OVER w AS l28, lag(sales, 35) OVER w AS l35 FROM fs WINDOW w AS (PARTITION BY family ORDER BY date))", "fs")


def _rolling(fn: str):
    def run(spark, d):
        out = features.add_rolling(_family_sales(spark, d), FAMILY, [28, 35], [7, 14, 28], [fn], H).drop("sales", "onpromotion")
        return out.select("date", "family", *[F.round(c, 6).alias(c) if fn == "std" else c for c in out.columns if c.startswith("rolling")])

    run.__name__ = f"rolling_{fn}"
    return run


for _fn in ("mean", "std", "min", "max", "median"):
    query(_rolling_sql(_fn))(_rolling(_fn))

_EXPANDING = "CASE WHEN count(b) OVER w >= 28 THEN {} OVER w END"


@query(_with(f"SELECT date, family, {_EXPANDING.format('avg(b)')} AS expanding_mean, round({_EXPANDING.format('stddev_samp(b)')}, 5) AS expanding_std FROM (SELECT *, lag(sales, 28) OVER (PARTITION BY family ORDER BY date) AS b FROM fs) WINDOW w AS (PARTITION BY family ORDER BY date ROWS UNBOUNDED PRECEDING)", "fs"))
def expanding_stats(spark, d):
    out = features.add_expanding(_family_sales(spark, d), FAMILY, ["mean", "std"], 28, H)
    return out.select("date", "family", "expanding_mean", F.round("expanding_std", 5).alias("expanding_std"))


@query(_with("SELECT date, family, " + ", ".join(f"lag(dcoilwtico, {n}) OVER w AS oil_lag_{n}" for n in (28, 35, 42)) + ", lag(transactions, 28) OVER w AS transactions_lag_28 FROM fp WINDOW w AS (PARTITION BY family ORDER BY date)", "fp"))
def oil_transaction_lags(spark, d):
    out = features.add_external(_family_panel(spark, d), FAMILY, [28, 35, 42], H, promotion=False)
    return out.select("date", "family", "oil_lag_28", "oil_lag_35", "oil_lag_42", "transactions_lag_28")


_EMA = {3: 40, 7: 97, 14: 194}
_EMA_SQL = ", ".join(
    f"round(list_sum(list_transform(range(1, len(l{s}) + 1), lambda i: l{s}[i] * pow({1 - 2 / (s + 1)!r}, len(l{s}) - i))) / list_sum(list_transform(range(1, len(l{s}) + 1), lambda i: pow({1 - 2 / (s + 1)!r}, len(l{s}) - i))), 6) AS onpromotion_ema_{s}"
    for s in _EMA
)


@query(_with(f"SELECT date, family, {_EMA_SQL} FROM (SELECT date, family, " + ", ".join(f"list(onpromotion) OVER (PARTITION BY family ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS l{s}" for s, n in _EMA.items()) + " FROM fs)", "fs"))
def promo_ema(spark, d):
    out = features.add_external(_family_sales(spark, d), FAMILY, [28], H, transactions=False)
    return out.select("date", "family", *[F.round(f"onpromotion_ema_{s}", 6).alias(f"onpromotion_ema_{s}") for s in _EMA])


_PROMO = {"onpromotion_lead_1": "coalesce(lead(onpromotion) OVER w, 0)", "onpromotion_lag_1": "coalesce(lag(onpromotion) OVER w, 0)", "onpromotion_roll_sum_7": "sum(onpromotion) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"} | {
    f"onpromotion_roll_max_{n}": f"max(onpromotion) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (3, 7, 14)
}


@query(_with("SELECT date, family, " + ", ".join(f"{v} AS {k}" for k, v in _PROMO.items()) + " FROM fs WINDOW w AS (PARTITION BY family ORDER BY date)", "fs"))
def promo_windows(spark, d):
    return features.add_external(_family_sales(spark, d), FAMILY, [28], H, transactions=False).select("date", "family", *_PROMO)


@query(_with("SELECT family, count(*) AS n_rows, count(lag90) AS n_kept FROM (SELECT *, lag(sales, 90) OVER (PARTITION BY family ORDER BY date) AS lag90 FROM fs) GROUP BY family", "fs"))
def feature_matrix(spark, d):
    """Rows of the full feature matrix, and those left after the warm-up of the shifted covariates."""
    full = features.build(_family_panel(spark, d), FAMILY, H)
    shifted = [c for c in features.covariates(full, "shifted") if "_std_" not in c and not c.startswith("expanding")]
    whole = F.count_if(F.array_size(F.array_compact(F.array(*[F.col(c).cast("double") for c in shifted]))) == len(shifted))
    return full.groupBy("family").agg(F.count("*").alias("n_rows"), whole.alias("n_kept"))


def _matrix_sql() -> str:
    c = FeatureConfig()
    cols = ["date", "family", "sales", "onpromotion", "transactions", "dcoilwtico", _CALENDAR, _EMA_SQL, *[f"{v} AS {k}" for k, v in _PROMO.items()]]
    cols += [f"lag(dcoilwtico, {n}) OVER w AS oil_lag_{n}" for n in c.oil_lags] + ["lag(transactions, 28) OVER w AS transactions_lag_28"]
    cols += [f"lag(sales, {n}) OVER w AS lag_{n}" for n in c.lags]
    for fn, form in {"mean": "avg({base}) {over}", "std": "round(stddev_samp({base}) {over}, 6)", "max": "max({base}) {over}"}.items():
        for n in c.rolling_base_lags:
            for size in c.rolling_windows:
                over = f"OVER (w ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"
                cols.append(f"{form.format(base=f'b{n}', over=over)} AS rolling_{fn}_lag{n}_w{size}")
    cols += [f"{_EXPANDING.format('avg(b)')} AS expanding_mean", f"round({_EXPANDING.format('stddev_samp(b)')}, 5) AS expanding_std"]
    made = ", ".join(["lag(sales, 28) OVER v AS b"] + [f"lag(sales, {n}) OVER v AS b{n}" for n in c.rolling_base_lags] + [f"list(onpromotion) OVER (v ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS l{s}" for s, n in _EMA.items()])
    return _with(f"SELECT {', '.join(cols)} FROM (SELECT *, {made} FROM fp WINDOW v AS (PARTITION BY family ORDER BY date)) WINDOW w AS (PARTITION BY family ORDER BY date) QUALIFY lag_90 IS NOT NULL", "fp")


@query(_matrix_sql())
def feature_values(spark, d):
    """Every column of the full feature matrix, for the rows past the warm-up of the shifted covariates."""
    full = features.build(_family_panel(spark, d), FAMILY, H)
    out = features.drop_warmup(full, features.covariates(full, "shifted"))
    digits = {c: 5 if c == "expanding_std" else 6 for c in out.columns if "_std" in c or "_ema_" in c}
    return out.select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in out.columns])


@query(_with("SELECT family, count(*) FILTER (WHERE i > 55) AS n, 1 AS matches_shifted, 0 AS matches_raw FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY date) AS i FROM fs) GROUP BY family HAVING count(*) > 55", "fs"))
def leak_check(spark, d):
    s = _family_sales(spark, d)
    return features.expanding_check(features.add_expanding(features.add_lags(s, FAMILY, [28], H), FAMILY, ["mean"], 28, H), FAMILY, H)


@query(_with("SELECT split, min(date) AS lo, max(date) AS hi, count(*) AS n_rows FROM (SELECT *, CASE WHEN r <= 28 THEN 'test' WHEN r <= 56 THEN 'val' ELSE 'train' END AS split FROM (SELECT *, dense_rank() OVER (ORDER BY date DESC) AS r FROM train)) GROUP BY split", "train"))
def split_tvt(spark, d):
    return windows.split(_tables(spark, d)["train"], 28, 28).groupBy("split").agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count("*").alias("n_rows"))


@query(_with('SELECT family, window_ AS "window", train_end, val_start, val_end FROM cv', "cv"))
def cv_windows(spark, d):
    return windows.cv_windows(_family_sales(spark, d), FAMILY).withColumn("window", F.col("window").cast("bigint"))


@query(_with("SELECT family, unnest(generate_series(n - 28, 365, -28))::INTEGER AS origin FROM (SELECT family, count(*) AS n FROM fs GROUP BY family) WHERE n - 28 >= 365", "fs"))
def residual_origins(spark, d):
    return windows.residual_origins(_family_sales(spark, d), FAMILY)


_ABC = "CASE WHEN cum_perc <= 0.8 THEN 'A' WHEN cum_perc <= 0.95 THEN 'B' ELSE 'C' END"


@query(_with(f"SELECT store_nbr, family, total, round(cum_perc, 9) AS cum_perc, {_ABC} AS abc_class FROM (SELECT *, sum(total) OVER (ORDER BY total DESC, store_nbr, family ROWS UNBOUNDED PRECEDING) / nullif(sum(total) OVER (), 0) AS cum_perc FROM (SELECT store_nbr, family, sum(sales) AS total FROM train GROUP BY 1, 2))", "train"))
def abc_segments(spark, d):
    return segments.abc_classes(_tables(spark, d)["train"], SERIES).withColumn("cum_perc", F.round("cum_perc", 9))


@query(_with(f'SELECT window_ AS "window", store_nbr, family, total, {_ABC} AS abc_class FROM (SELECT *, sum(total) OVER (PARTITION BY window_ ORDER BY total DESC, store_nbr, family ROWS UNBOUNDED PRECEDING) / nullif(sum(total) OVER (PARTITION BY window_), 0) AS cum_perc FROM (SELECT window_, store_nbr, t.family, sum(t.sales) AS total FROM train t JOIN cv ON cv.family = t.family AND t.date <= train_end GROUP BY ALL))', "train", "cv"))
def abc_by_window(spark, d):
    t = _tables(spark, d)["train"].join(windows.cv_windows(_family_sales(spark, d), FAMILY), "family").where("date <= train_end")
    return segments.abc_classes(t.withColumn("window", F.col("window").cast("bigint")), SERIES, by=["window"]).drop("cum_perc")


@query(_with(f"SELECT store_nbr, family, abc_class, CASE abc_class WHEN 'C' THEN 'direct' ELSE 'hybrid' END AS route, CASE WHEN contains(family, 'BRASS') THEN 0.4 WHEN contains(family, 'STEEL') THEN 0.75 ELSE 0.5 END::DOUBLE AS q FROM (SELECT *, {_ABC} AS abc_class FROM (SELECT *, sum(total) OVER (ORDER BY total DESC, store_nbr, family ROWS UNBOUNDED PRECEDING) / nullif(sum(total) OVER (), 0) AS cum_perc FROM (SELECT store_nbr, family, sum(sales) AS total FROM train GROUP BY 1, 2)))", "train"))
def route_series(spark, d):
    t = _tables(spark, d)["train"]
    routed = segments.route(segments.abc_classes(t, SERIES), t.select(*SERIES).distinct(), SERIES)
    return routed.withColumn("q", segments.quantile_policy(low="BRASS", high="STEEL").cast("double"))


@query(_with("SELECT date, family, sales - lag(sales) OVER (PARTITION BY family ORDER BY date) AS diff FROM fs QUALIFY diff IS NOT NULL", "fs"))
def first_difference(spark, d):
    s = _family_sales(spark, d)
    return tf.transform(s, tf.fit(s, FAMILY, "difference"), FAMILY).select("date", "family", F.col("transformed").alias("diff"))


@query(_with("SELECT date, family, sales AS restored FROM fs QUALIFY row_number() OVER (PARTITION BY family ORDER BY date) > 1", "fs"))
def undo_difference(spark, d):
    s = _family_sales(spark, d)
    return tf.invert(tf.transform(s, tf.fit(s, FAMILY, "difference"), FAMILY), FAMILY).select("date", "family", "restored")


@query(_with("SELECT date, family, round(ln(1 + sales), 6) AS logged, round(exp(ln(1 + sales)) - 1, 6) AS restored, round((pow(sales + 1, 0.3) - 1) / 0.3, 6) AS boxed FROM fs", "fs"))
def log_boxcox(spark, d):
    x = F.col("sales")
    boxed = tf.boxcox(x, F.lit(0.3), 1.0)
    return _family_sales(spark, d).select("date", "family", F.round(F.log1p(x), 6).alias("logged"), F.round(F.expm1(F.log1p(x)), 6).alias("restored"), F.round(boxed, 6).alias("boxed"))


@query(_with('SELECT family, window_ AS "window", date, actual, forecast FROM naive', "naive"))
def seasonal_naive(spark, d):
    return forecast.seasonal_naive(_sliced(spark, d), FAMILY).withColumn("window", F.col("window").cast("bigint"))


@query(_with('SELECT family, window_ AS "window", date, actual, round(forecast, 6) AS forecast FROM average', "average"))
def moving_average(spark, d):
    return forecast.moving_average(_sliced(spark, d), FAMILY).withColumns({"window": F.col("window").cast("bigint"), "forecast": F.round("forecast", 6)})


_METRIC_SQL = {
    "MAE": "avg(abs(actual - forecast))", "RMSE": "sqrt(avg((actual - forecast) * (actual - forecast)))", "MAPE": "avg(CASE WHEN actual <> 0 THEN abs(actual - forecast) / abs(actual) END) * 100",
    "sMAPE": "avg(abs(actual - forecast) / nullif(abs(actual) + abs(forecast), 0)) * 200", "R2": "1 - sum((actual - forecast) * (actual - forecast)) / nullif(var_pop(actual) * count(actual), 0)",
    "WAPE": "sum(abs(actual - forecast)) / nullif(sum(abs(actual)), 0) * 100", "PBIAS": "sum(forecast - actual) / nullif(sum(actual), 0) * 100",
    "TrackingSignal": "coalesce(sum(actual - forecast) / nullif(avg(abs(actual - forecast)), 0), 0)", "CV": "stddev_pop(actual) / nullif(avg(actual), 0)", "DirectionAccuracy": "avg(CAST(same AS DOUBLE))",
    "PeakCapture": "CASE WHEN count(*) FILTER (WHERE actual > bar) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE actual > bar AND forecast > bar) / count(*) FILTER (WHERE actual > bar)::DOUBLE END",
}


@query(_with('SELECT family, window_ AS "window", model, count(*) AS n_days, ' + ", ".join(f'round({v}, 4) AS "{k}"' for k, v in _METRIC_SQL.items()) + " FROM scored GROUP BY 1, 2, 3", "scored"))
def metric_table(spark, d):
    return _scores(spark, d).select("family", F.col("window").cast("bigint").alias("window"), "model", "n_days", *[F.round(m, 4).alias(m) for m in _METRIC_SQL])


_WAPES = 'SELECT family, window_, model, round(sum(abs(actual - forecast)) / nullif(sum(abs(actual)), 0) * 100, 6) AS "WAPE", avg(abs(actual - forecast)) AS "MAE", sqrt(avg((actual - forecast) * (actual - forecast))) AS "RMSE" FROM forecasts GROUP BY 1, 2, 3'


@query(_with(f', s AS ({_WAPES}) SELECT o.family, o.model, count(*) FILTER (WHERE o."WAPE" < b.best) AS wins, count(*) AS n FROM s o JOIN (SELECT family, window_, min("WAPE") AS best FROM s WHERE model <> \'blend\' GROUP BY 1, 2) b USING (family, window_) WHERE o.model = \'blend\' AND o."WAPE" IS NOT NULL GROUP BY 1, 2', "forecasts"))
def baseline_wins(spark, d):
    return metrics.wins(_scores(spark, d).withColumn("WAPE", F.round("WAPE", 6)), FAMILY)


@query(_with(f', s AS ({_WAPES}) SELECT model, round(avg("WAPE"), 4) AS "WAPE", round(avg("MAE"), 4) AS "MAE", round(avg("RMSE"), 4) AS "RMSE" FROM s GROUP BY model', "forecasts"))
def mean_by_model(spark, d):
    return metrics.mean_by_model(_scores(spark, d)).select("model", *[F.round(m, 4).alias(m) for m in ("WAPE", "MAE", "RMSE")])


@query(_with("SELECT family, n, round(n * (n + 2) * (" + " + ".join(f"pow(c{k} / v, 2) / (n - {k})" for k in range(1, 15)) + "), 4) AS q_stat FROM (SELECT family, count(*) AS n, sum(e * e) AS v, " + ", ".join(f"sum(e * l{k}) AS c{k}" for k in range(1, 15)) + " FROM (SELECT *, " + ", ".join(f"lag(e, {k}) OVER (PARTITION BY family ORDER BY date) AS l{k}" for k in range(1, 15)) + " FROM (SELECT *, sales - avg(sales) OVER (PARTITION BY family) AS e FROM fs)) GROUP BY family)", "fs"))
def ljung_box_stat(spark, d):
    return diagnostics.ljung_box(_family_sales(spark, d), FAMILY).select("family", "n", F.round("q_stat", 4).alias("q_stat"))


@query(_with("SELECT family, date, sales FROM fs QUALIFY row_number() OVER (PARTITION BY family ORDER BY date DESC) <= 232", "fs"))
def series_tail(spark, d):
    return windows.tail(_family_sales(spark, d), FAMILY, windows.smoke_tail_length(H)).select("family", "date", "sales")


@query(_with("SELECT store_nbr, family, date, sales FROM train QUALIFY date >= max(date) OVER (PARTITION BY store_nbr, family) - 399", "train"))
def recent_history(spark, d):
    return panel.recent_history(_tables(spark, d)["train"], SERIES, 400).select(*SERIES, "date", "sales")


@query(_with("SELECT store_nbr, family, count(*) AS n, max(date) AS hi FROM train WHERE date <= (SELECT max(date) - 28 FROM train) GROUP BY 1, 2", "train"))
def training_history(spark, d):
    return panel.training_history(_tables(spark, d)["train"], H).groupBy(*SERIES).agg(F.count("*").alias("n"), F.max("date").alias("hi"))


# --- fitted models: rows only ---------------------------------------------------------------------------------------


def _boxcox_sql() -> str:
    """The passes of the search over lambda as SQL: the best of a grid, thrice finer round it, then the parabola's top."""
    parts = [
        "src AS (SELECT family, count(*) AS n, min(sales) AS lo, max(sales) AS hi, min_by(sales, date) AS first_value, max_by(sales, date) AS last_value FROM fs GROUP BY family)",
        "x AS (SELECT family, ln(sales + CASE WHEN lo <= 0 THEN 1 ELSE 0 END) AS lx FROM fs JOIN src USING (family))",
        "c0 AS (SELECT family, 0.0::DOUBLE AS lam FROM src)",
    ]
    for i, step in enumerate(tf.STEPS):
        parts += [
            f"t{i} AS (SELECT x.family, k, lam, (lam + k * {step!r}::DOUBLE - 1) * sum(lx) - count(*) / 2.0 * ln(var_pop(CASE WHEN abs(lam + k * {step!r}::DOUBLE) < 1e-12 THEN lx ELSE (exp((lam + k * {step!r}::DOUBLE) * lx) - 1) / (lam + k * {step!r}::DOUBLE) END)) AS f FROM x JOIN c{i} USING (family), (SELECT unnest(range(-{tf.GRID}, {tf.GRID + 1})) AS k) GROUP BY x.family, k, lam)",
            f"b{i} AS (SELECT family, k, lam, f, lag(f) OVER w AS a, lead(f) OVER w AS c FROM t{i} WINDOW w AS (PARTITION BY family ORDER BY k) QUALIFY row_number() OVER (PARTITION BY family ORDER BY f DESC, k) = 1)",
            f"c{i + 1} AS (SELECT family, greatest(least(lam + (k + {'coalesce((a - c) / nullif(2 * (a - 2 * f + c), 0), 0)' if step == tf.STEPS[-1] else '0'}) * {step!r}::DOUBLE, 2), -2) AS lam FROM b{i})",
        ]
    return _with(", " + ", ".join(parts) + f" SELECT family, 'box_cox' AS method, round(lam, 5) AS lam, CASE WHEN lo <= 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS shift, first_value, last_value, n AS fit_size FROM src JOIN c{len(tf.STEPS)} USING (family)", "fs")


@query(_boxcox_sql())
def boxcox_mle(spark, d):
    return tf.fit(_family_sales(spark, d), FAMILY, "box_cox").withColumn("lam", F.round("lam", 5))


@query()
def transform_round_trip(spark, d):
    return tf.round_trip_error(_family_sales(spark, d), FAMILY, "box_cox")


_WEIGHTS = (0.2, 0.02, 0.2)
_SMOOTHED = """, hw_at AS (SELECT c.family, c.window_, row_number() OVER (PARTITION BY c.family, c.window_ ORDER BY date) - 1 AS i, sales AS v FROM cv c JOIN fs ON fs.family = c.family AND date <= train_end),
hw_size AS (SELECT family, window_, count(*) AS n, list(v ORDER BY i) AS y FROM hw_at GROUP BY 1, 2),
hw AS (
  SELECT family, window_, n, y, 0 AS i, list_sum(y[1:7]) / 7 AS level, (list_sum(y[8:14]) / 7 - list_sum(y[1:7]) / 7) / 7 AS trend, list_transform(y[1:7], lambda v: v - list_sum(y[1:7]) / 7) AS season FROM hw_size
  UNION ALL
  SELECT family, window_, n, y, i + 1, l, {b} * (l - level) + (1 - {b}) * trend, list_append(season[2:], {g} * (v - l) + (1 - {g}) * s)
  FROM (SELECT *, y[i + 1] AS v, season[1] AS s, {a} * (y[i + 1] - season[1]) + (1 - {a}) * (level + trend) AS l FROM hw WHERE i < n)
), smoothed AS (
  SELECT hw.family, hw.window_, f.date, f.sales AS actual, level + h * trend + season[(h - 1) % 7 + 1] AS forecast
  FROM hw JOIN cv USING (family, window_) JOIN fs f ON f.family = hw.family AND f.date BETWEEN val_start AND val_end, (SELECT unnest(range(1, 29)) AS h)
  WHERE i = n AND f.date = val_start + CAST(h - 1 AS INTEGER)
)""".format(a=_WEIGHTS[0], b=_WEIGHTS[1], g=_WEIGHTS[2])


@query(_with(_SMOOTHED + ' SELECT family, window_ AS "window", date, actual, round(forecast, 6) AS forecast FROM smoothed', "cv", "fs").replace("WITH ", "WITH RECURSIVE ", 1))
def holt_winters(spark, d):
    """Exponential smoothing at given weights, as a recursion follows it; ``backtest_scores`` fits them."""
    out = forecast.exponential_smoothing(_sliced(spark, d), FAMILY, weights=_WEIGHTS)
    return out.withColumns({"window": F.col("window").cast("bigint"), "forecast": F.round("forecast", 6)})


@query()
def holt_winters_fitted(spark, d):
    return forecast.exponential_smoothing(_sliced(spark, d), FAMILY)


@query()
def trend_season(spark, d):
    s, cols = _planned_sales(spark, d)
    return forecast.trend_forecast(windows.slice_windows(s, windows.cv_windows(s, FAMILY), FAMILY), FAMILY, regressors=cols)


@query()
def decomposition(spark, d):
    s, cols = _planned_sales(spark, d)
    return forecast.decomposition(s, FAMILY, regressors=cols)


@query()
def adf_kpss(spark, d):
    return diagnostics.stationarity(_family_sales(spark, d), FAMILY)


@query()
def oos_residuals(spark, d):
    s, cols = _planned_sales(spark, d)
    return forecast.rolling_origin_residuals(s, FAMILY, H, 365, regressors=cols)


_ORIGINS = """, placed AS (SELECT family, date, sales, row_number() OVER (PARTITION BY family ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY family) AS n FROM fs),
o AS (SELECT family, unnest(generate_series(n - 28, 365, -28)) AS origin FROM (SELECT DISTINCT family, n FROM placed) WHERE n - 28 >= 365),
p AS (SELECT o.family, origin, avg(sales) AS forecast, max(date) AS origin_end FROM o JOIN placed ON placed.family = o.family AND i >= origin - 28 AND i < origin GROUP BY 1, 2),
r AS (SELECT p.family, date, origin, origin_end, sales - forecast AS residual FROM p JOIN placed ON placed.family = p.family AND i >= origin AND i < origin + 28)"""


@query(_with(_ORIGINS + " SELECT family, date, origin, origin_end, round(residual, 6) AS residual FROM r", "fs"))
def oos_residuals_flat(spark, d):
    """Out-of-sample residuals of a forecaster that SQL can follow."""
    out = forecast.rolling_origin_residuals(_family_sales(spark, d), FAMILY, H, 365, forecaster=forecast.flat_forecaster())
    return out.withColumn("residual", F.round("residual", 6))


_OWN_LAGS = (28, 35, 42, 56)


@query(_with(_ORIGINS + " SELECT r.family, r.date, r.origin, round(r.residual, 6) AS residual, " + ", ".join(f"round(l{n}.residual, 6) AS own_lag_{n}" for n in _OWN_LAGS) + " FROM r " + " ".join(f"LEFT JOIN r l{n} ON l{n}.family = r.family AND l{n}.date = r.date - {n} AND l{n}.date <= r.origin_end" for n in _OWN_LAGS), "fs"))
def residual_lags(spark, d):
    """What the boosted model of residuals is trained on: each residual with those of 28 days back and more, as its origin knew them."""
    r = forecast.rolling_origin_residuals(_family_sales(spark, d), FAMILY, H, 365, forecaster=forecast.flat_forecaster())
    out = forecast.lagged_residuals(r, FAMILY, list(_OWN_LAGS))
    return out.select("family", "date", "origin", *[F.round(c, 6).alias(c) for c in ("residual", *[f"own_lag_{n}" for n in _OWN_LAGS])])


def _model_frame(f: DataFrame, keys: list[str], lags: list[int] | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """Feature rows past the warm-up with numeric columns, the columns of the boosted trees, and those of the trend model."""
    cols = [c for c in [*features.covariates(f, "planned"), *features.covariates(f, "shifted")] if lags is None or not c.startswith("lag_") or int(c[4:]) in lags]
    known = _regressors(f)
    return f.where("lag_90 is not null").select(*keys, "date", "sales", *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*cols, *known])]), cols, known


def _family_windows(spark, d, route: str):
    """Feature rows of the family totals, their last backtest window, all on one route."""
    f, cols, known = _model_frame(features.build(_family_panel(spark, d), FAMILY, H), FAMILY)
    sliced = windows.slice_windows(f, windows.cv_windows(f, FAMILY).where("window = 4"), FAMILY)
    return sliced.withColumn("route", F.lit(route)), cols, known


@query()
def hybrid_forecast(spark, d):
    sliced, cols, known = _family_windows(spark, d, "hybrid")
    return backtest.learned_forecasts(sliced, FAMILY, cols, known)


@query()
def direct_forecast(spark, d):
    sliced, cols, known = _family_windows(spark, d, "direct")
    lags = {f"lag_{-n}" for n in segments.direct_lags(H)}
    return backtest.learned_forecasts(sliced, FAMILY, [c for c in cols if not c.startswith("lag_") or c in lags], known)


@query()
def tune_trials(spark, d):
    """The search of the reference: the whole panel is prepared, then one series is taken (its largest here)."""
    f, cols, known = _model_frame(features.build(_family_panel(spark, d), FAMILY, H), FAMILY)
    largest = f.groupBy(*FAMILY).agg(F.sum("sales").alias("total")).orderBy(F.desc("total"), *FAMILY).limit(1)
    own = backtest.filter_series(f, largest, FAMILY)
    sliced = windows.slice_windows(own, windows.cv_windows(own, FAMILY).where("window = 4"), FAMILY).withColumn("route", F.lit("hybrid"))
    return backtest.tune(sliced, FAMILY, cols, known, {"two": [-28, -56], "four": [-28, -35, -42, -56]})


def _backtested(spark, d) -> DataFrame:
    """Forecasts of routed models and baselines: the two largest and the two smallest series with history enough, in all
    windows, classes over the whole catalog. Sales, the panel and the windows' rows are read several times, so they are kept."""
    t = _tables(spark, d)
    t["train"] = kept(t["train"], "train")
    daily = kept(panel.aggregate(panel.enrich(t), "store_family"), "daily")
    span = daily.groupBy(*SERIES).agg(F.sum("sales").alias("total"), F.date_diff(F.max("date"), F.min("date")).alias("days")).where("days >= 730")
    chosen = span.orderBy(F.desc("total"), *SERIES).limit(2).unionByName(span.orderBy("total", *SERIES).limit(2))
    own = panel.complete(backtest.filter_series(daily, chosen, SERIES), stores=t["stores"])
    f, cols, known = _model_frame(features.build(own, SERIES, H), SERIES)
    cv = windows.cv_windows(f, SERIES)
    routes = backtest.window_routes(t["train"], cv, SERIES).select(*SERIES, "window", "route")
    sliced = kept(windows.slice_windows(f, cv, SERIES).join(routes, [*SERIES, "window"]), "windows")
    learned = backtest.learned_forecasts(sliced, SERIES, cols, known)
    return backtest.scored_forecasts(sliced, learned, SERIES, H)


@query()
def backtest_scores(spark, d):
    """All metrics of four models in five windows of four series."""
    return metrics.metric_table(_backtested(spark, d), [*SERIES, "window", "model"])


@query()
def backtest_wins(spark, d):
    # both sides of the comparison start from the kept scores, which halves the plan
    return metrics.wins(kept(metrics.metric_table(_backtested(spark, d), [*SERIES, "window", "model"]), "scores"), SERIES)


@query(_with(", past AS (SELECT c.family, c.window_, avg(t.sales) AS mean, max_by(t.sales, t.date) AS last FROM cv c JOIN fs t ON t.family = c.family AND t.date > c.train_end - 28 AND t.date <= c.train_end GROUP BY ALL)" + """ SELECT n.family, n.window_ AS "window", n.date, n.actual, round(CASE WHEN n.window_ % 2 = 0 THEN mean ELSE last END, 6) AS forecast, CASE WHEN n.window_ % 2 = 0 THEN 'mean' ELSE 'last' END AS model FROM naive n JOIN past USING (family, window_)""", "naive", "cv", "fs"))
def backtest_function(spark, d):
    """A caller's forecast function whose model changes from window to window."""

    def forecast_fn(train, val):
        if val["window"].iloc[0] % 2 == 0:
            return [train["sales"].iloc[-28:].mean()] * len(val), "mean"
        return [train["sales"].iloc[-1]] * len(val), "last"

    out = backtest.forecasts_of(_sliced(spark, d), FAMILY, forecast_fn)
    return out.select("family", F.col("window").cast("bigint").alias("window"), "date", "actual", F.round("forecast", 6).alias("forecast"), "model")


@query(_with(f"SELECT train_end, store_nbr, family, total, {_ABC} AS abc_class FROM (SELECT *, sum(total) OVER (PARTITION BY train_end ORDER BY total DESC, store_nbr, family ROWS UNBOUNDED PRECEDING) / nullif(sum(total) OVER (PARTITION BY train_end), 0) AS cum_perc FROM (SELECT train_end, store_nbr, t.family, sum(t.sales) AS total FROM train t JOIN (SELECT DISTINCT train_end FROM cv) ON t.date <= train_end GROUP BY ALL))", "train", "cv"))
def classes_by_end(spark, d):
    """Classes of the whole catalog at each end of a training window, from running totals."""
    ends = windows.cv_windows(_family_sales(spark, d), FAMILY)
    return segments.abc_classes(backtest.prefix_totals(_tables(spark, d)["train"], ends, SERIES), SERIES, "total", by=["train_end"]).drop("cum_perc")


@query(_with("SELECT store_nbr, date, family, sales FROM train ORDER BY store_nbr, date, family", "train"))
def sales_by_store_and_date(spark, d):
    return panel.ordered(_tables(spark, d)["train"], ["store_nbr"]).select("store_nbr", "date", "family", "sales")


_FLAT = ", flat AS (SELECT c.family, c.window_, avg(t.sales) AS forecast FROM cv c JOIN fs t ON t.family = c.family AND t.date > c.train_end - 28 AND t.date <= c.train_end GROUP BY ALL), every AS (SELECT * FROM forecasts WHERE model <> 'blend' UNION ALL SELECT n.family, n.window_, n.date, n.actual, f.forecast, 'flat' FROM naive n JOIN flat f USING (family, window_))"


@query(_with(_FLAT + ' SELECT family, window_ AS "window", model, round(avg(abs(actual - forecast)), 6) AS mae, round(sum(abs(actual - forecast)) / nullif(sum(abs(actual)), 0) * 100, 6) AS wape FROM every GROUP BY 1, 2, 3', "forecasts", "cv", "fs"))
def backtest_flat(spark, d):
    """The backtest driver with a model that SQL can follow, beside two of the baselines."""
    s = _sliced(spark, d)
    scores = metrics.metric_table(backtest.scored_forecasts(s, backtest.flat_forecasts(s, FAMILY), FAMILY, H).where("model <> 'exponential_smoothing'"), [*FAMILY, "window", "model"])
    return scores.select("family", F.col("window").cast("bigint").alias("window"), "model", F.round("MAE", 6).alias("mae"), F.round("WAPE", 6).alias("wape"))


@query(_with("SELECT abc_class, count(*) AS n_series FROM (SELECT CASE WHEN cum <= 0.8 THEN 'A' WHEN cum <= 0.95 THEN 'B' ELSE 'C' END AS abc_class FROM (SELECT sum(total) OVER (ORDER BY total DESC, store_nbr, family ROWS UNBOUNDED PRECEDING) / nullif(sum(total) OVER (), 0) AS cum FROM (SELECT store_nbr, family, sum(sales) AS total FROM train GROUP BY 1, 2))) GROUP BY 1", "train"))
def class_counts(spark, d):
    return segments.class_counts(segments.abc_classes(_tables(spark, d)["train"], SERIES))


@query(_with("SELECT family, date, row_number() OVER (PARTITION BY family ORDER BY date) - 1 AS position FROM fs", "fs"))
def series_positions(spark, d):
    return windows.positions(_family_sales(spark, d), FAMILY).select("family", "date", F.col("position").cast("bigint").alias("position"))


@query((_with(_SMOOTHED + ' SELECT family, window_ AS "window", date, actual, round(forecast, 6) AS forecast, model FROM (SELECT * FROM forecasts WHERE model <> \'blend\' UNION ALL SELECT *, \'exponential_smoothing\' FROM smoothed)', "forecasts", "cv", "fs")))
def baseline_forecasts(spark, d):
    """The three baselines, exponential smoothing at given weights."""
    out = forecast.baseline_forecasts(_sliced(spark, d), FAMILY, weights=_WEIGHTS)
    return out.select("family", F.col("window").cast("bigint").alias("window"), "date", "actual", F.round("forecast", 6).alias("forecast"), "model")


_LAST = ", f AS (SELECT * FROM naive WHERE window_ = 4)"
_BANDED = ", band AS (SELECT family, quantile_cont(actual - forecast, 0.05) AS lo, quantile_cont(actual - forecast, 0.95) AS hi FROM f GROUP BY family)"


@query(_with(_LAST + _BANDED + """ SELECT s.family, s.date, 'history' AS kind, sales AS value, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi FROM fs s JOIN cv c ON c.family = s.family AND window_ = 4 AND date > train_end - 90 AND date <= train_end
UNION ALL SELECT family, date, 'actual', actual, NULL, NULL FROM f
UNION ALL SELECT family, date, 'forecast', forecast, round(greatest(forecast + lo, 0), 6), round(forecast + hi, 6) FROM f JOIN band USING (family)""", "naive"))
def forecast_report(spark, d):
    """Plot data of the seasonal-naive forecast: history, actual and forecast rows with the band of its errors."""
    s = _sliced(spark, d).where("window = 4")
    past = s.where("split = 'train' and date > date_sub(train_end, 90)")
    out = report.forecast_rows(past, report.error_band(forecast.seasonal_naive(s, FAMILY), FAMILY), FAMILY)
    return out.withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


@query()
def hybrid_report(spark, d):
    """Plot data of the hybrid model with its own band."""
    sliced, cols, known = _family_windows(spark, d, "hybrid")
    past = sliced.where("split = 'train' and date > date_sub(train_end, 90)")
    return report.forecast_rows(past, backtest.learned_forecasts(sliced, FAMILY, cols, known), FAMILY)


@query(_with(""", e AS (SELECT family, actual - forecast AS residual FROM naive), s AS (SELECT family, min(residual) AS a, max(residual) AS b FROM e GROUP BY family),
n AS (SELECT family, CASE WHEN b > a THEN least(floor((residual - a) / (b - a) * 50), 49) ELSE 0 END::BIGINT AS bin, count(*) AS n FROM e JOIN s USING (family) GROUP BY 1, 2)
SELECT s.family, i AS bin, round(a + (b - a) * i / 50, 6) AS lo, round(a + (b - a) * (i + 1) / 50, 6) AS hi, coalesce(n.n, 0) AS n FROM s CROSS JOIN range(50) t(i) LEFT JOIN n ON n.family = s.family AND n.bin = i""", "naive"))
def residual_histogram(spark, d):
    e = forecast.seasonal_naive(_sliced(spark, d), FAMILY).withColumn("residual", F.col("actual") - F.col("forecast"))
    return report.histogram(e, FAMILY).withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


_DASHBOARD = ["MAPE", "RMSE", "DirectionAccuracy", "PeakCapture"]


@query(_with("SELECT family, " + ", ".join(f'round({_METRIC_SQL[m]}, 4) AS "{m}"' for m in _DASHBOARD) + " FROM scored WHERE window_ = 4 AND model = 'seasonal_naive' GROUP BY 1", "scored").replace("FROM train GROUP BY 1, 2", "FROM train WHERE store_nbr BETWEEN 1 AND 5 GROUP BY 1, 2"))
def dashboard_metrics(spark, d):
    return report.dashboard(_tables(spark, d)["train"], stores=[1, 2, 3, 4, 5]).select("family", *[F.round(m, 4).alias(m) for m in _DASHBOARD])


@query(_with('SELECT n.family, n.window_ AS "window", n.date, n.actual, round(a.forecast, 6) AS trend, round(n.forecast / nullif(a.forecast, 0), 6) AS seasonality, n.actual - n.forecast AS residual FROM naive n JOIN average a USING (family, window_, date)', "naive", "average"))
def baseline_components(spark, d):
    """Components of the weekly-naive forecast round the moving average."""
    s = _sliced(spark, d)
    by = [*FAMILY, "window", "date"]
    f = forecast.seasonal_naive(s, FAMILY).join(forecast.moving_average(s, FAMILY).select(*by, F.col("forecast").alias("trend")), by)
    out = forecast.components(f, FAMILY)
    return out.withColumns({"window": F.col("window").cast("bigint"), "trend": F.round("trend", 6), "seasonality": F.round("seasonality", 6)})


@query()
def in_sample_residuals(spark, d):
    s, cols = _planned_sales(spark, d)
    return forecast.in_sample_residuals(s, FAMILY, regressors=cols)


# --- checks and small operators -------------------------------------------------------------------------------------


@query(_with("SELECT family, count(*) AS n_rows, count(DISTINCT date) AS n_dates, count(*) = count(DISTINCT date) AS is_unique FROM train GROUP BY 1 UNION ALL SELECT family, count(*), count(DISTINCT date), count(*) = count(DISTINCT date) FROM fs GROUP BY 1", "train", "fs"))
def date_uniqueness(spark, d):
    """Dates repeat over shops in the sales and are unique in the family totals."""
    return windows.unique_dates(_tables(spark, d)["train"], FAMILY).unionByName(windows.unique_dates(_family_sales(spark, d), FAMILY))


@query(_with("SELECT DISTINCT model FROM forecasts", "forecasts"))
def model_names(spark, d):
    return metrics.model_names(_scores(spark, d))


@query(_with('SELECT family, window_ AS "window", max(abs(actual - forecast)) AS max_error, round(avg(abs(actual - forecast)), 6) AS mean_error FROM naive GROUP BY 1, 2', "naive"))
def error_summary(spark, d):
    out = metrics.error_summary(forecast.seasonal_naive(_sliced(spark, d), FAMILY), [*FAMILY, "window"])
    return out.withColumns({"window": F.col("window").cast("bigint"), "mean_error": F.round("mean_error", 6)})


@query(_with(', r AS (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS r FROM (SELECT DISTINCT date FROM train)) SELECT w AS "window", max(date) FILTER (WHERE r = (4 - w) * 14 + 28) AS train_end, max(date) FILTER (WHERE r = (4 - w) * 14 + 27) AS val_start, max(date) FILTER (WHERE r = (4 - w) * 14) AS val_end FROM r, range(5) t(w) GROUP BY w', "train"))
def panel_windows(spark, d):
    return windows.panel_windows(_tables(spark, d)["train"]).withColumn("window", F.col("window").cast("bigint"))


@query(_with('SELECT family, date, window_ AS "window", forecast FROM naive QUALIFY row_number() OVER (PARTITION BY family, date ORDER BY window_ DESC) = 1', "naive"))
def latest_forecasts(spark, d):
    """Windows overlap; each day keeps the forecast of the latest window."""
    out = windows.keep_latest(forecast.seasonal_naive(_sliced(spark, d), FAMILY), FAMILY, "window")
    return out.select("family", "date", F.col("window").cast("bigint").alias("window"), "forecast")


@query("SELECT o_orderpriority, o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders QUALIFY CAST(o_orderdate AS DATE) < lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey)")
def unsorted_orders(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderpriority", "o_orderkey", F.to_date("o_orderdate").alias("date"))
    return windows.unsorted_rows(o, ["o_orderpriority"], "o_orderkey")


@query(_with("SELECT date, store_nbr::INTEGER AS store_nbr, family, sales::DOUBLE AS sales, onpromotion::DOUBLE AS onpromotion, dcoilwtico::DOUBLE AS dcoilwtico, transactions::DOUBLE AS transactions, cluster::INTEGER AS cluster FROM enriched", "enriched"))
def typed_panel(spark, d):
    """Types come back from text."""
    e = panel.enrich(_tables(spark, d)).select("date", *SERIES, "sales", "onpromotion", "dcoilwtico", "transactions", "cluster")
    return panel.cast_types(e.withColumns({c: F.col(c).cast("string") for c in ("store_nbr", "sales", "transactions", "cluster")}))


@query(_with("SELECT family, date, lag(sales, 28) OVER w AS lag_28, lag(sales, 90) OVER w AS lag_90 FROM fs WINDOW w AS (PARTITION BY family ORDER BY date) QUALIFY lag_90 IS NOT NULL", "fs"))
def warm_rows(spark, d):
    """Rows past the warm-up of the shifted covariates, numeric columns only."""
    full = features.build(_family_panel(spark, d), FAMILY, H)
    return features.numeric(features.drop_warmup(full, features.covariates(full, "shifted")), ["family", "date"]).select("family", "date", "lag_28", "lag_90")


@query(_with("SELECT family, date, sales, onpromotion FROM fs WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'", "fs"))
def covariate_slice(spark, d):
    return windows.time_slice(_family_sales(spark, d), FAMILY, "1997-01-01", "1997-06-30").select("family", "date", "sales", "onpromotion")


@query(_with("SELECT family, count(*) AS n, min(date) AS lo FROM train WHERE date > (SELECT max(date) - 28 FROM train) GROUP BY 1", "train"))
def app_holdout(spark, d):
    return panel.holdout(_tables(spark, d)["train"], H).groupBy("family").agg(F.count("*").alias("n"), F.min("date").alias("lo"))


@query(_with(", span AS (SELECT family, CAST(unnest(generate_series((SELECT min(date) FROM train), (SELECT max(date) FROM train), INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT family FROM train)) SELECT family, date, coalesce(sales, 0) AS sales FROM span LEFT JOIN f0 USING (family, date)", "f0"))
def panel_completed(spark, d):
    """Every series from the panel's first day to its last."""
    by = _tables(spark, d)["train"].groupBy("date", "family").agg(F.sum("sales").alias("sales"))
    return panel.complete(by, "family", scope="panel").select("family", "date", "sales")


@query(_with(f"SELECT store_nbr, family, total, {_ABC} AS abc_class FROM (SELECT *, sum(total) OVER (ORDER BY total DESC, store_nbr, family ROWS UNBOUNDED PRECEDING) / nullif(sum(total) OVER (), 0) AS cum_perc FROM (SELECT store_nbr, family, sum(sales) AS total FROM train WHERE store_nbr = 1 OR family LIKE '%BRASS%' GROUP BY 1, 2))", "train"))
def abc_of_catalog(spark, d):
    """Classes within a catalog of chosen series instead of all."""
    t = _tables(spark, d)["train"]
    catalog = segments.series_catalog([t.where("store_nbr = 1"), t.where("family like '%BRASS%'")], SERIES)
    return segments.abc_classes(backtest.filter_series(t, catalog, SERIES), SERIES).drop("cum_perc")


@query(_with("SELECT store_nbr, family, month, count(sales) AS n, count(*) FILTER (WHERE isfinite(sales)) AS n_finite, max(sales) - min(sales) <= 1e-8 AS is_constant, CASE WHEN max(sales) - min(sales) > 1e-8 AND min(sales) <= 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS shift, CASE WHEN max(sales) - min(sales) > 1e-8 THEN 'box_cox' WHEN min(sales) >= 0 THEN 'log' ELSE 'none' END AS method FROM (SELECT store_nbr, family, CAST(date_trunc('month', date) AS DATE) AS month, sales - 30 AS sales FROM train) GROUP BY 1, 2, 3", "train"))
def boxcox_policy(spark, d):
    """What box_cox comes to in each month of each series, of sales less 30."""
    t = _tables(spark, d)["train"].select(*SERIES, F.trunc("date", "month").alias("month"), (F.col("sales") - 30).alias("sales"))
    return tf.boxcox_policy(t, [*SERIES, "month"])


_EDGED = "CASE WHEN l < 0 THEN least(y, -1 / l - 1e-6) ELSE greatest(y, -1 / l + 1e-6) END"


@query(_with(f"SELECT family, date, l AS lam, round({_EDGED}, 6) AS clipped, round(ln(pow({_EDGED} * l + 1, 1 / l)), 6) AS log_restored FROM (SELECT family, date, l, (sales - 60) / 20 AS y FROM fs, (VALUES (-0.5::DOUBLE), (0.5::DOUBLE)) t(l))", "fs"))
def boxcox_inverse(spark, d):
    """Inverse Box-Cox of values that partly lie outside its range, and their nearest value inside."""
    y, lam = (F.col("sales") - 60) / 20, F.col("lam")
    s = _family_sales(spark, d).withColumn("lam", F.explode(F.array(F.lit(-0.5), F.lit(0.5))))
    return s.select("family", "date", "lam", F.round(tf.clip_to_domain(y, lam), 6).alias("clipped"), F.round(F.log(tf.inverse_boxcox(y, lam)), 6).alias("log_restored"))


@query(_with("SELECT DISTINCT store_nbr || ' | ' || family AS label FROM train", "train"))
def series_labels(spark, d):
    return _tables(spark, d)["train"].select(diagnostics.series_label(SERIES).alias("label")).distinct()


_TRIALS = " UNION ALL ".join(f"SELECT {n}::BIGINT AS trial, round(sum(abs(n.actual - f.forecast)) / sum(abs(n.actual)) * 100, 6) AS objective FROM naive n JOIN (SELECT c.family, c.window_, sum(t.sales) / {n} AS forecast FROM cv c JOIN fs t ON t.family = c.family AND t.date > c.train_end - {n} AND t.date <= c.train_end GROUP BY ALL) f USING (family, window_)" for n in (7, 28, 91))


@query(_with(f"SELECT * FROM ({_TRIALS}) ORDER BY objective, trial LIMIT 1", "naive", "cv", "fs"))
def best_trial(spark, d):
    """The number of days whose mean forecasts best."""
    s = _sliced(spark, d)
    wape = metrics.metric_expressions()["WAPE"]
    trials = [backtest.flat_forecasts(s, FAMILY, n).agg(F.lit(n).cast("bigint").alias("trial"), F.round(wape, 6).alias("objective")) for n in (7, 28, 91)]
    return forecast.best_trial(trials[0].unionAll(trials[1]).unionAll(trials[2]))


@query(_with("""SELECT 'train' AS name, count(*) AS n_rows, sum(sales)::DOUBLE AS amount FROM train UNION ALL SELECT 'stores', count(*), sum(cluster) FROM stores UNION ALL SELECT 'oil', count(*), round(sum(dcoilwtico), 2) FROM oil
UNION ALL SELECT 'holidays', count(*), count(*) FILTER (WHERE transferred) FROM holidays UNION ALL SELECT 'transactions', count(*), sum(transactions) FROM transactions""", "train", "stores", "oil", "holidays", "transactions", ctes=CTE))
def loaded_tables(spark, d):
    """The five tables written as CSV, read with their schemas, kept as Parquet and read from there."""
    folder = scratch_folder(spark, "tables")
    t = _tables(spark, d)
    t["train"] = t["train"].withColumn("id", F.xxhash64("date", *SERIES))
    write_csv(t, folder)
    for _ in range(2):
        got = TableLoader(spark, folder, f"{folder}/cache").load_all()
    amounts = {"train": F.sum("sales"), "stores": F.sum("cluster"), "oil": F.round(F.sum("dcoilwtico"), 2), "holidays": F.count_if("transferred"), "transactions": F.sum("transactions")}
    rows = [got[name].agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), a.cast("double").alias("amount")) for name, a in amounts.items()]
    return reduce(DataFrame.unionAll, rows)
