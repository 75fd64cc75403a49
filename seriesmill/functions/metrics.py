"""Forecast metrics as aggregate expressions; every ratio is null where its denominator is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BASELINES = ["seasonal_naive", "moving_average", "exponential_smoothing"]


def metric_expressions(y: str = "actual", p: str = "forecast") -> dict[str, Column]:
    a, f = F.col(y), F.col(p)
    e = F.abs(a - f)
    return {
        "MAE": F.avg(e), "RMSE": F.sqrt(F.avg((a - f) * (a - f))), "MAPE": F.avg(F.when(a != 0, F.try_divide(e, F.abs(a)))) * 100,
        "sMAPE": F.avg(F.try_divide(e, F.abs(a) + F.abs(f))) * 200, "R2": 1 - F.try_divide(F.sum((a - f) * (a - f)), F.var_pop(a) * F.count(a)),
        "WAPE": F.try_divide(F.sum(e), F.sum(F.abs(a))) * 100, "PBIAS": F.try_divide(F.sum(f - a), F.sum(a)) * 100,
        "TrackingSignal": F.coalesce(F.try_divide(F.sum(a - f), F.avg(e)), F.lit(0.0)), "CV": F.try_divide(F.stddev_pop(a), F.avg(a)),
    }


def metric_table(df: DataFrame, keys: list[str], y: str = "actual", p: str = "forecast") -> DataFrame:
    """All metrics of each group in one aggregation, after one window pass for direction and peaks."""
    w = W.partitionBy(*keys).orderBy("date")
    same = F.signum(F.col(y) - F.lag(y).over(w)) == F.signum(F.col(p) - F.lag(p).over(w))
    bar = F.percentile(F.col(y), 0.9).over(W.partitionBy(*keys))
    out = df.where(f"{y} is not null and {p} is not null").withColumns({"_same": same.cast("double"), "_bar": bar})
    peaks = F.count_if(F.col(y) > F.col("_bar"))
    caught = F.count_if((F.col(y) > F.col("_bar")) & (F.col(p) > F.col("_bar")))
    return out.groupBy(*keys).agg(*[c.alias(k) for k, c in metric_expressions(y, p).items()], F.avg("_same").alias("DirectionAccuracy"), F.when(peaks == 0, 1.0).otherwise(F.try_divide(caught, peaks)).alias("PeakCapture"), F.count("*").alias("n_days"))


def wins(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model, wins, n): windows where a learned model's WAPE is under the best baseline's; ties lose."""
    best = scores.where(F.col("model").isin(*BASELINES) & F.col("WAPE").isNotNull()).groupBy(*keys, "window").agg(F.min("WAPE").alias("best"))
    own = scores.where(~F.col("model").isin(*BASELINES) & F.col("WAPE").isNotNull())
    return own.join(best, [*keys, "window"]).groupBy(*keys, "model").agg(F.count_if(F.col("WAPE") < F.col("best")).alias("wins"), F.count("*").alias("n"))


def model_names(scores: DataFrame) -> DataFrame:
    return scores.select("model").distinct()


def error_summary(df: DataFrame, keys: list[str], y: str = "actual", p: str = "forecast") -> DataFrame:
    """(keys, max_error, mean_error) of the absolute differences; rows that lack either side don't count."""
    e = F.abs(F.col(y) - F.col(p))
    e = F.when(~F.isnan(e), e)
    return df.groupBy(*keys).agg(F.max(e).alias("max_error"), F.avg(e).alias("mean_error"))


def mean_by_model(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").agg(*[F.avg(m).alias(m) for m in ("WAPE", "MAE", "RMSE")])
