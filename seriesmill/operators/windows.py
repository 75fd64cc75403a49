"""Splits, backtest windows and residual origins, as small DataFrames joined to the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import PipelineConfig


def split(df: DataFrame, horizon: int, validation: int) -> DataFrame:
    """Add ``split``: test is the last ``horizon`` distinct dates, val the ``validation`` before, train the rest; too few dates
    are an error when the rows are read."""
    if horizon <= 0 or validation <= 0:
        raise ValueError("sizes must be positive")
    last = df.select("date").where("date is not null").distinct().orderBy(F.desc("date")).limit(horizon + validation + 1)
    dates = last.agg(F.sort_array(F.collect_list("date"), False)).scalar()
    test, val = (F.get(dates, n) for n in (horizon, horizon + validation))
    enough = F.when(val.isNull(), F.raise_error(F.lit("too few dates")).cast("string"))
    return df.withColumn("split", enough.when(F.col("date") > test, "test").when(F.col("date") > val, "val").otherwise("train"))


def _sizes(horizon: int | None, n_windows: int | None, stride: int | None, config: PipelineConfig | None) -> tuple[int, int, int]:
    """Sizes as given, the others as configured."""
    c = config or PipelineConfig()
    return tuple(b if a is None else a for a, b in ((horizon, c.forecast_horizon), (n_windows, c.cv_windows), (stride, c.cv_stride)))


def cv_windows(df: DataFrame, keys: list[str], horizon: int | None = None, n_windows: int | None = None, stride: int | None = None, config: PipelineConfig | None = None) -> DataFrame:
    """(keys, window, train_end, val_start, val_end) of each gapless series long enough; the last window ends with it."""
    horizon, n_windows, stride = _sizes(horizon, n_windows, stride, config)
    if min(horizon, n_windows, stride) <= 0:
        raise ValueError("sizes must be positive")
    need = horizon + (n_windows - 1) * stride
    span = df.groupBy(*keys).agg(F.min("date").alias("lo"), F.max("date").alias("hi")).where(F.date_diff("hi", "lo") + 1 > need)
    back = span.select(*keys, "hi", F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1))).alias("window"))
    end = F.date_sub("hi", (F.lit(n_windows - 1) - F.col("window")) * stride)
    return back.select(*keys, "window", F.date_sub(end, horizon).alias("train_end"), F.date_sub(end, horizon - 1).alias("val_start"), end.alias("val_end"))


def panel_windows(df: DataFrame, horizon: int | None = None, n_windows: int | None = None, stride: int | None = None, config: PipelineConfig | None = None) -> DataFrame:
    """(window, train_end, val_start, val_end) for all series alike, counted in the panel's distinct dates; the last window
    ends with the panel. Too few dates are an error when the windows are read."""
    horizon, n_windows, stride = _sizes(horizon, n_windows, stride, config)
    if min(horizon, n_windows, stride) <= 0:
        raise ValueError("sizes must be positive")
    need = horizon + (n_windows - 1) * stride
    dates = df.select("date").where("date is not null").distinct().orderBy(F.desc("date")).limit(need + 1).agg(F.sort_array(F.collect_list("date"), False).alias("d"))
    numbers = F.when(F.size("d") > need, F.sequence(F.lit(0), F.lit(n_windows - 1))).otherwise(F.raise_error(F.lit("too few dates")))
    back = (F.lit(n_windows - 1) - F.col("window")) * stride
    return dates.select("d", F.explode(numbers).alias("window")).select("window", F.get("d", back + horizon).alias("train_end"), F.get("d", back + horizon - 1).alias("val_start"), F.get("d", back).alias("val_end"))


def slice_windows(df: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Panel rows of each window, ``split`` train or val; nothing after val_end."""
    # a handful of rows a series; the optimiser broadcasts them under its size threshold and else joins on the keys
    out = df.join(windows, keys).where(F.col("date") <= F.col("val_end"))
    return out.withColumn("split", F.when(F.col("date") <= F.col("train_end"), "train").otherwise("val"))


def origins(n: int, horizon: int, min_train: int, stride: int) -> list[int]:
    """Ends of training prefixes, ascending, walking back from n - horizon."""
    if min(horizon, min_train, stride) <= 0 or stride > horizon:
        raise ValueError("sizes must be positive, and the stride no longer than the horizon")
    out = list(range(n - horizon, min_train - 1, -stride))[::-1]
    if not out:
        raise ValueError("series too short for one origin")
    return out


def residual_origins(df: DataFrame, keys: list[str], horizon: int | None = None, min_train: int | None = None, stride: int | None = None, config: PipelineConfig | None = None) -> DataFrame:
    """(keys, origin): training lengths of each gapless series that has one; the stride is the horizon unless given."""
    c = config or PipelineConfig()
    horizon, min_train = horizon or c.forecast_horizon, min_train or c.residual_min_train_size
    stride = stride or horizon
    n = df.groupBy(*keys).agg((F.date_diff(F.max("date"), F.min("date")) + 1).alias("n")).where(F.col("n") - horizon >= min_train)
    return n.select(*keys, F.explode(F.sequence(F.col("n") - horizon, F.lit(min_train), F.lit(-stride))).alias("origin"))


def tail(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each series."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("date")))).where(F.col("_n") <= n).drop("_n")


def positions(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy("date")) - 1)


def keep_latest(df: DataFrame, keys: list[str], origin: str = "origin") -> DataFrame:
    """One row a date: that of the latest origin."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys, "date").orderBy(F.desc(origin)))).where("_n = 1").drop("_n")


def unique_dates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_rows, n_dates, is_unique): whether each series has one row a date."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct("date").alias("n_dates")).withColumn("is_unique", F.col("n_rows") == F.col("n_dates"))


def time_slice(df: DataFrame, keys: list[str], lo, hi) -> DataFrame:
    """Rows from ``lo`` to ``hi``; a series that doesn't reach both is an error when the rows are read."""
    a, b, w = F.lit(lo).cast("date"), F.lit(hi).cast("date"), W.partitionBy(*keys)
    reach = df.withColumn("_whole", (F.min("date").over(w) <= a) & (F.max("date").over(w) >= b))
    return reach.where(F.when(F.col("_whole"), F.col("date").between(a, b)).otherwise(F.raise_error(F.lit(f"a series doesn't cover {lo} to {hi}")))).drop("_whole")


def smoke_tail_length(horizon: int) -> int:
    return 120 + 4 * horizon


def unsorted_rows(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Rows whose date lies before that of the row before them by ``row_id``."""
    return df.withColumn("_d", F.lag("date").over(W.partitionBy(*keys).orderBy(row_id))).where("date < _d").drop("_d")
