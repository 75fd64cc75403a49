"""ABC classes, routing and the quantile policy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


#: Rows of the sample that ranges of totals are cut by, and rows of it in each range.
SAMPLE, APART = 4096, 16


def running_totals(totals: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``totals`` (by, keys, total) with ``running``, the sum from the largest total down to the row's, and ``whole``; ties by key.

    A prefix sum in two levels, so no task sorts all series: ranges of the order are cut at a sample (the rows of least hash),
    each range is summed within its own task, and one sum a range is carried to the next ones.
    """
    place = F.struct(F.col("total").isNull().alias("n"), (-F.col("total")).alias("t"), *keys)
    sample = totals.select(place.alias("place")).orderBy(F.xxhash64("place"), "place").limit(SAMPLE)
    cuts = sample.agg(F.filter(F.sort_array(F.collect_list("place")), lambda _, i: i % APART == 0))
    ranged = totals.withColumn("_cuts", cuts.scalar()).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < place))).drop("_cuts")
    sums = ranged.groupBy(*by, "_range").agg(F.sum("total").alias("_sum"))
    # a few hundred ranges in each of ``by``
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    carried = sums.select(*by, "_range", before.alias("_before"), F.sum("_sum").over(W.partitionBy(*by)).alias("whole"))
    within = F.sum("total").over(W.partitionBy(*by, "_range").orderBy(F.desc("total"), *keys).rowsBetween(W.unboundedPreceding, 0))
    out = ranged.withColumn("_own", within).join(carried, [*by, "_range"])
    return out.withColumn("running", F.col("_before") + F.coalesce("_own", F.lit(0.0))).drop("_range", "_own", "_before")


def abc_classes(df: DataFrame, keys: list[str], target: str = "sales", by: list[str] | None = None) -> DataFrame:
    """(by, keys, total, cum_perc, abc_class): A up to 80 % of cumulative share, B up to 95 %, else C; ties go by key."""
    by = by or []
    totals = df.groupBy(*by, *keys).agg(F.sum(target).alias("total"))
    out = running_totals(totals, keys, by).withColumn("cum_perc", F.try_divide("running", "whole")).drop("running", "whole")
    return out.select(*by, *keys, "total", "cum_perc", F.when(F.col("cum_perc") <= 0.80, "A").when(F.col("cum_perc") <= 0.95, "B").otherwise("C").alias("abc_class"))


def series_catalog(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The series of several catalogs, each once; an error if there is none (one row is looked for)."""
    if not parts:
        raise ValueError("no catalog")
    out = reduce(DataFrame.unionByName, [p.select(*keys) for p in parts])
    if out.isEmpty():
        raise ValueError("no series in the catalog")
    return out.distinct()


def class_counts(classes: DataFrame) -> DataFrame:
    return classes.groupBy("abc_class").agg(F.count("*").alias("n_series"))


def route(classes: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """Each series with its class (unknown: C) and route: hybrid for A and B, direct for C."""
    out = series.join(classes.select(*keys, "abc_class"), keys, "left").withColumn("abc_class", F.coalesce("abc_class", F.lit("C")))
    return out.withColumn("route", F.when(F.col("abc_class") == "C", "direct").otherwise("hybrid"))


def direct_lags(horizon: int) -> list[int]:
    return [-horizon, -(horizon + 7), -(horizon + 14), -(horizon + 28)]


def quantile_policy(family: str | Column = "family", low: str = "PRODUCE", high: str = "GROCERY") -> Column:
    """0.40 for families that spoil, 0.75 for those that keep, else the median; the first match decides."""
    c = F.col(family) if isinstance(family, str) else family
    return F.when(F.contains(c, F.lit(low)), 0.40).when(F.contains(c, F.lit(high)), 0.75).otherwise(0.50)
