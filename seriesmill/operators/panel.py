"""Cleaning, dimension joins, aggregation levels and completion of the daily panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import LEVEL_KEYS

HOLIDAY_COLUMNS = ["holiday_type", "locale", "locale_name", "description", "transferred"]


def clip_sales(df: DataFrame) -> DataFrame:
    return df.withColumn("sales", F.when(F.col("sales") < 0, 0.0).otherwise(F.col("sales")))


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n_rows, and null_<c> and negative_<c> for each column."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns], *[F.count_if(F.col(c) < 0).alias(f"negative_{c}") for c in columns])


def active_holidays(holidays: DataFrame, stores: DataFrame) -> DataFrame:
    """The deciding active event of each (date, store): national before regional before local, then by type and text.

    Events are reduced to the deciding one of each place first; only these fan out over stores, here on the two dimensions,
    and the fact table is joined once with one row a key.
    """
    h = holidays.withColumnRenamed("type", "holiday_type").where(~F.col("transferred").eqNullSafe(F.lit(True)) & F.col("holiday_type").isNotNull())
    event = F.min(F.struct("holiday_type", "description", "locale_name", "transferred")).alias("event")
    decided = h.groupBy("date", "locale", F.when(F.col("locale") == "National", "").otherwise(F.col("locale_name")).alias("place")).agg(event)
    # a shop answers to three names of places, so the join is one on equal keys
    named = F.array(*[F.struct(F.lit(kind).alias("locale"), place.alias("place")) for kind, place in (("National", F.lit("")), ("Regional", F.col("state")), ("Local", F.col("city")))])
    places = stores.select("store_nbr", F.explode(named).alias("x")).select("store_nbr", "x.*")
    rank = F.when(F.col("locale") == "National", 0).when(F.col("locale") == "Regional", 1).otherwise(2)
    first = decided.join(places, ["locale", "place"]).groupBy("date", "store_nbr").agg(F.min(F.struct(rank.alias("rank"), "event", "locale")).alias("x"))
    return first.select("date", "store_nbr", "x.event.*", "x.locale").select("date", "store_nbr", *HOLIDAY_COLUMNS)


def enrich(tables: dict[str, DataFrame]) -> DataFrame:
    """Sales with store, oil, holiday and transaction columns; one row for each sales row."""
    stores = tables["stores"]
    df = clip_sales(tables["train"]).withColumn("date", F.to_date("date"))
    # a stores table has one row a shop; left to the optimiser, which broadcasts it under its size threshold
    df = df.join(stores, "store_nbr", "left").join(tables["oil"], "date", "left")
    df = df.join(active_holidays(tables["holidays"], stores), ["date", "store_nbr"], "left")
    df = df.withColumn("is_localized_holiday", F.col("holiday_type").isNotNull().cast("int"))
    return df.join(tables["transactions"], ["date", "store_nbr"], "left")


def aggregate(df: DataFrame, level: str) -> DataFrame:
    """The panel at one level; ``store_family`` stays as it is."""
    if level not in LEVEL_KEYS:
        raise ValueError(f"unknown level {level!r}")
    if level == "store_family":
        return df
    keys = LEVEL_KEYS[level]
    known = df.where(" and ".join(f"{k} is not null" for k in ["date", *keys]))
    zero = F.lit(0.0)
    return known.groupBy("date", *keys).agg(F.coalesce(F.sum("sales"), zero).alias("sales"), F.coalesce(F.sum("onpromotion"), zero).alias("onpromotion"), F.coalesce(F.sum("transactions"), F.lit(0)).alias("transactions"), F.round(F.avg("dcoilwtico"), 4).alias("dcoilwtico"))


def aggregate_all(df: DataFrame) -> DataFrame:
    """All levels in one pass (grouping sets), with a ``level`` column; keys outside a level are null."""
    sets = [["date", *k] for k in LEVEL_KEYS.values()]
    cols = ["date", "store_nbr", "family"]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols])
    out = grouped.agg(F.sum("sales").alias("sales"), F.sum("onpromotion").alias("onpromotion"), F.grouping("store_nbr").alias("gs"), F.grouping("family").alias("gf"))
    level = F.when((F.col("gs") == 0) & (F.col("gf") == 0), "store_family").when(F.col("gf") == 0, "family").when(F.col("gs") == 0, "store").otherwise("total")
    return out.select(level.alias("level"), *cols, "sales", "onpromotion")


def fill_along(column: str, keys: list[str]):
    """Last known value, else the next known one, of a series by date."""
    w = W.partitionBy(*keys).orderBy("date")
    return F.coalesce(F.last(column, True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.first(column, True).over(w.rowsBetween(0, W.unboundedFollowing)))


def complete(df: DataFrame, level: str = "store_family", scope: str = "series", stores: DataFrame | None = None) -> DataFrame:
    """Insert missing days, zero-fill amounts, fill oil along each series and static columns from ``stores``.

    ``scope``: days from first to last of each series, or of the whole panel. The calendar is exploded from each key's
    own row (``sequence``), so no cross join is planned. Level ``total`` keeps its gaps.
    """
    keys = LEVEL_KEYS[level]
    if not keys:
        return df.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("sales", "onpromotion", "transactions") if c in df.columns}).withColumn("dcoilwtico", fill_along("dcoilwtico", []))
    span = df.groupBy(*keys).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    if scope == "panel":
        span = span.select(*keys, df.agg(F.min("date")).scalar().alias("lo"), df.agg(F.max("date")).scalar().alias("hi"))
    grid = span.where("lo is not null").select(*keys, F.explode(F.sequence("lo", "hi")).alias("date"))
    out = grid.join(df, [*keys, "date"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("sales", "onpromotion", "transactions") if c in df.columns})
    if "dcoilwtico" in df.columns:
        out = out.withColumn("dcoilwtico", fill_along("dcoilwtico", keys))
    static = [c for c in ("city", "state", "type", "cluster") if c in df.columns]
    if static and stores is not None and "store_nbr" in keys:
        out = out.drop(*static).join(stores.select("store_nbr", *static), "store_nbr", "left")
    elif static:
        w = W.partitionBy(*keys)
        out = out.withColumns({c: F.coalesce(F.col(c), F.max(c).over(w)) for c in static})
    if "is_localized_holiday" in df.columns:
        out = out.withColumn("is_localized_holiday", F.coalesce("is_localized_holiday", F.lit(0)))
    return out


def cast_types(df: DataFrame, float32: bool = False) -> DataFrame:
    """Panel types: int keys, double (or float) amounts; what can't be cast becomes null."""
    kinds = {"store_nbr": "int", "cluster": "int"} | dict.fromkeys(["sales", "onpromotion", "dcoilwtico", "transactions"], "float" if float32 else "double")
    return df.select(*[F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])


def preprocess(tables: dict[str, DataFrame], level: str = "store_family", scope: str = "series") -> DataFrame:
    return cast_types(complete(aggregate(enrich(tables), level), level, scope, tables["stores"]))


def recent_history(df: DataFrame, keys: list[str], days: int) -> DataFrame:
    """The last ``days`` days of each series."""
    return df.withColumn("_last", F.max("date").over(W.partitionBy(*keys))).where(F.col("date") >= F.date_sub("_last", days - 1)).drop("_last")


def history_until(df: DataFrame, cutoff) -> DataFrame:
    """Rows up to a date; an error if there is no such column or no such row."""
    if "date" not in df.columns:
        raise ValueError("no column date")
    out = df.where(F.col("date") <= F.lit(cutoff).cast("date"))
    if out.isEmpty():
        raise ValueError(f"no rows up to {cutoff}")
    return out


def holdout(df: DataFrame, horizon: int) -> DataFrame:
    """Rows of the panel's last ``horizon`` days."""
    return df.where(F.col("date") > df.agg(F.date_sub(F.max("date"), horizon)).scalar())


def training_history(df: DataFrame, horizon: int) -> DataFrame:
    """Rows before the panel's last ``horizon`` days; a panel without any is an error when the rows are read."""
    last, first = df.agg(F.date_sub(F.max("date"), horizon)).scalar(), df.agg(F.min("date")).scalar()
    return df.where(F.when(first <= last, F.col("date") <= last).otherwise(F.raise_error(F.lit(f"no rows before the last {horizon} days")).cast("boolean")))


def ordered(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows by date, or by ``keys`` (a shop, say) and date; ties by what is left of the series' keys. One range exchange."""
    rest = [k for k in ("store_nbr", "family") if k in df.columns and k not in (keys or [])]
    return df.orderBy(*(keys or []), "date", *rest)
