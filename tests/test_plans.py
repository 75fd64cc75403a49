"""What registered queries read, and how their work is dealt out."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from seriesmill.operators import backtest, forecast
from seriesmill.plans import registry

TABLES = "/root/testdata/sf0.001"


def test_backtest_reads_the_tables_once(spark, monkeypatch):
    """the baselines' and models' steps start from kept rows, not from the source tables again."""
    monkeypatch.setattr(backtest, "learned_forecasts", lambda sliced, keys, *_: backtest.flat_forecasts(sliced, keys))
    files = registry._backtested(spark, TABLES).inputFiles()
    assert files and not [f for f in files if TABLES in f]


def test_fits_are_not_merged_by_size(spark):
    """twelve small series are fitted in more than one task."""
    rows = spark.range(12).select(F.col("id").alias("family"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("i"))
    s = rows.select("family", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")).alias("date"), F.rand(1).alias("sales"), F.when(F.col("i") < 25, "train").otherwise("val").alias("split"), F.lit(0).alias("window"))
    made = forecast.exponential_smoothing(s, ["family"], weights=(0.2, 0.1, 0.1)).withColumn("task", F.spark_partition_id())
    assert made.select("task").distinct().count() > 6 and made.count() == 60


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{TABLES}/orders.parquet")


def _national(orders):
    """Days with an event that is active in all 25 shops."""
    return {r.d for r in orders.where("o_orderkey % 3 = 0 and o_orderstatus <> 'P'").select(F.to_date("o_orderdate").alias("d")).distinct().collect()}


def test_every_order_is_an_event(spark, orders):
    """no order is left out of the holidays."""
    got = registry.QUERIES["holidays_dim"](spark, TABLES).collect()
    assert {r.description for r in got} == {f"event {r.o_orderkey}" for r in orders.collect()} and len(got) == orders.count()


def test_every_event_is_localised(spark, orders):
    """each day of a national event is one in all shops, by the first type and text."""
    got = [r for r in registry.QUERIES["localized_holidays"](spark, TABLES).collect() if r.locale == "National"]
    assert Counter(r.date for r in got) == dict.fromkeys(_national(orders), 25)
    least = {}
    for r in orders.where("o_orderkey % 3 = 0 and o_orderstatus <> 'P'").collect():
        x = (r.o_orderpriority, f"event {r.o_orderkey}")
        least[r.o_orderdate.date()] = min(x, least.get(r.o_orderdate.date(), x))
    assert all((r.holiday_type, r.description) == least[r.date] for r in got)


def test_sales_meet_every_event(spark, orders):
    """sales on the day of a national event have one, whatever its price."""
    days = _national(orders)
    got = registry.QUERIES["enriched_sales"](spark, TABLES).where(F.col("date").isin(*days)).collect()
    assert got and all(r.is_localized_holiday == 1 and r.locale == "National" for r in got)


def test_static_rows_hold_every_event(spark, orders):
    """the completed panel's days of sales are marked by every event."""
    days = _national(orders)
    got = registry.QUERIES["static_filled"](spark, TABLES).where("sales > 0").where(F.col("date").isin(*days)).collect()
    assert got and all(r.is_localized_holiday == 1 for r in got)


def test_static_flags_follow_all_orders(spark, orders):
    """the panel and its SQL mark the days of sales with an active event of any order in the shop's place, and no others."""
    duckdb = pytest.importorskip("duckdb")
    read = {n: spark.read.parquet(f"{TABLES}/{n}.parquet").collect() for n in ("region", "nation", "customer", "supplier", "part", "lineitem")}
    regions = {r.r_regionkey: r.r_name for r in read["region"]}
    places = {r.n_nationkey: ("World", regions[r.n_regionkey], r.n_name) for r in read["nation"]}
    home = {r.c_custkey: places[r.c_nationkey] for r in read["customer"]}
    events = {(r.o_orderdate.date(), r.o_orderkey % 3, home[r.o_custkey][r.o_orderkey % 3]) for r in orders.collect() if r.o_orderstatus != "P"}
    shop, family = {r.s_suppkey: r.s_nationkey for r in read["supplier"]}, {r.p_partkey: r.p_type for r in read["part"]}
    sold = {(r.l_shipdate.date(), shop[r.l_suppkey], family[r.l_partkey]) for r in read["lineitem"]}
    marked = sorted(x for x in sold if any((x[0], kind, name) in events for kind, name in enumerate(places[x[1]])))
    got = registry.QUERIES["static_filled"](spark, TABLES).where("is_localized_holiday = 1").select("date", "store_nbr", "family").collect()
    con = duckdb.connect()
    for n in (*read, "orders"):
        con.execute(f"CREATE VIEW {n} AS FROM '{TABLES}/{n}.parquet'")
    sql = con.execute(f"SELECT date, store_nbr, family FROM ({registry.ORACLES['static_filled']}) WHERE is_localized_holiday = 1").fetchall()
    assert marked and sorted(map(tuple, got)) == sorted(sql) == marked


def test_loaded_holidays_are_whole(spark, orders):
    """as many holidays are written and read as there are orders."""
    got = {r.name: (r.n_rows, r.amount) for r in registry.QUERIES["loaded_tables"](spark, TABLES).collect()}
    assert got["holidays"] == (orders.count(), orders.where("o_orderstatus = 'P'").count())
