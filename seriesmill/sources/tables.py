"""Readers and writers of the five source tables, and the same tables derived from a star schema."""

from __future__ import annotations

import logging
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

SCHEMAS = {
    "train": "id long, date date, store_nbr int, family string, sales double, onpromotion double",
    "stores": "store_nbr int, city string, state string, type string, cluster int",
    "oil": "date date, dcoilwtico double",
    "holidays": "date date, type string, locale string, locale_name string, description string, transferred boolean",
    "transactions": "date date, store_nbr int, transactions long",
}
REQUIRED = {t: [c.split()[0] for c in s.split(", ")] for t, s in SCHEMAS.items()}
FILES = {"train": "train.csv", "stores": "stores.csv", "oil": "oil.csv", "holidays": "holidays_events.csv", "transactions": "transactions.csv"}


def validate_schema(df: DataFrame, name: str) -> DataFrame:
    """``df`` if it has all columns that table ``name`` needs; more columns pass. No job runs."""
    missing = sorted(set(REQUIRED[name]) - set(df.columns))
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    return df


class TableLoader:
    """Source tables from a folder of CSV files, kept as Parquet in ``cache_dir`` once read."""

    def __init__(self, spark: SparkSession, data_dir: str, cache_dir: str | None = None):
        self.spark, self.data_dir, self.cache_dir = spark, data_dir.rstrip("/"), cache_dir and cache_dir.rstrip("/")
        if not self._exists(self.data_dir):
            raise FileNotFoundError(data_dir)

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def load(self, name: str) -> DataFrame:
        cached = self.cache_dir and f"{self.cache_dir}/{name}.parquet"
        if cached and self._exists(f"{cached}/_SUCCESS"):
            return validate_schema(self.spark.read.parquet(cached), name)
        path = f"{self.data_dir}/{FILES[name]}"
        if not self._exists(path):
            raise FileNotFoundError(path)
        header = self.spark.read.option("header", True).csv(path)
        validate_schema(header, name)
        kinds = dict(c.split() for c in SCHEMAS[name].split(", "))
        df = header.select(*[F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in header.columns])
        if name == "oil":
            log.info("oil prices missing: %s", "counted by missing_counts()")
        if cached:
            df.write.mode("overwrite").parquet(cached)
            df = self.spark.read.parquet(cached)
        return df

    def load_all(self) -> dict[str, DataFrame]:
        return {name: self.load(name) for name in SCHEMAS}


def write_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """Write source tables under the names that ``TableLoader`` reads, with a header."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{FILES[name]}")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, deleted with the session; a temporary one in local mode if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="seriesmill-")
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch folder and read back: later plans start there instead of computing it again."""
    folder = f"{scratch_folder(df.sparkSession, name)}/rows"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def setup_logging(level: str = "INFO", path: str | None = None) -> None:
    """Console log, and a rotating file where ``path`` is given."""
    from logging.handlers import RotatingFileHandler

    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(RotatingFileHandler(path, maxBytes=10_000_000, backupCount=5))
    logging.basicConfig(level=level, handlers=handlers, force=True)


def from_star_schema(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five tables from lineitem, orders, supplier, part, customer, nation and region.

    Every order stands for a holiday or event.
    """
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders", "supplier", "part", "customer", "nation", "region")}
    date = F.to_date("l_shipdate").alias("date")
    shipped = t["lineitem"].join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
    train = shipped.join(t["part"], F.col("l_partkey") == F.col("p_partkey")).groupBy(date, F.col("s_nationkey").alias("store_nbr"), F.col("p_type").alias("family")).agg(F.sum("l_quantity").alias("sales"), F.count_if(F.col("l_discount") >= 0.08).cast("double").alias("onpromotion"))
    stores = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("store_nbr"), F.col("n_name").alias("city"), F.col("r_name").alias("state"), F.char(F.lit(65) + F.col("n_nationkey") % 5).alias("type"), F.col("n_regionkey").alias("cluster")
    )
    day = F.to_date("o_orderdate").alias("date")
    oil = t["orders"].where(F.weekday("o_orderdate") < 5).groupBy(day).agg(F.expr("(sum(cast(round(o_totalprice * 100) as bigint)) div count(*)) / 100D").alias("dcoilwtico"))
    place = F.when(F.col("o_orderkey") % 3 == 0, "National").when(F.col("o_orderkey") % 3 == 1, "Regional").otherwise("Local")
    who = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    holidays = t["orders"].join(who, F.col("o_custkey") == F.col("c_custkey")).select(
        day, F.col("o_orderpriority").alias("type"), place.alias("locale"), F.when(place == "Regional", F.col("r_name")).when(place == "Local", F.col("n_name")).otherwise("World").alias("locale_name"),
        F.concat(F.lit("event "), F.col("o_orderkey").cast("string")).alias("description"), (F.col("o_orderstatus") == "P").alias("transferred"),
    )
    transactions = shipped.groupBy(date, F.col("s_nationkey").alias("store_nbr")).agg(F.count_distinct("l_orderkey").alias("transactions"))
    return {"train": train, "stores": stores, "oil": oil, "holidays": holidays, "transactions": transactions}
