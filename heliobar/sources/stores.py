"""Snapshots, ledgers, news and macro series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = "snapshot_date date, symbol string, name string, asset_class string, exchange string, status string, tradable boolean, marginable boolean, shortable boolean, easy_to_borrow boolean, fractionable boolean, min_order_size double, min_trade_increment double, price_increment double"
TRIAL = "variant_id string, created_at string, sharpe double, n_observations long, genome_hash string, note string, kept boolean, kind string"


def write_snapshot(df: DataFrame, path: str) -> None:
    """One partition for each date; the same date again replaces it. An empty snapshot is refused."""
    if not df.limit(1).count():
        raise ValueError("an empty snapshot is not stored")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).parquet(path)


def snapshot_asof(snapshots: DataFrame, day) -> DataFrame:
    """The latest snapshot at or before ``day``; none raises an error, later ones are never looked at."""
    found = snapshots.where(F.col("snapshot_date") <= F.lit(day)).agg(F.max("snapshot_date")).first()[0]
    if found is None:
        raise LookupError(f"no snapshot at or before {day}")
    return snapshots.where(F.col("snapshot_date") == F.lit(found))


def append_trials(trials: DataFrame, path: str) -> None:
    trials.write.mode("append").json(path)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """The ledger; torn or invalid lines are skipped."""
    return spark.read.schema(TRIAL).option("mode", "DROPMALFORMED").json(path).where("variant_id IS NOT NULL")


def read_json_universe(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("date date, symbol string, price double, dollar_volume double, shortable boolean, easy_to_borrow boolean, fractionable boolean").json(path)


def news_rows(articles: DataFrame) -> DataFrame:
    """A row for each article and ticker; without tickers the symbol is ``*``."""
    tickers = F.when(F.size(F.coalesce("symbols", F.array().cast("array<string>"))) == 0, F.array(F.lit("*"))).otherwise(F.col("symbols"))
    return articles.withColumn("symbol", F.explode(tickers)).select("id", "created_at", "symbol", "headline", "source")


def macro_values(raw: DataFrame) -> DataFrame:
    """(series_id, date, value) with unparsable values left out."""
    return raw.select("series_id", F.col("date").cast("date").alias("date"), F.expr("try_cast(value AS double)").alias("value")).where("value IS NOT NULL")


def auth_signature(token: Column, stamp: Column) -> Column:
    return F.sha2(F.concat_ws(":", token, stamp.cast("string")), 256)


SELECTED = "symbol string, price double, dollar_volume double, shortable boolean, easy_to_borrow boolean, fractionable boolean"


class SelectedUniverse:
    """The symbols selected on each day, as JSON; the same day again replaces them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _stored(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], f"{SELECTED}, day date")
        return self.spark.read.schema(f"{SELECTED}, day date").json(self.root)

    def save(self, selected: DataFrame, day) -> None:
        cols = [F.col(c.split()[0]) for c in SELECTED.split(", ")]
        rows = selected.select(*cols, F.lit(day).cast("date").alias("day"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").json(self.root)

    def dates(self) -> list:
        return sorted(r["day"] for r in self._stored().select("day").distinct().collect())  # a row a day

    def load(self, day) -> DataFrame:
        return self._stored().where(F.col("day") == F.lit(day)).drop("day")

    def asof(self, day) -> DataFrame:
        """The selection of ``day`` or the last one before it; a later one is never looked at."""
        found = [d for d in self.dates() if d <= day]
        if not found:
            raise LookupError(f"nothing was selected by {day}")
        return self.load(found[-1])

    def latest(self) -> DataFrame:
        found = self.dates()
        if not found:
            raise LookupError("nothing has been selected")
        return self.load(found[-1])
