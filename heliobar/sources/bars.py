"""OHLCV bars: schema, derivation from event tables, and the lake with its idempotent upsert."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..staging import drop_stage, stage

BAR = T.StructType([
    T.StructField("ts", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")),
    T.StructField("trade_count", T.LongType()), T.StructField("vwap", T.DoubleType()),
])
REQUIRED = ("ts", "open", "high", "low", "close", "volume")
TIMEFRAMES = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "1d": 86400}


def check_symbol(symbol: str) -> str:
    """A symbol of up to 32 ASCII letters, digits and ``._-``, in parts that can each be the name of a folder."""
    usable = 0 < len(symbol) <= 32
    for part in symbol.split("/"):
        usable = usable and part[:1].isalnum() and all(piece for piece in part.split("."))
        usable = usable and part.isascii() and part.translate({ord(c): None for c in "._-"}).isalnum()
    if not usable:
        raise ValueError(f"unusable symbol {symbol!r}")
    return symbol


def conform(df: DataFrame) -> DataFrame:
    """Required columns checked, optional ones added as typed nulls, others dropped; ts without zone is UTC."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"bars lack {missing}")
    out = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in BAR]
    return df.select(*[c for c in ("symbol",) if c in df.columns], *out)


def bucket(ts, seconds: int):
    """Start of the epoch-aligned bucket."""
    s = F.unix_seconds(ts.cast("timestamp"))
    return F.timestamp_seconds(s - F.pmod(s, F.lit(seconds)))


def from_ticks(ticks: DataFrame, seconds: int, order: list[str], symbol: str = "symbol", ts: str = "ts", price: str = "price", volume: str = "volume") -> DataFrame:
    """Bars of ticks; ``order`` breaks ties of time, so that open and close are determined."""
    at = F.struct(ts, *order)
    return ticks.groupBy(F.col(symbol).alias("symbol"), bucket(F.col(ts), seconds).alias("bar_ts")).agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(volume).alias("volume"), F.count("*").alias("trade_count")).withColumnRenamed("bar_ts", "ts")


def event_bars(spark: SparkSession, sf_dir: str, seconds: int = 3600) -> DataFrame:
    """Bars of event values by event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"))
    return from_ticks(events, seconds, ["event_id"], volume="price")


def line_bars(spark: SparkSession, sf_dir: str, seconds: int = 86400, symbol: str = "p_type") -> DataFrame:
    """Bars of unit prices by a column of part, day or week of shipping."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col(symbol).alias("symbol"))
    ticks = line.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    return from_ticks(ticks, seconds, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], ts="l_shipdate", volume="l_quantity")


def keep_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Of rows with equal keys the one that came last."""
    w = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


class BarLake:
    """Parquet bars by asset, timeframe, symbol and year; a later write of a bar wins."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, asset: str, timeframe: str) -> str:
        if timeframe not in TIMEFRAMES:
            raise ValueError(f"unknown timeframe {timeframe!r}")
        return f"{self.root}/bars/{asset}/{timeframe}"

    def stored(self, asset: str, timeframe: str) -> DataFrame:
        """All bars of an asset and timeframe, with the columns symbol and year."""
        return self._stored(asset, timeframe)

    def _stored(self, asset: str, timeframe: str) -> DataFrame:
        schema = T.StructType([*BAR.fields, T.StructField("symbol", T.StringType()), T.StructField("year", T.IntegerType())])
        path = self.path(asset, timeframe)
        if not self._partitions(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def write(self, bars: DataFrame, timeframe: str, asset: str = "equity") -> int:
        """Upsert by (symbol, ts); only the partitions of the new bars are read and replaced. Returns the rows given.

        Merged partitions are written aside first. Each then takes the place of the old one, which is kept until it
        has; what a broken run left is put back or dropped by the next.
        """
        path = self.path(asset, timeframe)
        self._settle(path)
        fresh = stage(conform(bars).withColumns({"year": F.year("ts"), "_seq": F.lit(1)}), "bars-fresh")
        n = fresh.count()
        if not n:
            return 0
        touched = fresh.select("symbol", "year").distinct()
        stored = self._stored(asset, timeframe).join(touched, ["symbol", "year"], "left_semi").withColumn("_seq", F.lit(0))
        merged = keep_last(stored.unionByName(fresh), ["symbol", "ts"], "_seq").drop("_seq")
        aside = f"{path}/_new-{uuid.uuid4().hex}"
        merged.repartition("symbol", "year").sortWithinPartitions("symbol", "year", "ts").write.option("compression", "zstd").partitionBy("symbol", "year").parquet(aside)
        self._swap(path, aside)
        drop_stage(fresh)
        return n

    def _files(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _partitions(self, folder: str) -> list[str]:
        """symbol=.../year=... below a folder."""
        fs, path = self._files(folder)
        if not fs.exists(path(folder)):
            return []
        symbols = [s.getPath() for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("symbol=")]
        return [f"{s.getName()}/{y.getPath().getName()}" for s in symbols for y in fs.listStatus(s) if y.getPath().getName().startswith("year=")]

    def _swap(self, path: str, aside: str) -> None:
        fs, p = self._files(path)
        old = aside.replace("/_new-", "/_old-")
        for part in self._partitions(aside):
            if fs.exists(p(f"{path}/{part}")):
                fs.mkdirs(p(f"{old}/{part}").getParent())
                fs.rename(p(f"{path}/{part}"), p(f"{old}/{part}"))
            fs.mkdirs(p(f"{path}/{part}").getParent())
            fs.rename(p(f"{aside}/{part}"), p(f"{path}/{part}"))
        for folder in (aside, old):
            fs.delete(p(folder), True)

    def _settle(self, path: str) -> None:
        """Puts partitions back that a broken swap took away, and drops what it had written."""
        fs, p = self._files(path)
        if not fs.exists(p(path)):
            return
        for status in fs.listStatus(p(path)):
            name = status.getPath().getName()
            if name.startswith("_old-"):
                for part in self._partitions(f"{path}/{name}"):
                    if not fs.exists(p(f"{path}/{part}")):
                        fs.rename(p(f"{path}/{name}/{part}"), p(f"{path}/{part}"))
            if name.startswith(("_old-", "_new-")):
                fs.delete(status.getPath(), True)

    def read(self, symbols: list[str], timeframe: str, start: datetime | None = None, end: datetime | None = None, asset: str = "equity") -> DataFrame:
        """Bars with start <= ts <= end by (symbol, ts); the years prune partitions."""
        out = self._stored(asset, timeframe).where(F.col("symbol").isin([check_symbol(s) for s in symbols]))
        if start is not None:
            out = out.where((F.col("ts") >= F.lit(start)) & (F.col("year") >= (start - timedelta(days=1)).year))
        if end is not None:
            out = out.where((F.col("ts") <= F.lit(end)) & (F.col("year") <= (end + timedelta(days=1)).year))
        return out.select("symbol", *BAR.names).orderBy("symbol", "ts")

    def row_count(self, symbol: str, timeframe: str, asset: str = "equity") -> int:
        return self._stored(asset, timeframe).where(F.col("symbol") == symbol).count()

    def coverage(self, timeframe: str, asset: str = "equity") -> DataFrame:
        return coverage(self._stored(asset, timeframe))

    def symbols(self, timeframe: str, asset: str = "equity") -> list[str]:
        """From the names of partitions; no file is read."""
        names = {part.split("/")[0].removeprefix("symbol=") for part in self._partitions(self.path(asset, timeframe))}
        return sorted(unquote(n) for n in names)


def coverage(bars: DataFrame) -> DataFrame:
    """Rows, first and last time of each symbol."""
    return bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def with_min_bars(bars: DataFrame, n: int, excluded: list[str] | None = None) -> DataFrame:
    """Bars of symbols that have ``n`` or more; ``excluded`` bases go."""
    counts = bars.groupBy("symbol").agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select("symbol")
    out = bars.join(counts, "symbol", "left_semi")
    return out.where(~F.split("symbol", "/")[0].isin(excluded)) if excluded else out
