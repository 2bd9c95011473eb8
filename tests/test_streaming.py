from datetime import datetime, timedelta

from pyspark.sql import functions as F

from heliobar.sources.bars import BarLake
from heliobar.streaming.bars import retried, stream_trailing_stop, upsert_stream

T0 = datetime(2025, 1, 1)


def run(writer, folder):
    q = writer.option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    q.awaitTermination()


def test_stops_follow_time_within_and_across_batches(spark, tmp_path):
    """One file a batch; rows stand in disorder inside it, and one comes late with the second."""
    closes = [10.0, 14.0, 9.0, 15.0, 12.0, 11.0]
    marks = lambda picks, short: [(f"p{short}", T0 + timedelta(hours=i), closes[i], 1.0, bool(short)) for i in picks]
    schema = "position_id string, ts timestamp, close double, atr double, is_short boolean"
    for k, picks in enumerate(([3, 0, 1], [5, 2, 4])):
        spark.createDataFrame([x for s in (0, 1) for x in marks(picks, s)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(stream_trailing_stop(stream, 2.0).writeStream.format("memory").queryName("stops").outputMode("append"), tmp_path / "cp")
    got = {(r["position_id"], r["ts"].hour): r for r in spark.table("stops").collect()}
    high, low = {0: 10.0, 1: 14.0, 3: 15.0, 2: 15.0, 4: 15.0, 5: 15.0}, {0: 10.0, 1: 10.0, 3: 10.0, 2: 10.0, 4: 10.0, 5: 10.0}
    for i in range(6):
        assert (got["p0", i]["mark"], got["p0", i]["stop_price"], got["p0", i]["triggered"]) == (high[i], high[i] - 2, closes[i] <= high[i] - 2)
        assert (got["p1", i]["mark"], got["p1", i]["triggered"]) == (low[i], closes[i] >= low[i] + 2)


def test_batches_are_upserted_once(spark, tmp_path):
    rows = [("A", T0 + timedelta(hours=i), 1.0, 2.0, 0.5, 1.0 + i, 3.0) for i in range(6)]
    schema = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
    for part in (rows[:4], [("A", rows[3][1], 1.0, 2.0, 0.5, 99.0, 3.0), *rows[4:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    lake = BarLake(spark, str(tmp_path / "lake"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for folder in ("cp", "again"):  # a second run from the start replays both batches
        upsert_stream(stream, lake, "1h", "crypto", str(tmp_path / folder)).awaitTermination()
        assert [r["close"] for r in lake.read(["A"], "1h", asset="crypto").select("close").collect()] == [1.0, 2.0, 3.0, 99.0, 5.0, 6.0]
    assert lake.stored("crypto", "1h").where(F.col("close") == 99.0).count() == 1


def test_cycles_are_retried():
    tries = []

    def cycle():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("down")

    assert retried(cycle, 3, 0.0) and len(tries) == 3
    assert not retried(lambda: 1 / 0, 2, 0.0)
