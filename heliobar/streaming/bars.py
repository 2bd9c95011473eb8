"""Structured Streaming: bars from ticks, upsert of each batch, trailing stops with keyed state."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship
from ..sources.bars import BarLake


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Bars of a stream of (symbol, ts, tick_id, price, volume); ticks later than ``late`` behind are left out."""
    at = F.struct("ts", "tick_id")
    out = ticks.withWatermark("ts", late).groupBy(F.window("ts", width).alias("_w"), "symbol").agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("trade_count"))
    return out.select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume", "trade_count")


def upsert_stream(bars: DataFrame, lake: BarLake, timeframe: str, asset: str, checkpoint: str, available_now: bool = True):
    """Writes every batch into the lake; a batch that is replayed replaces the same bars."""
    writer = bars.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: lake.write(df, timeframe, asset) and None)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


_STOP = "position_id string, ts timestamp, close double, mark double, stop_price double, triggered boolean"


def stream_trailing_stop(marks: DataFrame, multiple: float = 3.0) -> DataFrame:
    """Stops of a stream of (position_id, ts, close, atr, is_short).

    The water mark and the time it stands at are the key's state. All rows of a key in a batch are put in order of
    time first; a row older than the state is judged by the mark as it stands and doesn't move it.
    """
    ship(marks.sparkSession)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        when, close = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy(), rows["close"].to_numpy()
        short = bool(rows["is_short"].iloc[0])
        sign = -1.0 if short else 1.0
        mark, last = state.get if state.exists else (None, None)
        late = when < last if last is not None else np.zeros(len(rows), bool)
        seen = np.where(late, -np.inf, sign * close)
        if mark is not None:
            seen = np.concatenate([[sign * mark], seen])
        high = sign * np.maximum.accumulate(seen)[-len(rows) :]
        stop = high - sign * multiple * rows["atr"].to_numpy()
        state.update((float(high[-1]), int(max(when.max(), last or when.max()))))
        yield pd.DataFrame({"position_id": key[0], "ts": rows["ts"], "close": close, "mark": high, "stop_price": stop, "triggered": sign * close <= sign * stop})

    return marks.groupBy("position_id").applyInPandasWithState(step, _STOP, "mark double, last long", "append", GroupStateTimeout.NoTimeout)


def retried(cycle, attempts: int = 3, wait_seconds: float = 1.0) -> bool:
    """Runs ``cycle`` until it succeeds, waiting longer after each failure; whether it did."""
    for k in range(attempts):
        try:
            cycle()
            return True
        except Exception:  # noqa: BLE001  a cycle may fail in any way; the next one starts afresh
            if k + 1 < attempts:
                time.sleep(wait_seconds * 2**k)
    return False
