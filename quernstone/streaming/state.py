"""Structured Streaming forms of the keyed state: rates, sessions, a cache with time to live, and index upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quernstone.operators.index import ChunkIndex


def request_rates(stream: DataFrame, by: str, at: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def sessions(stream: DataFrame, by: str, at: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_deliveries(stream: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def ttl_cache(stream: DataFrame, key: str, data: str, at: str, seconds: int = 86_400, late: str = "10 minutes") -> DataFrame:
    """(key, data, expires_at) whenever a key's newest entry changes; state leaves when its time is up."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else (None, -1)
        for pdf in batches:
            new = pdf.sort_values(at).iloc[-1]
            ms = int(pd.Timestamp(new[at]).timestamp() * 1000)
            if ms > held[1]:
                held = (new[data], ms)
        state.update(held)
        state.setTimeoutTimestamp(max(held[1] + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [k[0]], "data": [held[0]], "expires_at": [pd.Timestamp(held[1] + seconds * 1000, unit="ms")]})

    return stream.withWatermark(at, late).groupBy(key).applyInPandasWithState(update, "key string, data string, expires_at timestamp", "data string, at long", "update", GroupStateTimeout.EventTimeTimeout)


def upsert_batches(index: ChunkIndex):
    """For ``foreachBatch``: a replayed batch is all skips, so it changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        index.upsert(batch)

    return run
