"""Streaming forms (extensions): idempotent re-ingest by key, silence that closes a session, running reigns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "key string, holder string, start timestamp, previous string"


def deduplicated(stream: DataFrame, keys: list[str], when: str, delay: str) -> DataFrame:
    """Events once by business key, within the watermark."""
    return stream.withWatermark(when, delay).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, key: str, when: str, gap: str, delay: str) -> DataFrame:
    """key, start, end, n: runs without a silence of ``gap``."""
    w = stream.withWatermark(when, delay).groupBy(F.session_window(when, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return w.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def holder_changes(stream: DataFrame, key: str, holder: str, when: str) -> DataFrame:
    """A row whenever the holder of a key changes (in event-time order within a batch); state is the last holder."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("when", kind="stable")
        out = []
        for h, t in zip(rows["holder"], rows["when"], strict=True):
            if h != last:
                out.append((str(k[0]), h, t, last))
                last = h
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "holder", "start", "previous"])

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(holder).alias("holder"), F.col(when).cast("timestamp").alias("when"))
    return rows.groupBy("key").applyInPandasWithState(run, CHANGES, "holder string", "append", GroupStateTimeout.NoTimeout)
