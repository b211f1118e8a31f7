"""Streams: calendar blocks with late data, and a level filter that keeps state a channel."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_extremes(stream: DataFrame, length: str = "1 day", late: str = "2 days", ts: str = "ts", y: str = "value", channel: str = "event_type") -> DataFrame:
    """(channel, start, end, n, mean, largest, smallest) of tumbling blocks; a block is final once the watermark passes it."""
    x = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    g = x.groupBy(F.window("_ts", length).alias("w"), F.col(channel).alias("channel")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.max(y).alias("largest"), F.min(y).alias("smallest"))
    return g.select("channel", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "largest", "smallest")


def level_filter(stream: DataFrame, q: float, r: float, mean: float = 0.0, variance: float = 1e4) -> DataFrame:
    """(channel, t, y, level, level_variance) of (channel, t, y): a local-level filter that carries each channel's
    level, variance and last time between batches.  Rows up to the last time seen are late and dropped."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m, c, last = state.get if state.exists else (mean, variance, -1)
        out = []
        for t, y in sorted(set(pd.concat(list(frames))[["t", "y"]].itertuples(index=False, name=None))):
            if t <= last:
                continue
            p = c + q
            k = p / (p + r)
            m, c, last = m + k * (y - m), p * (1 - k), int(t)
            out.append((key[0], last, float(y), m, c))
        state.update((float(m), float(c), int(last)))
        yield pd.DataFrame(out, columns=["channel", "t", "y", "level", "level_variance"])

    return stream.select("channel", "t", "y").groupBy("channel").applyInPandasWithState(
        update, "channel string, t int, y double, level double, level_variance double", "m double, c double, last int", "append", GroupStateTimeout.NoTimeout
    )
