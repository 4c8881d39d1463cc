"""Streaming forms of the dated tables: windows with late data, one row a key, latest evidence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, ts: str, keys: list[str], value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Tumbling counts and sums; rows later than the watermark are dropped by Spark."""
    w = F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def unique(events: DataFrame, ts: str, keys: list[str], late: str = "2 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def latest(events: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """Stateful latest-wins: emits (key, version, value) whenever a key's evidence gets newer; of ties the larger value."""
    kinds = dict(events.dtypes)
    schema = f"{key} {kinds[key]}, {version} {kinds[version]}, {value} {kinds[value]}"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        changed = False
        for f in frames:
            top = f.sort_values([version, value]).iloc[-1]
            now = (top[version].item(), top[value].item() if hasattr(top[value], "item") else top[value])
            if best is None or now > tuple(best):
                best, changed = now, True
        if changed:
            state.update(best)
            yield pd.DataFrame([{key: k[0], version: best[0], value: best[1]}])

    return events.groupBy(key).applyInPandasWithState(step, schema, f"{version} {kinds[version]}, {value} {kinds[value]}", "update", GroupStateTimeout.NoTimeout)
