"""Key frames and sightings as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def spaced_stream(events: DataFrame, key: str, time: str, gap: float, watermark: str = "10 minutes") -> DataFrame:
    """(key, t) of events kept because they come ``gap`` or more seconds after the last kept one of their key.

    The state is one number a key and goes when the watermark has passed it. Within a micro-batch events are put in order of time; an
    event older than the last kept one is dropped, as a batch run would have placed it earlier.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        kept = []
        for t in sorted(x for f in frames for x in f["t"]):
            if last is None or t - last >= gap:
                kept.append(t)
                last = t
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + 10 * gap) * 1000), state.getCurrentWatermarkMs() + 1))
        if kept:
            yield pd.DataFrame({key: [k[0]] * len(kept), "t": kept})

    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark(time, watermark).select(key, time, (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("t"))
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, t double", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def newest_stream(listing: DataFrame, path: str, checkpoint: str):
    """A stream of sightings written, newest per path of each micro-batch, as one folder a batch; a batch that is run again replaces its
    own folder, so each sighting is written once."""
    from quarry.operators.catalogue import newest_sightings

    def write(batch: DataFrame, number: int) -> None:
        newest_sightings(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return listing.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
