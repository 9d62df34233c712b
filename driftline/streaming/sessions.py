"""Gap sessions over a stream of reports, an extension beyond the batch operators.

State per aircraft is one open segment.  A report that lies ``gap_s`` or more
behind the last one closes the segment; so does the watermark.  The batch rule
(split at a gap of exactly ``gap_s``) holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "icao24 string, start_time long, end_time long, point_count long"
STATE = "start_time long, end_time long, point_count long"


def closed_segments(states: DataFrame, gap_s: int = 1200, lateness: str = "10 minutes") -> DataFrame:
    """Closed segments of a streaming DataFrame with icao24 and time (epoch seconds).  Reports later
    than ``lateness`` are dropped by the watermark, as event-time processing has it."""
    timed = states.filter("icao24 is not null and time is not null").withColumn("ts", F.timestamp_seconds("time")).withWatermark("ts", lateness)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield pd.DataFrame([(key[0], *state.get)], columns=["icao24", "start_time", "end_time", "point_count"])
            state.remove()
            return
        times = sorted(t for b in batches for t in b["time"].tolist())
        start, end, n = state.get if state.exists else (times[0], times[0], 0)
        out = []
        for t in times:
            if t - end >= gap_s:
                out.append((key[0], start, end, n))
                start, n = t, 0
            start, end, n = min(start, t), max(end, t), n + 1
        state.update((start, end, n))
        state.setTimeoutTimestamp(max((end + gap_s) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["icao24", "start_time", "end_time", "point_count"])

    return timed.select("icao24", "time", "ts").groupBy("icao24").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
