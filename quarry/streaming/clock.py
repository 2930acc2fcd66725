"""Bursts by the clock: what waits is sent when nothing has followed for a while, without a later event.

State of a stream with processing-time timers. A burst's events may come in several micro-batches; each one sets the timer
anew, and a timer that runs out sends what is held and drops the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from quarry.streaming import events as batch


def debounce(events: DataFrame, gap_ms: int = 3_000) -> DataFrame:
    """One row for each burst of a key's events: key, first, last, n. `events`: key, ts. Events of one micro-batch that lie
    further apart than the gap are bursts of their own."""
    if not events.isStreaming:
        return batch.debounce(events, f"{gap_ms} milliseconds")
    kind = events.schema["key"].dataType.simpleString()
    gap = pd.Timedelta(milliseconds=gap_ms)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = [pd.Timestamp(state.get[0]), pd.Timestamp(state.get[1]), state.get[2]] if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append((key[0], *now))
            state.remove()
        else:
            for ts in pd.concat(list(frames))["ts"].sort_values():
                if now is not None and ts - now[1] < gap:
                    now = [min(now[0], ts), max(now[1], ts), now[2] + 1]
                else:
                    out += [(key[0], *now)] if now is not None else []
                    now = [ts, ts, 1]
            state.update((now[0].to_pydatetime(), now[1].to_pydatetime(), now[2]))
            state.setTimeoutDuration(gap_ms)
        yield pd.DataFrame(out, columns=["key", "first", "last", "n"])

    schema = f"key {kind}, first timestamp, last timestamp, n long"
    return events.groupBy("key").applyInPandasWithState(run, schema, "first timestamp, last timestamp, n long", "append", "ProcessingTimeTimeout")


def throttle(events: DataFrame, ms: int = 500) -> DataFrame:
    """key, event_id and final. `events`: key, ts, event_id. The first event of each stretch of `ms` is sent at once (final is
    false); when no event has followed for `ms`, the last of all is sent as the final one."""
    if not events.isStreaming:
        return batch.throttle(events, ms)
    kinds = {c: events.schema[c].dataType.simpleString() for c in ("key", "event_id")}

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        slot, last = state.get if state.exists else (None, None)
        out = []
        if state.hasTimedOut:
            out.append((key[0], last, True))
            state.remove()
        else:
            for ts, event in pd.concat(list(frames)).sort_values(["ts", "event_id"])[["ts", "event_id"]].itertuples(index=False, name=None):
                now = int(ts.value // 1_000_000 // ms)
                if slot is None or now > slot:
                    out.append((key[0], event, False))
                    slot = now
                last = event
            state.update((slot, last))
            state.setTimeoutDuration(ms)
        yield pd.DataFrame(out, columns=["key", "event_id", "final"])

    schema = f"key {kinds['key']}, event_id {kinds['event_id']}, final boolean"
    return events.groupBy("key").applyInPandasWithState(run, schema, f"slot long, last {kinds['event_id']}", "append", "ProcessingTimeTimeout")
