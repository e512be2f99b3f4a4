"""Score arriving events with a fitted next-event model; each session keeps its last events as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "seen bigint, last array<string>"
OUTPUT = "session_id string, pos bigint, context array<string>, next string"
IDLE_STATE = f"{STATE}, episode bigint, at bigint"
IDLE_OUTPUT = f"{OUTPUT}, episode bigint"


def _windows(session: str, before: int, last: list, arrived: list, h: int) -> dict:
    """The windows that end with an arrived event, after ``before`` events of which ``last`` are known."""
    line = last + arrived
    at = range(max(h, len(last)), len(line))
    return {
        "session_id": [session] * len(at),
        "pos": [before - len(last) + i - h for i in at],
        "context": [line[i - h : i] for i in at],
        "next": [line[i] for i in at],
    }


def stream_windows(
    rows: DataFrame, h: int, idle_minutes: int | None = None, time: str = "ts", lateness: str = "1 hour"
) -> DataFrame:
    """``session_id, pos, context, next`` for every event with ``h`` earlier ones in its session.

    ``rows``: streaming ``session_id, line_no, event``; within a session later batches must
    hold later lines.

    With ``idle_minutes`` the rows need an event time. A session that is silent for that long ends:
    its next event opens a new *episode*, named after the number of its first line, with positions from 0.
    The result has the column ``episode``. Once the watermark (the latest event time less
    ``lateness``) has passed the end of the silence, the state of the session is dropped, so state is
    bounded by the sessions that are alive. Which batch an event comes with makes no difference; rows
    behind the watermark are dropped, rows without an event time belong to the episode before them.
    """

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        arrived = pd.concat(list(frames)).sort_values("line_no")["event"].tolist()
        state.update((seen + len(arrived), (last + arrived)[-h:]))
        yield pd.DataFrame(_windows(key[0], seen, last, arrived, h))

    if idle_minutes is None:
        return rows.groupBy("session_id").applyInPandasWithState(
            advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout
        )
    idle = idle_minutes * 60_000

    def alive(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, last, episode, before = (state.get[0], list(state.get[1]), *state.get[2:]) if state.exists else (0, [], None, None)
        arrived = pd.concat(list(frames)).sort_values("line_no")
        events, lines = arrived["event"].tolist(), arrived["line_no"].tolist()
        # An event without a time counts as simultaneous with the one before it.
        times = pd.Series([np.nan if t is pd.NaT else t.timestamp() * 1000 for t in arrived[time]]).ffill()
        times = times.fillna(before if before is not None else times.min()).tolist()
        if times[0] != times[0]:
            times = [float(state.getCurrentWatermarkMs())] * len(times)
        start = 0
        for i in range(len(events)):
            previous = times[i - 1] if i else before
            if previous is None or times[i] - previous >= idle:
                if i > start:
                    yield pd.DataFrame(_windows(key[0], seen, last, events[start:i], h)).assign(episode=episode)
                seen, last, episode, start = 0, [], lines[i], i
        rest = events[start:]
        yield pd.DataFrame(_windows(key[0], seen, last, rest, h)).assign(episode=episode)
        end = int(times[-1]) + idle
        if end <= state.getCurrentWatermarkMs():
            # Nothing that may still arrive can belong to this episode.
            if state.exists:
                state.remove()
            return
        state.update((seen + len(rest), (last + rest)[-h:], episode, int(times[-1])))
        state.setTimeoutTimestamp(end)

    return (
        rows.withWatermark(time, lateness)
        .groupBy("session_id")
        .applyInPandasWithState(alive, IDLE_OUTPUT, IDLE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
