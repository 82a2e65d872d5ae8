"""Keyed streaming state that expires by event time: match freshness, kept gauges and task status.

Inputs carry a watermark (``withWatermark``) on their event time. Nothing depends on when a batch
happens to run, so a replay gives the same rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pairwright import fixed_values as fv


def _wake(state: GroupState, moment: int) -> None:
    """Set the timer to ``moment`` (ms); a moment that the watermark has passed fires with the next batch."""
    state.setTimeoutTimestamp(max(moment, state.getCurrentWatermarkMs() + 1))


def match_freshness_stream(requests: DataFrame, ttl_seconds: int = fv.MATCH_TTL_SECONDS, ordered: bool = False) -> DataFrame:
    """Whether each request (``request_key, created`` in ms) finds a result that is still valid.

    The state holds the time of the last result of a request key. It goes when the watermark passes the end
    of its validity, as no later request can then reuse it. All rows of a key in one batch are judged
    in the order of their times. With ``ordered`` a row waits until the watermark has passed it, so rows of
    several batches are judged in that order too and the result does not depend on how they arrived; rows that come
    after the watermark are left out.
    """
    ttl = ttl_seconds * 1000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        moments = list(waiting)
        passed = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            moments += [int(m) for frame in frames for m in frame["created"] if not ordered or m > passed]
        moments.sort()
        ready = bisect.bisect_right(moments, passed) if ordered else len(moments)
        out = []
        for moment in moments[:ready]:
            reused = last is not None and moment - last <= ttl
            last = last if reused else moment
            out.append((key[0], moment, reused))
        waiting = moments[ready:]
        if waiting or last is not None and last + ttl >= passed:
            state.update((last, waiting))
            _wake(state, waiting[0] if waiting else last + ttl + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["request_key", "created", "reused"])

    return requests.groupBy("request_key").applyInPandasWithState(
        step, "request_key string, created long, reused boolean", "last long, waiting array<long>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )


def carry_gauges_stream(samples: DataFrame, seconds: int = fv.FLUSH_SECONDS) -> DataFrame:
    """Gauges kept over flush windows: the stream form of ``carry_gauges``, over ``name, gauge, created`` in microseconds.

    When the watermark closes a window with a sample, its last value comes into force: a row without
    ``valid_until``; the value in force until then is told again with its end. So the row of a window with the
    highest ``valid_until`` counts. The state of a gauge is the value in force and one sample for each open window.
    Of samples with one time the highest value counts; those that come after the watermark are left out.
    """
    width = seconds * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, gauge, times, values = state.get if state.exists else (None, None, [], [])
        open_windows = {t - t % width: (t, v) for t, v in zip(times, values, strict=True)}
        passed = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for frame in frames:
                frame = frame[frame["created"] > passed]
                for t, v in zip(frame["created"].astype("int64"), frame["gauge"], strict=True):
                    at = int(t) - int(t) % width
                    open_windows[at] = max(open_windows.get(at, (int(t), float(v))), (int(t), float(v)))
        out = []
        for at in sorted(w for w in open_windows if w + width <= passed):
            if start is not None:
                out.append((key[0], gauge, start, at))
            start, gauge = at, open_windows.pop(at)[1]
            out.append((key[0], gauge, start, None))
        left = sorted(open_windows.values())
        state.update((start, gauge, [t for t, _ in left], [v for _, v in left]))
        if open_windows:
            _wake(state, (min(open_windows) + width) // 1000)
        if out:
            yield pd.DataFrame(out, columns=["name", "gauge", "window_start", "valid_until"]).astype(
                {"window_start": "Int64", "valid_until": "Int64"})

    known = samples.where("gauge is not null and created is not null")
    return known.groupBy("name").applyInPandasWithState(
        step, "name string, gauge double, window_start long, valid_until long",
        "start long, gauge double, times array<long>, vals array<double>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )


def task_status_stream(updates: DataFrame, expiry_seconds: int = fv.TASK_EXPIRY_SECONDS) -> DataFrame:
    """Status changes per task (``task_id, status, result, created`` ms, ``seq``), with the ``seq`` of both.

    Status and result are those with the highest ``seq`` each, whatever order rows arrive in. A task expires when
    the watermark passes its first ``created`` plus the expiry, however often it reports; an update of a
    task that old is reported expired too, also after its state is gone.
    """
    expiry = expiry_seconds * 1000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, seq, result, result_seq, created = state.get if state.exists else (None, -1, None, -1, None)
        if not state.hasTimedOut:
            for frame in frames:
                for row in frame.itertuples():
                    created = int(row.created) if created is None else min(created, int(row.created))
                    if row.seq > seq:
                        status, seq = row.status, int(row.seq)
                    if row.result is not None and row.seq > result_seq:
                        result, result_seq = row.result, int(row.seq)
        if state.hasTimedOut or created + expiry < state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            status = "expired"
        else:
            state.update((status, seq, result, result_seq, created))
            _wake(state, created + expiry + 1)
        yield pd.DataFrame([(key[0], status, result, seq, result_seq)], columns=["task_id", "status", "result", "seq", "result_seq"])

    return updates.groupBy("task_id").applyInPandasWithState(
        step, "task_id string, status string, result string, seq long, result_seq long",
        "status string, seq long, result string, result_seq long, created long",
        "update", GroupStateTimeout.EventTimeTimeout,
    )
