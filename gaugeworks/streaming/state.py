"""Drift of each key against all its earlier windows, as a stream with state of its own and an account of late rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A closed window, or with n_late above 0 rows that came after their window was closed.
OUTPUT = "key string, start long, n long, mean double, reference_n long, reference_mean double, shift double, n_late long"
#: Last time seen, end of the last closed window, all closed windows' number and mean, and the open windows.
STATE = "last long, closed long, reference_n long, reference_mean double, starts array<long>, counts array<long>, sums array<double>"


class Expanding:
    """Windows of `width` seconds, closed when the key's time has passed their end by `late` seconds.

    State a key: the open windows, at most (late / width) + 2 of them and any before the key's first rows have settled,
    and the count and mean of all closed ones, which are the next window's reference.
    """

    def __init__(self, width: int, late: int):
        self.width, self.late = width, late

    def __call__(self, key: tuple[Any, ...], frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, closed, ref_n, ref_mean, starts, counts, sums = state.get if state.exists else (None, None, 0, 0.0, [], [], [])
        window = {s: (n, t) for s, n, t in zip(starts, counts, sums)}
        missed: dict[int, list[float]] = {}
        top = last
        for frame in frames:
            frame = frame.dropna(subset=["at", "value"])
            if not len(frame):
                continue
            top = int(frame["at"].max()) if top is None else max(top, int(frame["at"].max()))
            each = frame.assign(start=frame["at"] // self.width * self.width).groupby("start")["value"].agg(["count", "sum"])
            for s, n, t in each.itertuples():
                if closed is not None and s < closed:  # a batch's own rows never close a window before all of them are in
                    missed.setdefault(int(s), [0, 0.0])
                    missed[int(s)] = [missed[int(s)][0] + int(n), missed[int(s)][1] + float(t)]
                else:
                    n0, t0 = window.get(int(s), (0, 0.0))
                    window[int(s)] = (n0 + int(n), t0 + float(t))
        out = [(key[0], s, 0, None, None, None, None, int(n)) for s, (n, _) in sorted(missed.items())]
        for s in sorted(window):
            if top is None or s + self.width + self.late > top:
                break
            n, t = window.pop(s)
            mean = t / n
            out.append((key[0], s, n, mean, ref_n, ref_mean if ref_n else None, mean - ref_mean if ref_n else None, 0))
            ref_mean, ref_n, closed = (ref_mean * ref_n + t) / (ref_n + n), ref_n + n, s + self.width
        order = sorted(window)
        state.update((top, closed, ref_n, ref_mean, order, [window[s][0] for s in order], [window[s][1] for s in order]))
        if out:
            frame = pd.DataFrame(out, columns=["key", "start", "n", "mean", "reference_n", "reference_mean", "shift", "n_late"])
            yield frame.astype({c: "Int64" for c in ("start", "n", "reference_n", "n_late")})


def expanding_drift(events: DataFrame, key: str, time: str, value: str, width: int = 86_400, late: int = 86_400) -> DataFrame:
    """(key, start, n, mean, reference_n, reference_mean, shift, n_late) of a stream of events.

    A row with n_late 0 is a closed window (start in seconds) and its mean against all the key's closed windows before;
    a row with n_late above 0 says how many rows came for a window that had been closed: they are counted, not lost in silence, and change nothing else.
    Within a batch no window closes before all of the key's rows of that batch are in, so that the order of rows within a batch doesn't matter.
    Rows without a key, time or value are left out. State lives in Spark's state store; a restart from the checkpoint goes on where it ended.
    """
    rows = events.select(F.col(key).cast("string").alias("key"), F.unix_timestamp(F.col(time).cast("timestamp")).alias("at"), F.col(value).cast("double").alias("value")).filter("key is not null")
    return rows.groupBy("key").applyInPandasWithState(Expanding(width, late), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
