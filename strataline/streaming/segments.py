"""Online segmentation: the debounced runs of a stream of frames, emitted as they close.

A state change counts only after `frames` equal rows, so the current run and one pending run are the whole state of a key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "n long, open_state string, open_start long, open_end long, open_n long, new_state string, new_start long, new_end long, new_n long"
_OUT = "key string, tp_start long, tp_end long, n_frames long, state string"


class OnlineDebounce:
    """Debounced runs of one key; `push` and `close` return the runs that are final."""

    def __init__(self, frames: int = 2, saved: tuple | None = None):
        self.frames = frames
        self.n, o, p = (0, None, None) if saved is None else (saved[0], list(saved[1:5]), list(saved[5:9]))
        self.open = o if o and o[3] else None
        self.new = p if p and p[3] else None

    def saved(self) -> tuple:
        return (self.n, *(self.open or ("", 0, 0, 0)), *(self.new or ("", 0, 0, 0)))

    def push(self, tp: int, state: str) -> list[list]:
        self.n += 1
        if self.open is None:
            self.open = [state, tp, tp, 1]
            return []
        if self.new is not None and self.new[0] == state:
            self.new[2:] = [tp, self.new[3] + 1]
        elif self.new is None and state == self.open[0]:
            self.open[2:] = [tp, self.open[3] + 1]
        else:
            if self.new is not None:  # too short a run: it belongs to the open one
                self._absorb()
            if state == self.open[0]:
                self.open[2:] = [tp, self.open[3] + 1]
            else:
                self.new = [state, tp, tp, 1]
        if self.new is not None and self.new[3] >= self.frames:
            done, self.open, self.new = self.open, self.new, None
            return [done]
        return []

    def _absorb(self) -> None:
        self.open[2:] = [self.new[2], self.open[3] + self.new[3]]
        self.new = None

    def close(self) -> list[list]:
        if self.new is not None and self.n < 3:
            return [self.open, self.new]
        if self.new is not None:
            self._absorb()
        return [self.open] if self.open else []


def stream_segments(frames: DataFrame, minutes_idle: int = 10, run_frames: int = 2) -> DataFrame:
    """Closed segments of a stream of (key string, tp long, state string) rows; a null state ends its key's recording.

    Rows of a key must come in time order from batch to batch. A key without rows for `minutes_idle` is closed too.
    """

    def step(key, batches, state: GroupState):
        online = OnlineDebounce(run_frames, state.get if state.exists else None)
        out = []
        ended = state.hasTimedOut
        if not ended:
            rows = pd.concat(list(batches)).sort_values("tp", kind="stable")
            for tp, s in zip(rows["tp"], rows["state"], strict=True):
                if s is None or pd.isna(s):
                    ended = True
                else:
                    out += online.push(int(tp), s)
        if ended:
            out += online.close()
            state.remove()
        else:
            state.update(online.saved())
            state.setTimeoutDuration(minutes_idle * 60_000)
        yield pd.DataFrame([(key[0], a, b, n, s) for s, a, b, n in out], columns=["key", "tp_start", "tp_end", "n_frames", "state"])

    return frames.groupBy("key").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
