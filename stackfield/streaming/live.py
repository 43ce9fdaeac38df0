"""Live stacks: a stream of frames, and the mean of each capture so far.

The state of a capture is the sum of its frames and their number, so it is as
large as one frame however long the stream runs. With idle_ms it goes when no
frame of the capture has come for so long; such a stream never comes to rest, as
each batch may be the one in which a state goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship

OUTPUT = "capture string, height int, width int, n long, pixels array<double>"
STATE = "height int, width int, n long, sums binary"


def live_mean(frames: DataFrame, key: str, idle_ms: int | None = None) -> DataFrame:
    """frames (key, height, width, pixels), a stream; gives the mean of a capture
    whenever a batch brings frames of it. Use it with output mode update."""
    ship(frames.sparkSession)

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        h, w, n, sums = state.get if state.exists else (0, 0, 0, b"")
        total = np.frombuffer(sums, dtype=np.float64) if sums else None
        for b in batches:
            for height, width, pixels in zip(b["height"], b["width"], b["pixels"], strict=True):
                own = np.asarray(pixels, dtype=np.float64)
                h, w, n, total = int(height), int(width), n + 1, own if total is None else total + own
        if total is None:
            return
        state.update((h, w, n, total.tobytes()))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"capture": [str(name[0])], "height": [h], "width": [w], "n": [n], "pixels": [total / n]})

    slim = frames.select(key, "height", "width", "pixels")
    return slim.groupBy(key).applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
