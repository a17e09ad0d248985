"""Frames as a stream: slices anchored at a fixed origin, and GOPs as sessions with keyed state.

A GOP is open until the next key frame of its track comes; it has no timeout. Frames of a track come in decoding order
within a micro-batch's rows sorted by ``i``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GOPS = "track long, gop long, first_i long, frames long, bytes long, partial boolean"
_STATE = "gop long, first_i long, frames long, bytes long"


def slices(frames: DataFrame, time: str, width: str, origin: str = "0 seconds", late: str = "10 minutes") -> DataFrame:
    """Bits by track and slice of a fixed ``width`` from ``origin`` on; frames that are more than ``late`` behind are left out."""
    w = F.window(time, width, startTime=origin)
    return frames.withWatermark(time, late).groupBy("track", w.alias("w")).agg((F.sum("size") * 8).alias("bits")).select("track", F.col("w.start").alias("start"), "bits")


def _sessions(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    track = int(key[0])
    gop, first, frames, size = state.get if state.exists else (0, -1, 0, 0)
    rows = pd.concat(list(batches)).sort_values("i")
    done = []
    for i, n, is_key in zip(rows["i"], rows["size"], rows["key"], strict=True):
        if is_key is None or pd.isna(is_key) or bool(is_key):
            if frames:
                done.append((track, gop, first, frames, size, gop == 0))
            gop, first, frames, size = gop + 1, int(i), 0, 0
        elif not frames:
            first = int(i)
        frames, size = frames + 1, size + int(n)
    state.update((gop, first, frames, size))
    yield pd.DataFrame(done, columns=[c.split()[0] for c in GOPS.split(", ")])


def gop_sessions(frames: DataFrame) -> DataFrame:
    """Finished GOPs of a stream of frames (track, i, size, key); one before the first key frame is partial."""
    return frames.select("track", "i", "size", "key").groupBy("track").applyInPandasWithState(_sessions, GOPS, _STATE, "append", GroupStateTimeout.NoTimeout)
