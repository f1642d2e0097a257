"""What tasks do with their stream of batches: complete key groups out of a
sorted one, and giving memory back behind it."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa


def give_back() -> None:
    """Return the memory that was freed to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(step: Callable) -> Callable:
    """``step`` (batches to batches) that returns the memory it has freed to
    the system when the task ends: workers wait for their next task, and what
    they hold then is missing in the stages between."""
    def run(batches):
        try:
            yield from step(batches)
        finally:
            give_back()
    return run


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str],
                 rows: int = 4000) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of about ``rows`` rows that end where a key ends, with the index
    of the first row of each group (one more at the end).

    For ``mapInPandas`` over rows that are dealt out and sorted by ``keys``;
    the size of a group must be bounded by the caller.
    """
    held: list[pd.DataFrame] = []
    n = 0
    for batch in batches:
        if len(batch) == 0:
            continue
        held.append(batch)
        n += len(batch)
        if n < rows:
            continue
        frame = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        starts = group_starts(frame, keys)
        if len(starts) > 2:
            cut = starts[-2]
            yield frame.iloc[:cut].reset_index(drop=True), starts[:-1]
            frame = frame.iloc[cut:].reset_index(drop=True)
        held, n = [frame], len(frame)
    if n:
        frame = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        yield frame, group_starts(frame, keys)


def group_starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(frame), dtype=bool)
    new[:1] = True
    for k in keys:
        v = frame[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(frame))
