"""Groups of a sorted Arrow/pandas stream, one at a time, without holding the partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def sorted_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Yield the rows of each key of a stream sorted by ``keys``; only one group is held."""
    held: list[pd.DataFrame] = []
    last = None
    for frame in frames:
        if not len(frame):
            continue
        change = np.zeros(len(frame), bool)
        for key in keys:
            values = frame[key].to_numpy()
            change[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(change), len(frame)]
        for begin, end in zip(cuts, cuts[1:]):
            if end == begin:
                continue
            part = frame.iloc[begin:end]
            key = tuple(part[k].iat[0] for k in keys)
            if held and key != last:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
                held = []
            held.append(part)
            last = key
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
