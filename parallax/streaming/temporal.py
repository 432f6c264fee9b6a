"""Streaming forms of the ordered-frame operators (our addition: the described program has no event time).

Rows of a stream must arrive in order from batch to batch; inside a batch they are sorted. A row older than what the
state has seen is dropped and counted. A null value has a null result and leaves the smoothed value as it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parallax.operators.frames import CUT


def smooth_stream(frames: DataFrame, stream: str, order: str, value: str, keep: float) -> DataFrame:
    """Smoothing with reset on a streaming DataFrame: (stream, order, smoothed, cuts, late)."""
    kinds, keep = dict(frames.dtypes), min(max(keep, 0.0), 0.95)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, cuts, newest, late = state.get if state.exists else (None, 0, None, 0)
        pdf = pd.concat(list(batches)).sort_values(order, kind="stable")
        rows = []
        for at, v in zip(pdf[order].tolist(), pdf[value].tolist(), strict=True):
            if newest is not None and at < newest:
                late += 1
                continue
            newest = at
            if v is None or v != v:
                rows.append((key[0], at, None, cuts, late))
                continue
            cut = before is not None and abs(v - before) / (abs(v) + 1e-9) > CUT
            cuts += cut
            before = v if before is None or cut else v + keep * (before - v)
            rows.append((key[0], at, before, cuts, late))
        state.update((before, cuts, newest, late))
        yield pd.DataFrame(rows, columns=[stream, order, "smoothed", "cuts", "late"])

    return frames.groupBy(stream).applyInPandasWithState(
        fold,
        f"{stream} {kinds[stream]}, {order} {kinds[order]}, smoothed double, cuts long, late long",
        f"before double, cuts long, newest {kinds[order]}, late long",
        "append",
        GroupStateTimeout.NoTimeout,
    )
