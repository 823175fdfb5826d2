"""The trailing z-score over a stream: the state keeps the last values, the scoring is the batch one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from tableinsight.operators.anomaly import THRESHOLD, WINDOW_SIZE, score, should_run

DECISION_SCHEMA = (
    "source string, path string, modified timestamp, n bigint, reason string, anomaly boolean, "
    "moyenne double, ecart_type double, z_score double, direction string, severite string, "
    "should_run boolean"
)
HISTORY = "history"  # status of arrivals that only fill the state
_STATE = "recent array<double>, last_batch bigint"
_WINDOWS = "source string, path string, modified timestamp, n bigint, window array<double>"


def windows(arrivals: DataFrame, window_size: int = WINDOW_SIZE) -> DataFrame:
    """Stream of ``(source, batch_id, path, modified, n)`` to each arrival with the values up to it.

    An arrival is one row per file, so a source's state update handles as many rows as files
    arrived, never the files' rows. A batch that is delivered again is ignored. Rows whose ``status``
    is history give the state its start value and are not decided on.
    """

    def extend(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        recent, last_batch = state.get if state.exists else ([], -3)
        rows = pd.concat(list(frames))
        fresh = rows[rows["batch_id"] > last_batch].sort_values(["batch_id", "modified", "path"])
        if fresh.empty:
            return
        series = [*recent, *fresh["n"].astype(float)]
        ends = range(len(recent) + 1, len(series) + 1)
        state.update((series[-window_size:], int(fresh["batch_id"].max())))
        out = fresh[["path", "modified", "n"]].assign(
            source=key[0], window=[series[max(0, end - window_size) : end] for end in ends]
        )
        if "status" in fresh:
            out = out[fresh["status"] != HISTORY]
        yield out[["source", "path", "modified", "n", "window"]]

    return arrivals.groupBy("source").applyInPandasWithState(
        extend, _WINDOWS, _STATE, "append", GroupStateTimeout.NoTimeout
    )


def decisions(
    arrivals: DataFrame, window_size: int = WINDOW_SIZE, threshold: float = THRESHOLD
) -> DataFrame:
    """One decision per arrival, as ``DECISION_SCHEMA``."""
    scored = score(windows(arrivals, window_size), "window", threshold)
    columns = [c.split()[0] for c in DECISION_SCHEMA.split(", ")]
    return scored.withColumn("should_run", should_run()).select(*columns)
