"""Run state as a stream, with a state that ends with the run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeloom.functions.scores import clamped
from codeloom.operators.runs import TERMINAL
from codeloom.sources import commit_log

#: Event time that ticks may come late by, and that the state of a finished run is kept for.
LATE = "10 minutes"
KEPT_SECONDS = 3600

_STATE = "seq bigint, status string, step string, pct double, error string, started bigint, finished bigint"
_RUN_STATE = (
    "run_id {key}, status string, current_step string, progress_pct double, error_message string, "
    "started_at timestamp, finished_at timestamp"
)


def _folded(key: tuple, ticks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The state of one run after more ticks; a finished run gets a timer, which removes it."""
    if state.hasTimedOut:
        state.remove()
        return
    last = tuple(state.get) if state.exists else (None, None, None, None, None, None, None)
    newest, started, finished = last[:5], last[5], last[6]
    for some in ticks:
        top = some.loc[some["seq"].idxmax()]
        if newest[0] is None or top["seq"] >= newest[0]:
            newest = tuple(None if pd.isna(top[c]) else top[c] for c in ("seq", "status", "step", "pct", "error"))
        first = int(some["at"].min())
        started = first if started is None else min(first, started)
        ended = some.loc[some["status"].isin(TERMINAL), "at"]
        if len(ended):
            finished = int(ended.max()) if finished is None else max(int(ended.max()), finished)
    newest = (int(newest[0]), *newest[1:])
    state.update((*newest, started, finished))
    if newest[1] in TERMINAL:
        state.setTimeoutTimestamp(max(finished // 1000 + 1000 * KEPT_SECONDS, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame([(key[0], *newest[1:], started, finished)], columns=["run_id", "status", "step", "pct", "error", "started", "finished"])


def latest_run_state_stream(ticks: DataFrame, *, late: str = LATE) -> DataFrame:
    """The batch aggregation over a stream of ticks; one state row per run that changed.

    A run whose newest tick is terminal leaves the state once the watermark is
    ``KEPT_SECONDS`` past its end, so the state holds running and newly finished runs only.
    Ticks behind the watermark are dropped; a tick in time for a run that has left begins it
    anew.  A run that never ends stays in the state.
    """
    kind = dict(ticks.dtypes)["run_id"]
    timed = ticks.withColumn("_time", F.col("ts").cast("timestamp")).withWatermark("_time", late)
    rows = timed.select("run_id", "seq", "status", "step", F.col("pct").cast("double").alias("pct"), "error", F.unix_micros("_time").alias("at"), "_time")
    shape = f"run_id {kind}, status string, step string, pct double, error string, started bigint, finished bigint"
    states = rows.groupBy("run_id").applyInPandasWithState(_folded, shape, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return states.select(
        "run_id", "status", F.col("step").alias("current_step"), clamped(F.col("pct"), 0.0, 100.0).alias("progress_pct"),
        F.col("error").alias("error_message"), F.timestamp_micros("started").alias("started_at"), F.timestamp_micros("finished").alias("finished_at"),
    )


def start_run_state(ticks: DataFrame, table_path: str, checkpoint: str, *, late: str = LATE) -> StreamingQuery:
    """Commit the changed states of every micro-batch to a table; see ``read_run_state``.

    A repeated batch has the name of the first try, so a restart adds no rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        commit_log.append(batch, table_path, write=f"batch-{batch_id:010d}")

    return (
        latest_run_state_stream(ticks, late=late)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_run_state(spark: SparkSession, table_path: str, key: str = "bigint") -> DataFrame:
    """Latest state per run of the table written by ``start_run_state``; ``key`` is the type of
    the run ids."""
    return commit_log.latest(commit_log.read(spark, table_path, _RUN_STATE.format(key=key)), ["run_id"]).drop(*commit_log.ORDER)


def compact_run_state(spark: SparkSession, table_path: str, key: str = "bigint") -> None:
    """Leave one row per run in the files of the table, and delete the others.  Not while
    somebody reads it."""
    commit_log.compact(spark, table_path, _RUN_STATE.format(key=key), ["run_id"])
    commit_log.vacuum(table_path)
