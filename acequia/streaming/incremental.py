"""Streaming forms: incremental first-seen, windowed counts and the rate budget as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from acequia.operators.budget import REPLAY_COLUMNS, Budget, BudgetState


def stream_first_seen(stream: DataFrame, key: Column, ts: str, delay: str = "1 day") -> DataFrame:
    """The first row of a key within the watermark; rows without a key all pass."""
    keyed = stream.withColumn("_k", F.coalesce(key, F.lit(""))).withColumn("_ts", F.col(ts).cast("timestamp"))
    # rows without a key get one of their own, so they neither collide nor form a hot key
    own = F.when(F.col("_k") == "", F.concat(F.lit("\x01"), F.uuid())).otherwise(F.col("_k"))
    return keyed.withColumn("_k", own).withWatermark("_ts", delay).dropDuplicatesWithinWatermark(["_k"]).drop("_k", "_ts")


def stream_rates(stream: DataFrame, key: str, ts: str, width: str = "60 seconds", slide: str = "10 seconds", delay: str = "2 minutes") -> DataFrame:
    """A7 on a stream: calls of a key in sliding windows."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    counted = timed.groupBy(F.window("_ts", width, slide), key).agg(F.count("*").alias("calls"))
    return counted.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "calls")


def stream_sessions(stream: DataFrame, key: str, ts: str, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Calls of a key in sessions that a gap ends."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    counted = timed.groupBy(F.session_window("_ts", gap), key).agg(F.count("*").alias("calls"))
    return counted.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "calls")


def stream_budget(stream: DataFrame, key: str, budget: Budget = Budget()) -> DataFrame:
    """R1-R5 as keyed state over a stream of (key, seq, ts in seconds, kind, weight, cool_run).

    Within a micro-batch a key's events are taken in the order of ts and seq.
    """
    kind = dict(stream.dtypes)[key]
    names = [key, "seq", *[c.split()[0] for c in REPLAY_COLUMNS.split(", ")]]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = BudgetState(*state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        out = []
        for seq, ts, what, weight, cool in zip(rows.seq, rows.ts, rows.kind, rows.weight, rows.cool_run):
            held = held or BudgetState(budget.burst, budget.hourly, ts)
            wait = held.apply(budget, what, ts, weight if pd.notna(weight) else (0.0 if what == "error" else 1.0), bool(cool))
            out.append((k[0], seq, wait, held.burst, held.hourly, held.calls, held.errors, held.pauses))
        if held:
            state.update((held.burst, held.hourly, held.at, held.calls, held.errors, held.pauses))
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, seq bigint, {REPLAY_COLUMNS}",
        "burst double, hourly double, at double, calls bigint, errors bigint, pauses bigint", "append", GroupStateTimeout.NoTimeout,
    )
