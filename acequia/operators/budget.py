"""Replay of a rate budget over a call log (survey R1-R7, A8)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Budget:
    """Two token buckets; fixed values of the standard budget."""

    burst: float = 8.0
    burst_rate: float = 8 / 60.0
    hourly: float = 100.0
    hourly_rate: float = 100 / 3600.0
    penalty: float = 4.0
    cool: float = 4.0
    #: A call that needn't wait is charged twice, as the budget does; False charges once.
    double_charge: bool = True


@dataclass
class BudgetState:
    burst: float
    hourly: float
    at: float
    calls: int = 0
    errors: int = 0
    pauses: int = 0

    def refill(self, b: Budget, now: float) -> None:
        passed = now - self.at
        if passed > 0:
            self.burst = min(b.burst, self.burst + passed * b.burst_rate)
            self.hourly = min(b.hourly, self.hourly + passed * b.hourly_rate)
            self.at = now

    def apply(self, b: Budget, kind: str, now: float, weight: float = 1.0, cool_run: bool = False) -> float:
        """One event of the log; gives the seconds a call has to wait."""
        if kind == "pause":
            self.pauses += 1
            return 0.0
        if kind == "error":
            loss = weight or b.penalty
            self.burst, self.hourly = max(0.0, self.burst - loss), max(0.0, self.hourly - loss)
            self.errors += 1
            return 0.0
        self.refill(b, now)
        wait = 0.0
        if self.burst >= weight and self.hourly >= weight:
            if b.double_charge:
                self.burst, self.hourly = self.burst - weight, self.hourly - weight
        else:
            short = max((weight - self.burst) / b.burst_rate, (weight - self.hourly) / b.hourly_rate, 0.0)
            wait = short * (b.cool if cool_run else 1.0)
            self.pauses += 1
            self.refill(b, now + wait)
        self.burst, self.hourly, self.calls = self.burst - weight, self.hourly - weight, self.calls + 1
        return wait


REPLAY_COLUMNS = "wait double, burst_left double, hourly_left double, calls bigint, errors bigint, pauses bigint"


def replay(log: DataFrame, key: str, order: str, budget: Budget = Budget()) -> DataFrame:
    """State after each event of each key's log (ts, kind, weight, cool_run), in order.

    A key's log is sequential by nature; keys are replayed side by side. Logs come sorted
    and in batches, and only a key's state is carried on, so no log is held whole.
    """
    kind = dict(log.dtypes)[key]
    okind = dict(log.dtypes)[order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, held = None, object()
        for pdf in batches:
            out = []
            for k, none, o, ts, what, weight, cool in zip(pdf[key], pdf._none, pdf[order], pdf.ts, pdf.kind, pdf.weight, pdf.cool_run):
                k = None if none else k
                if state is None or k != held:
                    state, held = BudgetState(budget.burst, budget.hourly, ts), k
                wait = state.apply(budget, what, ts, weight if pd.notna(weight) else (0.0 if what == "error" else 1.0), bool(cool))
                out.append((k, o, wait, state.burst, state.hourly, state.calls, state.errors, state.pauses))
            yield pd.DataFrame(out, columns=[key, order, *[c.split()[0] for c in REPLAY_COLUMNS.split(", ")]])

    slim = log.select(key, F.col(key).isNull().alias("_none"), order, F.col("ts").cast("double").alias("ts"), "kind", F.col("weight").cast("double").alias("weight"), "cool_run")
    return slim.repartition(key).sortWithinPartitions(key, "ts", order).mapInPandas(run, f"{key} {kind}, {order} {okind}, {REPLAY_COLUMNS}")


def retry_class(message: Column) -> Column:
    """What an error message calls for: challenge (45 s), transient (15 s) or none."""
    low = F.lower(message)
    challenge = low.rlike("challenge|captcha|checkpoint|verif")
    transient = low.rlike("timeout|timed out|tempor|connection|rate|429|503")
    return F.when(challenge, F.lit(45)).when(transient, F.lit(15)).otherwise(F.lit(0))


def backoff_seconds(attempt: Column, base: float = 2.0, attempts: int = 3) -> Column:
    """Linear backoff; null after the last attempt."""
    return F.when(attempt < attempts, attempt * F.lit(base))
