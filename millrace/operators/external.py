"""Calls to outside services from within a plan, with bounded concurrency, time limits and retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Retry:
    attempts: int = 3
    first_delay_s: float = 0.1
    most_delay_s: float = 10.0

    def delay(self, failures: int) -> float:
        return min(self.most_delay_s, self.first_delay_s * 2 ** (failures - 1))


def call(function: Callable, row: dict, retry: Retry = Retry(), sleep: Callable[[float], None] = time.sleep):
    """The function's result; after the last attempt, its error."""
    for failures in range(1, retry.attempts + 1):
        try:
            return function(row)
        except Exception:
            if failures == retry.attempts:
                raise
            sleep(retry.delay(failures))
    raise ValueError("attempts must be at least 1")


def enrich(df: DataFrame, function: Callable[[dict], list[dict]], schema: str, concurrency: int = 16, retry: Retry = Retry(), timeout_s: float | None = None) -> DataFrame:
    """Rows that the function gives for each row, in any order across rows; a task has at most ``concurrency`` calls open. A task that runs again calls again: at least once.

    timeout_s: how long a call may take, all its attempts together, from when it starts. Then the task fails at once with TimeoutError and
    doesn't wait for the call; calls that haven't started are cancelled.
    """
    names = [c.name for c in df.sparkSession.createDataFrame([], schema).schema]

    def timed(started: dict, k: int, row: dict):
        started[k] = time.monotonic()
        return call(function, row, retry)

    def result(f: Future, started: dict, k: int):
        while timeout_s is not None:
            left = timeout_s if k not in started else started[k] + timeout_s - time.monotonic()
            if left <= 0 and not f.done():
                raise TimeoutError(f"a call took more than {timeout_s} s")
            try:
                return f.result(max(left, 0.0))
            except FutureTimeout:
                if f.done():  # the call's own error
                    raise
        return f.result()

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(concurrency)
        try:
            for frame in frames:
                started: dict[int, float] = {}
                found = [pool.submit(timed, started, k, row) for k, row in enumerate(frame.to_dict("records"))]
                yield pd.DataFrame([out for k, f in enumerate(found) for out in result(f, started, k)], columns=names)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return df.mapInPandas(task, schema)
