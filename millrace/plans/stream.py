"""Fluent interface: a lazy plan over a DataFrame, bounded or streaming.

Steps take column expressions, so the optimizer sees all of them; row functions in Python are the exception (:meth:`Stream.map_rows`, windows'
:meth:`Windowed.apply`) and run on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import reduce, windows
from millrace.operators.relational import where

GUARANTEES = ("two_phase_commit", "idempotent", "at_least_once")


@dataclass(frozen=True)
class Elastic:
    """Limits between which a keyed operator may be scaled."""

    least: int = 1
    most: int = 64
    cooldown_s: float = 60.0


def check_job(parallelism: int = 1, elastic: Elastic | None = None, tiered_state: bool = False, sink: str | None = None) -> None:
    """Errors that show before a job starts."""
    if parallelism < 1:
        raise ValueError("parallelism must be at least 1")
    if elastic and not tiered_state:
        raise ValueError("elastic operators need tiered state")
    if elastic and not 1 <= elastic.least <= elastic.most:
        raise ValueError("limits must satisfy 1 <= least <= most")
    if sink is not None and sink not in GUARANTEES:
        raise ValueError(f"unknown sink guarantee {sink}")
    if sink == "at_least_once":
        raise ValueError("an exactly-once job needs a sink with two-phase commit or idempotent writes")


class Stream:
    def __init__(self, df: DataFrame, time: str | None = None, delay: int | None = None, arrival: Sequence[str] = ()):
        self.df, self.time, self.delay, self.arrival = df, time, delay, tuple(arrival)

    def _with(self, df: DataFrame) -> Stream:
        return Stream(df, self.time, self.delay, self.arrival)

    def map(self, *columns: Column | str) -> Stream:
        return self._with(self.df.select(*columns))

    def filter(self, *conditions: Column) -> Stream:
        return self._with(where(self.df, *conditions))

    def flat_map(self, array: Column, name: str) -> Stream:
        """A row for each element of the array."""
        return self._with(self.df.select(*self.df.columns, F.explode(array).alias(name)))

    def map_rows(self, f: Callable[[dict], Iterator[dict]], schema: str) -> Stream:
        """Any Python function from a row to rows."""

        def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame([out for row in frame.to_dict("records") for out in f(row)], columns=names)

        names = [c.name for c in self.df.sparkSession.createDataFrame([], schema).schema]
        return self._with(self.df.mapInPandas(task, schema))

    def transform(self, f: Callable[[DataFrame], DataFrame]) -> Stream:
        return self._with(self.df.transform(f))

    def assign_timestamps_and_watermarks(self, time: str, delay: int, arrival: Sequence[str] = ()) -> Stream:
        """time: column of milliseconds. Bounded input with an arrival order loses, element by element, what comes ``delay`` behind the largest time so far; a stream has a native watermark."""
        return Stream(self.df, time, delay, arrival)

    def rebalance(self, n: int) -> Stream:
        check_job(n)
        return self._with(self.df.repartition(n))

    def broadcast(self, most_rows: int = 100_000) -> Stream:
        """A copy for every task of a join, if a count finds no more rows than that; else the joins' own plan holds."""
        small = self.df.limit(most_rows + 1).count() <= most_rows
        return self._with(F.broadcast(self.df) if small else self.df)

    def key_by(self, *keys: str) -> Keyed:
        return Keyed(self, keys)

    def collect(self) -> list:
        return self.df.collect()

    def discard(self) -> None:
        self.df.write.format("noop").mode("overwrite").save()


class Keyed:
    def __init__(self, stream: Stream, keys: Sequence[str]):
        self.stream, self.keys = stream, tuple(keys)

    def reduce(self, column: str, function: str, name: str | None = None) -> Stream:
        return Stream(reduce.reduce_by(self.stream.df, self.keys, column, function, name))

    def fold(self, column: Column, arrival: Sequence[str], merge: Callable[[Column, Column], Column], name: str) -> Stream:
        return Stream(reduce.fold(self.stream.df, self.keys, column, arrival, merge, name))

    def running(self, column: str, function: str, arrival: Sequence[str], name: str = "running") -> Stream:
        return Stream(reduce.running(self.stream.df, self.keys, column, function, arrival, name))

    def aggregate(self, column: str, acc: reduce.Accumulator, result_type: str, name: str = "result") -> Stream:
        return Stream(reduce.accumulate(self.stream.df, self.keys, column, acc, result_type, name))

    def window(self, assigner) -> Windowed:
        return Windowed(self, assigner)


class Windowed:
    def __init__(self, keyed: Keyed, assigner):
        self.keyed, self.assigner = keyed, assigner

    def _rows(self) -> DataFrame:
        s = self.keyed.stream
        if s.time is None:
            raise ValueError("windows need assign_timestamps_and_watermarks")
        if s.df.isStreaming:
            return s.df
        return windows.on_time(s.df, s.time, s.arrival, s.delay) if s.arrival else s.df

    def aggregate(self, *aggregates: Column) -> Stream:
        """keys, window_start, window_end, aggregates, and time: the window's last millisecond.

        A stream uses its native window and watermark: results appear once the watermark has passed, and rows count as late by their window, not one by one.
        """
        s, keys = self.keyed.stream, self.keyed.keys
        if s.df.isStreaming:
            out = self._native(s.df.withColumn("_ts", F.timestamp_millis(F.col(s.time))).withWatermark("_ts", f"{s.delay} milliseconds"), keys, aggregates)
        else:
            out = windows.aggregate(self._rows(), self.assigner, keys, s.time, *aggregates)
        return Stream(out.withColumn("time", F.col("window_end") - 1), "time", s.delay)

    def _native(self, stamped: DataFrame, keys: tuple[str, ...], aggregates: Sequence[Column]) -> DataFrame:
        """The engine's own streaming windows, and those that it lacks by way of them."""
        a = self.assigner
        start, end = F.unix_millis("w.start"), F.unix_millis("w.end")
        if isinstance(a, windows.Global):  # emits in complete and update mode; see streaming.state.windowed for triggers and the end of input
            out = stamped.groupBy(*keys).agg(*aggregates)
            own = [c for c in out.columns if c not in keys]
            return windows.Global().assign(out, self.keyed.stream.time).select(*keys, "window_start", "window_end", *own)
        if isinstance(a, windows.Session) and not a.merge:  # every time is a window of its own
            w, start, end = F.col("_ts"), F.unix_millis("w"), F.unix_millis("w") + a.gap
        elif isinstance(a, windows.Session):
            w = F.session_window("_ts", f"{a.gap} milliseconds")
        elif getattr(a, "slide", a.size) > a.size:  # gaps: the first part of tumbling windows as long as the slide
            at = F.pmod(F.unix_millis("_ts") - a.offset, F.lit(a.slide))
            stamped, w, end = stamped.where(at < a.size), F.window("_ts", f"{a.slide} milliseconds", f"{a.slide} milliseconds", f"{a.offset % a.slide} milliseconds"), start + a.size
        else:
            slide = getattr(a, "slide", a.size)
            w = F.window("_ts", f"{a.size} milliseconds", f"{slide} milliseconds", f"{a.offset % slide} milliseconds")
        out = stamped.groupBy(*keys, w.alias("w")).agg(*aggregates)
        own = [c for c in out.columns if c not in (*keys, "w")]
        return out.select(*keys, start.alias("window_start"), end.alias("window_end"), *own)

    def accumulate(self, column: str, acc: reduce.Accumulator, result_type: str, name: str = "result") -> Stream:
        """A user's aggregate for each window of bounded input: keys, window_start, window_end, the result and time. Streams: streaming.state.windowed."""
        s, keys = self.keyed.stream, self.keyed.keys
        rows = windows.assigned(self._rows(), self.assigner, keys, s.time)
        out = reduce.accumulate(rows, [*keys, "window_start", "window_end"], column, acc, result_type, name)
        return Stream(out.withColumn("time", F.col("window_end") - 1), "time", s.delay)

    def reduce(self, column: str, function: str, name: str | None = None) -> Stream:
        return self.aggregate(reduce.NAMED[function](column).alias(name or column))

    def apply(self, f: Callable[[tuple, int, int, pd.DataFrame], pd.DataFrame | list[tuple]], schema: str) -> Stream:
        """f(key, window_start, window_end, rows in no order) for each window: a frame or a list of tuples. A window's rows are held together."""
        keys = self.keyed.keys
        rows = windows.assigned(self._rows(), self.assigner, keys, self.keyed.stream.time)

        def task(group: tuple, frame: pd.DataFrame) -> pd.DataFrame | list[tuple]:
            return f(group[: len(keys)], int(group[-2]), int(group[-1]), frame)

        return Stream(by_group(rows, [*keys, "window_start", "window_end"], task, schema, ["window_start", "window_end"]))


#: Frames or rows of results that become one Arrow batch.
FRAMES = 1_000


def by_group(df: DataFrame, by: Sequence[str], f: Callable[[tuple, pd.DataFrame], pd.DataFrame | list[tuple]], schema: str, left_out: Sequence[str] = ()) -> DataFrame:
    """f(group, its rows without the columns left_out), as groupBy(by).applyInPandas: but an Arrow batch has many groups, where that has one at least for each group.

    f gives a frame, or rows as a list of tuples, which costs much less for small groups. A frame's types are those of its group alone: integers and booleans with nulls in other groups of the batch stay what they are.
    """
    flags = {c.name: f"_null_{c.name}" for c in df.schema if isinstance(c.dataType, (T.IntegralType, T.BooleanType))}
    names = T.StructType.fromDDL(schema).names
    truth = {c.name for c in df.schema if isinstance(c.dataType, T.BooleanType)}
    columns, kept = df.columns, [c for c in df.columns if c not in left_out]
    fresh = F.row_number().over(Window.partitionBy(*by).orderBy(*by)) == 1  # groups follow each other in a partition, as windows demand
    rows = df.withColumn("_fresh", fresh)
    rows = rows.select("_fresh", *[F.coalesce(c, F.lit(False) if c in truth else F.lit(0).cast(df.schema[c].dataType)).alias(c) if c in flags else F.col(c) for c in columns], *[F.col(c).isNull().alias(n) for c, n in flags.items()])

    def typed(frame: pd.DataFrame) -> pd.DataFrame:
        for c, n in flags.items():
            if (null := frame[n]).any():
                frame[c] = frame[c].astype(object if c in truth else "float64").mask(null, None if c in truth else float("nan"))
        return frame

    def called(frame: pd.DataFrame) -> pd.DataFrame | list[tuple]:
        frame = typed(frame.reset_index(drop=True))
        return f(tuple(frame[c].iloc[0] for c in by), frame[kept])

    def results(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | list[tuple]]:
        held: list[pd.DataFrame] = []  # of a group that may go on in the next batch
        for frame in frames:
            starts = [*frame["_fresh"].to_numpy().nonzero()[0].tolist(), len(frame)]
            if starts[0] > 0:
                held.append(frame.iloc[: starts[0]])
            if len(starts) == 1:
                continue
            if held:
                yield called(pd.concat(held))
            held = [frame.iloc[starts[-2] :]]
            spans = zip(starts[:-2], starts[1:-1])
            if flags and frame[list(flags.values())].to_numpy().any():
                for a, b in spans:
                    yield called(frame.iloc[a:b])
            else:  # all groups have the batch's types; what is the same for all is done once
                own, keys = frame[kept], [frame[c].array for c in by]
                for a, b in spans:
                    part = own.iloc[a:b].copy()
                    part.index = pd.RangeIndex(b - a)
                    yield f(tuple(k[a] for k in keys), part)
        if held:
            yield called(pd.concat(held))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: list[pd.DataFrame] = []
        rows: list[tuple] = []

        def done() -> Iterator[pd.DataFrame]:
            if made:
                yield pd.concat(made, ignore_index=True) if len(made) > 1 else made[0]
                made.clear()
            if rows:
                yield pd.DataFrame(rows, columns=names, dtype=object)
                rows.clear()

        for out in results(frames):
            if isinstance(out, list):
                rows += out
            elif len(out):
                if made and (list(made[0].columns) != list(out.columns) or list(made[0].dtypes) != list(out.dtypes)):
                    yield from done()  # one frame would change the types
                made.append(out)
            if len(rows) + len(made) >= FRAMES:
                yield from done()
        yield from done()

    return rows.mapInPandas(task, schema)
