"""Event-time windows over columns of milliseconds, and aggregates of them.

Windows are half open, [start, end); a window's result carries ``end - 1`` as its time. Starts are longs in milliseconds, for times before 1970 too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.expressions import col_at
from millrace.operators.relational import Aggregate


def millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp with or without time zone (UTC)."""
    return F.unix_millis(ts.cast("timestamp"))


@dataclass(frozen=True)
class Tumbling:
    size: int
    offset: int = 0

    def __post_init__(self):
        if self.size <= 0:
            raise ValueError("size must be positive")

    def assign(self, df: DataFrame, time: str) -> DataFrame:
        """Adds window_start and window_end."""
        start = F.col(time) - F.pmod(F.col(time) - self.offset, F.lit(self.size))
        return df.withColumn("window_start", start).withColumn("window_end", F.col("window_start") + self.size)

    def of(self, time: int) -> list[tuple[int, int]]:
        """Windows that hold a time."""
        start = time - (time - self.offset) % self.size
        return [(start, start + self.size)]


@dataclass(frozen=True)
class Sliding:
    size: int
    slide: int
    offset: int = 0

    def __post_init__(self):
        if self.size <= 0 or self.slide <= 0:
            raise ValueError("size and slide must be positive")

    def assign(self, df: DataFrame, time: str) -> DataFrame:
        """A row for each window that holds the time; none in the gaps where slide exceeds size."""
        last = F.col(time) - F.pmod(F.col(time) - self.offset, F.lit(self.slide))
        starts = F.transform(F.sequence(F.lit(0), F.lit((self.size - 1) // self.slide)), lambda k: last - k * self.slide)
        starts = F.filter(starts, lambda s: s > F.col(time) - self.size)
        return df.withColumn("window_start", F.explode(starts)).withColumn("window_end", F.col("window_start") + self.size)

    def of(self, time: int) -> list[tuple[int, int]]:
        last = time - (time - self.offset) % self.slide
        return [(s, s + self.size) for s in range(last, time - self.size, -self.slide)]


@dataclass(frozen=True)
class Session:
    """Sessions that rows at most ``gap`` apart share; merge=False makes every distinct time a window of its own."""

    gap: int
    merge: bool = True

    def __post_init__(self):
        if self.gap <= 0:
            raise ValueError("gap must be positive")

    def of(self, time: int) -> list[tuple[int, int]]:
        return [(time, time + self.gap)]

    def assign(self, df: DataFrame, time: str, keys: Sequence[str] = ()) -> DataFrame:
        """Rows with their session's window. A key's rows are sorted together, as sessions demand, but not held."""
        if not self.merge:
            return df.withColumn("window_start", F.col(time)).withColumn("window_end", F.col(time) + self.gap)
        earlier = Window.partitionBy(*keys).orderBy(time)
        fresh = F.coalesce(F.col(time) - F.lag(time).over(earlier) > self.gap, F.lit(True)).cast("int")
        rows = df.withColumn("_fresh", fresh).withColumn("_session", F.sum("_fresh").over(earlier))
        own = Window.partitionBy(*keys, "_session")
        rows = rows.withColumn("window_start", F.min(time).over(own)).withColumn("window_end", F.max(time).over(own) + self.gap)
        return rows.drop("_fresh", "_session")

    def aggregate(self, df: DataFrame, keys: Sequence[str], time: str, *aggregates: Column) -> DataFrame:
        if not self.merge:
            return df.groupBy(*keys, F.col(time).alias("window_start"), (F.col(time) + self.gap).alias("window_end")).agg(*aggregates)
        w = F.session_window(F.timestamp_millis(F.col(time)), f"{self.gap} milliseconds").alias("w")
        out = df.groupBy(*keys, w).agg(*aggregates)
        return out.withColumns({"window_start": F.unix_millis("w.start"), "window_end": F.unix_millis("w.end")}).drop("w")


@dataclass(frozen=True)
class Global:
    """One window for all time."""

    def assign(self, df: DataFrame, time: str) -> DataFrame:
        return df.withColumn("window_start", F.lit(-(1 << 63)).cast("long")).withColumn("window_end", F.lit((1 << 63) - 1).cast("long"))

    def of(self, time: int) -> list[tuple[int, int]]:
        return [(-(1 << 63), (1 << 63) - 1)]


def assigned(df: DataFrame, assigner, keys: Sequence[str], time: str) -> DataFrame:
    """Rows with window_start and window_end, once for each of their windows."""
    return assigner.assign(df, time, keys) if isinstance(assigner, Session) else assigner.assign(df, time)


def aggregate(df: DataFrame, assigner, keys: Sequence[str], time: str, *aggregates: Column) -> DataFrame:
    """keys, window_start, window_end and the aggregates."""
    if isinstance(assigner, Session):
        out = assigner.aggregate(df, keys, time, *aggregates)
    else:
        out = assigner.assign(df, time).groupBy(*keys, "window_start", "window_end").agg(*aggregates)
    own = [c for c in out.columns if c not in (*keys, "window_start", "window_end")]
    return out.select(*keys, "window_start", "window_end", *own)


def window_aggregate(df: DataFrame, assigner: Tumbling | Sliding, time: int, keys: Sequence[int], aggregates: Sequence[Aggregate], zero_if_none: bool = True) -> DataFrame:
    """By position: part_0.., the aggregates, window_start and window_end. Nulls are skipped; count is a long, others doubles.

    zero_if_none: sum, min and max of nulls only are 0. Rows without a time are left out.
    """

    def one(a: Aggregate) -> Column:
        x = col_at(df, a.column)
        name = a.function.lower()
        if name == "avg":
            raise ValueError("windows have no avg")
        if name == "count":
            return F.count(F.col(f"_in{a.column}")).alias(a.name)
        y = getattr(F, name)(F.col(f"_in{a.column}").cast("double"))
        return (F.coalesce(y, F.lit(0.0)) if zero_if_none else y).alias(a.name)

    inputs = {a.column for a in aggregates}
    rows = df.select(*[col_at(df, k).alias(f"part_{i}") for i, k in enumerate(keys)], col_at(df, time).cast("long").alias("_time"), *[col_at(df, c).alias(f"_in{c}") for c in sorted(inputs)])
    rows = assigner.assign(rows.where("_time is not null"), "_time")
    parts = [f"part_{i}" for i in range(len(keys))]
    out = rows.groupBy(*parts, "window_start", "window_end").agg(*[one(a) for a in aggregates])
    return out.select(*parts, *[a.name for a in aggregates], "window_start", "window_end")


#: Rows of a range of arrival, about.
RANGE_ROWS = 1 << 20


def on_time(df: DataFrame, time: str, arrival: Sequence[str], delay: int, bucket: int | None = None) -> DataFrame:
    """Rows that a watermark ``delay`` behind the largest time so far would keep, element by element in arrival order.

    A row is late if its time is at or below the largest earlier time less the delay. Late rows never raise the maximum, so it is a running
    maximum over all earlier rows, taken in two steps: over ranges of the first arrival column (a long), of which there are few, and within each range. No
    task gets more than a range, which is ``bucket`` wide, or so wide that it has about RANGE_ROWS rows.
    """
    if bucket is None:
        low, high, n = df.agg(F.min(arrival[0]), F.max(arrival[0]), F.count("*")).first()
        bucket = max(1, (high - low + 1) * RANGE_ROWS // n) if n and low is not None else 1
    rows = df.withColumn("_range", F.floor(F.col(arrival[0]) / F.lit(bucket)))
    tops = rows.groupBy("_range").agg(F.max(time).alias("_top"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(F.col("_range").alias("_of"), F.max("_top").over(before).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(tops, F.col("_range").eqNullSafe(F.col("_of"))).withColumn("_seen", F.greatest("_before", F.max(time).over(inside)))
    return rows.where(F.col("_seen").isNull() | (F.col(time) > F.col("_seen") - delay)).select(*df.columns)
