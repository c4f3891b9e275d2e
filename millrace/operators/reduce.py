"""Keyed reductions: final, running, in arrival order, and by accumulator."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Associative and commutative reductions, which aggregate before they are shuffled.
NAMED = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "avg": F.avg}


def reduce_by(df: DataFrame, keys: Sequence[str], column: str, function: str, name: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(NAMED[function](column).alias(name or column))


def running(df: DataFrame, keys: Sequence[str], column: str, function: str, arrival: Sequence[str], name: str = "running") -> DataFrame:
    """An output for each input: the reduction of the key's rows up to this one."""
    w = Window.partitionBy(*keys).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, NAMED[function](column).over(w))


def last_by(df: DataFrame, keys: Sequence[str], column: str, arrival: str, name: str | None = None) -> DataFrame:
    """The value that arrived last, for each key."""
    return df.groupBy(*keys).agg(F.max_by(column, arrival).alias(name or column))


def fold(df: DataFrame, keys: Sequence[str], column: Column, arrival: Sequence[str], merge: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """Left fold in arrival order with any expression of two columns; a key's first element is the start.

    A key's elements are held together, as an order that can't be exchanged demands.
    """
    items = F.array_sort(F.collect_list(F.struct(*arrival, column.alias("_v"))))
    got = df.groupBy(*keys).agg(items.alias("_items"))
    values = F.transform("_items", lambda s: s["_v"])
    return got.select(*keys, F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1), merge).alias(name))


class Accumulator:
    """A user's aggregate: create, add, merge and result."""

    def create(self):
        raise NotImplementedError

    def add(self, acc, value):
        raise NotImplementedError

    def merge(self, a, b):
        raise NotImplementedError

    def result(self, acc):
        raise NotImplementedError


def accumulate(df: DataFrame, keys: Sequence[str], column: str, acc: Accumulator, result_type: str, name: str = "result") -> DataFrame:
    """A user's aggregate in two steps: each task folds what it reads (state of one entry for each key seen, flushed when there are many), then partial states merge by key."""
    import pickle

    fields = [df.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    limit = 100_000

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}

        def out() -> pd.DataFrame:
            rows = [(*k, pickle.dumps(v)) for k, v in states.items()]
            states.clear()
            return pd.DataFrame(rows, columns=[*keys, "_state"])

        for f in frames:
            for row in f[[*keys, column]].itertuples(index=False, name=None):
                k = tuple(None if pd.isna(x) else x for x in row[:-1])
                states[k] = acc.add(states[k] if k in states else acc.create(), row[-1])
            if len(states) > limit:
                yield out()
        if states:
            yield out()

    def final(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        states = [pickle.loads(b) for b in frame["_state"]]
        total = states[0]
        for s in states[1:]:
            total = acc.merge(total, s)
        return pd.DataFrame([(*(None if pd.isna(k) else k for k in group), acc.result(total))], columns=[*keys, name])

    states = df.select(*keys, column).mapInPandas(partial, f"{schema}, _state binary")
    return states.groupBy(*keys).applyInPandas(final, f"{schema}, `{name}` {result_type}")
