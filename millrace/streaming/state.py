"""Keyed state and timers over transformWithState: process functions, running reductions, custom triggers and functions of (record, state)."""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.reduce import Accumulator
from millrace.operators.windows import Session

CONTINUE, FIRE, PURGE, FIRE_AND_PURGE = "continue", "fire", "purge", "fire_and_purge"


#: Rows of a block that leaves a process function, and values of a key's state that are held at once.
BLOCK_ROWS, HELD = 1_000, 10_000
_ABSENT, _UNKNOWN = object(), object()


def _same(a, b) -> bool:
    return a is b or type(a) is type(b) and a == b


class _Value:
    """A value as it is now, and as the store has it."""

    def __init__(self, state):
        self.state, self.stored, self.now = state, _UNKNOWN, _UNKNOWN

    def get(self):
        if self.now is _UNKNOWN:
            got = self.state.get()
            self.stored = self.now = _ABSENT if got is None else got[0]
        return self.now

    def flush(self) -> None:
        if not _same(self.now, self.stored):
            self.state.clear() if self.now is _ABSENT else self.state.update((self.now,))
            self.stored = self.now


class _List:
    """A list, if it was read, and what the store lacks of it."""

    def __init__(self, state):
        self.state, self.now, self.added, self.anew = state, None, [], False

    def get(self) -> list:
        if self.now is None:
            self.now = [r[0] for r in self.state.get()] + self.added
        return self.now

    def append(self, x) -> None:
        self.added.append(x)
        if self.now is not None:
            self.now.append(x)

    def clear(self) -> None:
        self.now, self.added, self.anew = [], [], True

    def flush(self) -> None:
        if self.anew and not self.added:
            self.state.clear()
        elif self.added:
            (self.state.put if self.anew else self.state.appendList)([(x,) for x in self.added])
        self.added, self.anew = [], False


class _Map:
    """Entries as they are now, and as the store has them. whole: all entries are here."""

    def __init__(self, state):
        self.state, self.stored, self.now, self.whole, self.anew = state, {}, {}, False, False

    def get(self, key):
        if key not in self.now:
            got = None if self.whole else self.state.getValue((key,))
            self.stored[key] = self.now[key] = _ABSENT if got is None else got[0]
        return self.now[key]

    def all(self) -> dict:
        if not self.whole:
            for k, v in self.state.iterator():
                self.stored[k[0]] = v[0]
                self.now.setdefault(k[0], v[0])
            self.whole = True
        return {k: v for k, v in self.now.items() if v is not _ABSENT}

    def clear(self) -> None:
        self.stored, self.now, self.whole, self.anew = {}, {}, True, True

    def flush(self) -> None:
        if self.anew:
            self.state.clear()
        for k, v in self.now.items():
            if not _same(v, self.stored.get(k, _ABSENT if self.whole else _UNKNOWN)):
                self.state.removeKey((k,)) if v is _ABSENT else self.state.updateValue((k,), (v,))
        self.now = {k: v for k, v in self.now.items() if v is not _ABSENT or not self.whole}
        self.stored, self.anew = dict(self.now), False


class Context:
    """What a process function sees: state by name, timers, and collect().

    One serves all rows of a key in a micro-batch. Each access to the store is a message to another process, so state is read when it is first asked for, held, and written
    once behind the last row, or earlier when more than HELD values are held. With a time to live it is written after each row.
    """

    def __init__(self, processor: Keyed, times: Any):
        self._p, self.times, self.out, self._timers = processor, times, [], None
        self._forget()

    def _forget(self) -> None:
        self._held, self._seen = 0, {}

    def _state(self, kind: type, name: str):
        found = self._seen.get(name)
        if found is None:
            found = self._seen[name] = kind({_Value: self._p.values, _List: self._p.lists, _Map: self._p.maps}[kind][name])
        return found

    @property
    def watermark(self) -> int:
        return self.times.getCurrentWatermarkInMs()

    @property
    def now(self) -> int:
        return self.times.getCurrentProcessingTimeInMs()

    def value(self, name: str):
        x = self._state(_Value, name).get()
        return None if x is _ABSENT else x

    def set_value(self, name: str, x) -> None:
        self._state(_Value, name).now = x

    def clear(self, name: str) -> None:
        if name in self._p.values:
            self._state(_Value, name).now = _ABSENT
        else:
            self._state(_List if name in self._p.lists else _Map, name).clear()

    def items(self, name: str) -> list:
        s = self._state(_List, name)
        fresh = s.now is None
        got = s.get()
        self._held += len(got) * fresh
        return list(got)

    def append(self, name: str, x) -> None:
        self._state(_List, name).append(x)
        self._held += 1

    def lookup(self, name: str, key):
        s = self._state(_Map, name)
        self._held += key not in s.now
        x = s.get(key)
        return None if x is _ABSENT else x

    def put(self, name: str, key, x) -> None:
        s = self._state(_Map, name)
        self._held += key not in s.now
        s.now[key] = x

    def remove(self, name: str, key) -> None:
        s = self._state(_Map, name)
        self._held += key not in s.now
        s.now[key] = _ABSENT

    def entries(self, name: str) -> dict:
        s = self._state(_Map, name)
        before = len(s.now)
        got = s.all()
        self._held += len(s.now) - before
        return got

    def timers(self) -> set[int]:
        """The key's timers. The store has them as one value of 8 bytes each, and only the first of them is known to the engine."""
        if self._timers is None:
            got = self._p.pending.get()
            self._timers = set(array("q", bytes(got[0]))) if got else set()
            self._first = min(self._timers, default=None)
        return self._timers

    def register_timer(self, ms: int) -> None:
        self.timers().add(ms)

    def delete_timer(self, ms: int) -> None:
        self.timers().discard(ms)

    def collect(self, *row) -> None:
        missing = len(self._p.names) - len(row)
        if missing < 0:
            raise ValueError(f"{len(row)} values for {self._p.names}")
        self.out.append(row + (None,) * missing)

    def flush(self) -> None:
        for s in self._seen.values():
            s.flush()
        self._forget()

    def flush_timers(self, fired: int | None = None) -> None:
        """fired: the timer that the engine is about to delete."""
        if self._timers is None:
            return
        self._timers.discard(fired)
        first = min(self._timers, default=None)
        if first != self._first and self._first not in (None, fired):
            self._p.handle.deleteTimer(self._first)
        if first is not None and first != self._first:
            self._p.handle.registerTimer(first)
        self._p.pending.update((array("q", self._timers).tobytes(),)) if self._timers else self._p.pending.clear()

    def block(self) -> Row:
        rows, self.out = self.out, []
        return Row(_rows=pickle.dumps(rows, 5))


class Keyed(StatefulProcessor):
    """Calls process(key, row, context) for each row and on_timer(key, time, context) for each expired timer. Several keys are a tuple.

    values, lists: name to type; maps: name to (key type, value type). ttl_ms: how long state lasts without a change.
    """

    def __init__(self, process: Callable, on_timer: Callable | None = None, values: dict | None = None, lists: dict | None = None, maps: dict | None = None, ttl_ms: int | None = None):
        self.process, self.timer, self.kinds, self.ttl, self.several, self.names, self.by_events, self.held = process, on_timer, (values or {}, lists or {}, maps or {}), ttl_ms, False, [], False, HELD

    def key_of(self, key: tuple):
        return tuple(key) if self.several else key[0]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        values, lists, maps = self.kinds
        self.values = {n: handle.getValueState(n, f"v {t}", self.ttl) for n, t in values.items()}
        self.lists = {n: handle.getListState(n, f"v {t}", self.ttl) for n, t in lists.items()}
        self.maps = {n: handle.getMapState(n, f"k {k}", f"v {v}", self.ttl) for n, (k, v) in maps.items()}
        self.pending = handle.getValueState("_timers", "v binary") if self.timer else None

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        k, context = self.key_of(key), Context(self, timerValues)
        for row in rows:
            self.process(k, row, context)
            if self.ttl or context._held > self.held:
                context.flush()
            if len(context.out) >= BLOCK_ROWS:
                yield context.block()
        context.flush()
        context.flush_timers()
        if context.out:
            yield context.block()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        """All of the key's timers that have expired, in their order."""
        if not self.timer:
            return
        k, context, at = self.key_of(key), Context(self, timerValues), expiredTimerInfo.getExpiryTimeInMs()
        until = max(at, context.watermark if self.by_events else context.now)
        due = sorted({t for t in context.timers() if t <= until} | {at})
        context.timers().difference_update(due)
        for t in due:
            self.timer(k, t, context)
            if self.ttl or context._held > self.held:
                context.flush()
            if len(context.out) >= BLOCK_ROWS:
                yield context.block()
        context.flush()
        context.flush_timers(at)
        if context.out:
            yield context.block()

    def close(self) -> None:
        pass


def process(df: DataFrame, key: str | Sequence[str], processor: Keyed, schema: str, time_mode: str = "None", output_mode: str = "Append", order: Sequence[str] = ()) -> DataFrame:
    """order: a key's rows come in this order within a micro-batch; else in that of the shuffle, which is the file's only while one task reads and nothing spills.

    Streams have no sort of their own, so with an order the query must start without Spark's check for it (runs.run_to_end(ordered=True)).
    """
    keys, fields = [key] if isinstance(key, str) else list(key), T.StructType.fromDDL(schema)
    processor.names, processor.several, processor.by_events = fields.names, not isinstance(key, str), time_mode.lower() == "eventtime"
    if order:
        df = df.repartition(*keys).sortWithinPartitions(*keys, *order)  # dealt as the state is, so no shuffle follows that would undo the order
    blocks = df.groupBy(*keys).transformWithState(processor, outputStructType="_rows binary", outputMode=output_mode, timeMode=time_mode)
    nested = any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in fields)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(fields)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            if nested:
                named = Row(*fields.names)
                return pa.RecordBatch.from_pylist([named(*r).asDict(True) for r in rows], schema=kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

        rows: list[tuple] = []
        for b in batches:
            for block in b.column(0):
                rows += pickle.loads(block.as_py())
                if len(rows) >= HELD:
                    yield made(rows)
                    rows = []
        if rows:
            yield made(rows)

    return blocks.mapInArrow(unpack, fields)


def running_reduce(df: DataFrame, key: str, column: str, function: Callable, key_type: str, value_type: str, order: Sequence[str] = ()) -> DataFrame:
    """The accumulator after each row, in arrival order, which order says: key and value. Any function of two values; the first value is the start."""

    def step(k, row, context: Context) -> None:
        old = context.value("acc")
        new = row[column] if old is None else function(old, row[column])
        context.set_value("acc", new)
        context.collect(k, new)

    return process(df, key, Keyed(step, values={"acc": value_type}), f"{key} {key_type}, value {value_type}", order=order)


class Trigger:
    """When a window of a key gives a result: continue, fire (its rows stay and count again later), purge, or fire and purge. Override what is needed."""

    def on_element(self, count: int, time: int, start: int, end: int) -> str:
        """After a row was added; count: rows since the last purge."""
        return CONTINUE

    def on_event_time(self, watermark: int, start: int, end: int) -> str:
        """The key's watermark has passed the window's last millisecond; the window is closed afterwards in any case."""
        return FIRE

    def on_processing_time(self, now: int, start: int, end: int) -> str:
        """Called every so many milliseconds, if windowed was asked to."""
        return CONTINUE


class EachElement(Trigger):
    """A result after each row."""

    def on_element(self, count: int, time: int, start: int, end: int) -> str:
        return FIRE


class Count(Trigger):
    """A result after every n rows of a window, which starts afresh then."""

    def __init__(self, n: int):
        self.n = n

    def on_element(self, count: int, time: int, start: int, end: int) -> str:
        return FIRE_AND_PURGE if count >= self.n else CONTINUE


class Folded(Accumulator):
    """An accumulator from a function of two values; the first value is the start."""

    def __init__(self, function: Callable):
        self.function = function

    def create(self):
        return None

    def add(self, acc, value):
        return (value,) if acc is None else (self.function(acc[0], value),)

    def merge(self, a, b):
        return b if a is None else a if b is None else (self.function(a[0], b[0]),)

    def result(self, acc):
        return None if acc is None else acc[0]


def windowed(df: DataFrame, keys: Sequence[str], time: str, column: str, assigner, acc: Accumulator, result_type: str, delay: int = 0, trigger: Trigger | None = None, watermark: Callable[[int, int | None], int | None] | None = None, every_ms: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Windows that go element by element: keys, window_start, window_end, time (the window's last millisecond) and result.

    The watermark of a key is ``delay`` behind its largest time so far, or what watermark(time of a row, watermark so far) says; it never falls. A row at or below
    it is late and dropped. assigner: one of operators.windows, or any object whose of(time) lists (start, end). State holds one accumulator for each open window, and
    windows are looked through only when the first of them ends. every_ms: how often a trigger hears of processing time. order: of arrival within a micro-batch, as in process.
    """
    keys = list(keys)
    trigger = trigger or Trigger()
    merging = isinstance(assigner, Session) and assigner.merge

    def load(b: bytes) -> list:
        return pickle.loads(bytes(b))  # end, count, accumulator

    def emit(k, c: Context, start: int, end: int, state) -> None:
        c.collect(*k, start, end, end - 1, acc.result(state))

    def act(k, c: Context, said: str, start: int, end: int, count: int, state) -> tuple[int, Any]:
        if said in (FIRE, FIRE_AND_PURGE) and count:
            emit(k, c, start, end, state)
        return (0, acc.create()) if said in (PURGE, FIRE_AND_PURGE) else (count, state)

    def step(k, row, c: Context) -> None:
        t, old = row[time], c.value("watermark")
        if t is None or old is not None and t <= old:
            return
        first = c.value("first")
        for start, end in assigner.of(t):
            count, state = 0, acc.create()
            if merging:
                for s, b in sorted(c.entries("open").items()):
                    e, n, other = load(b)
                    if s <= end and start <= e:
                        start, end, count, state = min(start, s), max(end, e), count + n, acc.merge(state, other) if count else other
                        c.remove("open", s)
            elif (b := c.lookup("open", start)) is not None:
                end, count, state = load(b)
            count, state = count + 1, acc.add(state, row[column])
            count, state = act(k, c, trigger.on_element(count, t, start, end), start, end, count, state)
            c.put("open", start, pickle.dumps([end, count, state]))
            first = end - 1 if first is None else min(first, end - 1)
        told = watermark(t, old) if watermark else t - delay
        top = old if told is None else told if old is None else max(old, told)
        if top is not None and top != old:
            c.set_value("watermark", top)
        if first is not None and top is not None and top >= first:
            first = None
            for s, b in sorted(c.entries("open").items()):
                e, n, state = load(b)
                if top >= e - 1:
                    act(k, c, trigger.on_event_time(top, s, e), s, e, n, state)
                    c.remove("open", s)
                else:
                    first = e - 1 if first is None else min(first, e - 1)
        if first is None:
            c.clear("first")
        elif first != c.value("first"):
            c.set_value("first", first)
        if every_ms and c.value("ticking") is None:
            c.set_value("ticking", 1)
            c.register_timer(c.now + every_ms)

    def tick(k, at: int, c: Context) -> None:
        """Windows that are purged go; while others are there, the next tick is set."""
        left = False
        for s, b in sorted(c.entries("open").items()):
            e, n, state = load(b)
            n, state = act(k, c, trigger.on_processing_time(at, s, e), s, e, n, state)
            left = left or n > 0
            c.put("open", s, pickle.dumps([e, n, state])) if n else c.remove("open", s)
        if left:
            c.register_timer(at + every_ms)
        else:
            c.clear("ticking")

    values = {"watermark": "long", "first": "long"} | ({"ticking": "int"} if every_ms else {})
    keyed = Keyed(step, tick if every_ms else None, values=values, maps={"open": ("long", "binary")})
    return process(df, keys, keyed, f"{_fields(df, keys)}, window_start long, window_end long, time long, result {result_type}", "ProcessingTime" if every_ms else "None", order=order)


def still_open(spark: SparkSession, checkpoint: str, keys: Sequence[str], acc: Accumulator, result_type: str) -> DataFrame:
    """End of input: results, as :func:`windowed` gives them, of the windows that a stopped query has left open, from the state in its checkpoint."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "open").load()
    kept = state.select("key.*", F.col("user_map_key.k").alias("window_start"), F.col("user_map_value.v").alias("_state"))
    kept = kept.toDF(*keys, "window_start", "_state")

    def close(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            loaded = [pickle.loads(bytes(b)) for b in f["_state"]]
            out = f[[*keys, "window_start"]].copy()
            out["window_end"], out["time"] = [x[0] for x in loaded], [x[0] - 1 for x in loaded]
            out["result"] = [acc.result(x[2]) for x in loaded]
            yield out[[x[1] > 0 for x in loaded]]

    return kept.mapInPandas(close, f"{_fields(kept, keys)}, window_start long, window_end long, time long, result {result_type}")


def _fields(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def with_state(df: DataFrame, key: str, function: Callable[[Row, bytes | None], tuple[list[tuple], bytes | None]], schema: str) -> DataFrame:
    """A pure function (record, state) -> (records, state); state is bytes of its own, one for each key."""

    def step(k, row, context: Context) -> None:
        records, state = function(row, context.value("state"))
        if state is None:
            context.clear("state")
        else:
            context.set_value("state", state)
        for r in records:
            context.collect(*r)

    return process(df, key, Keyed(step, values={"state": "binary"}), schema)


def verify_deterministic(function: Callable, samples: list[tuple], times: int = 2) -> None:
    """Raise if a function of (record, state) gives different results for the same arguments."""
    for record, state in samples:
        first = function(record, state)
        if any(function(record, state) != first for _ in range(times)):
            raise ValueError(f"not deterministic for {record!r}")
