"""Filters, projections, grouped aggregates and equi-joins over DataFrames, addressed by position or by name.

All are compositions of built-in operators, so predicates and columns are pushed into scans, aggregates are partial before they are shuffled, and
joins are planned, spilled and re-planned by the engine.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.expressions import col_at

JOINS = ("inner", "left", "right", "full")


@dataclass(frozen=True)
class Aggregate:
    """function: sum, count, min, max or avg of the column at a position, under a name."""

    function: str
    column: int
    name: str

    def __post_init__(self):
        if self.function.lower() not in ("sum", "count", "min", "max", "avg"):
            raise ValueError(f"unknown aggregate function {self.function}")


def where(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows for which all conditions are true; null is not true."""
    for c in conditions:
        df = df.where(c)
    return df


def project(df: DataFrame, columns: Sequence[int | tuple[Column, str] | tuple[Column, str, str]]) -> DataFrame:
    """Columns by position, or (expression, name) or (expression, name, type); a declared type must be the one computed."""
    out = df.select(*[col_at(df, c) if isinstance(c, int) else c[0].alias(c[1]) for c in columns])
    for c, field in zip(columns, out.schema):
        if not isinstance(c, int) and len(c) == 3 and field.dataType.simpleString() != c[2]:
            raise TypeError(f"{c[1]} is {field.dataType.simpleString()}, declared as {c[2]}")
    return out


def hash_aggregate(df: DataFrame, keys: Sequence[int], aggregates: Sequence[Aggregate], nulls_are_zero: bool = False) -> DataFrame:
    """Groups by position: columns group_<i>, then the aggregates as doubles.

    nulls_are_zero: a null counts, and adds, as 0. Without keys there is one row, or none for no input.
    """

    def one(a: Aggregate) -> Column:
        x = col_at(df, a.column)
        if nulls_are_zero:
            x = F.coalesce(x.cast("double"), F.lit(0.0))
        if a.function.lower() == "count":
            return F.count(x).cast("double").alias(a.name)
        return getattr(F, a.function.lower())(x.cast("double")).alias(a.name)

    found = [one(a) for a in aggregates]
    if keys:
        return df.groupBy(*[col_at(df, k).alias(f"group_{k}") for k in keys]).agg(*found)
    return df.agg(*found, F.count("*").alias("_rows")).where("_rows > 0").drop("_rows")


def grouped_sum(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Sum of a column as a double for each key; nulls are skipped."""
    if not keys:
        raise ValueError("keys must not be empty")
    return df.groupBy(*keys).agg(F.sum(F.col(column).cast("double")).alias(name))


def hash_join(build: DataFrame, probe: DataFrame, build_keys: Sequence[int], probe_keys: Sequence[int], how: str = "inner", null_safe: bool = False, prefix: str = "probe_") -> DataFrame:
    """Columns of build, then of probe. left keeps all of build, right all of probe, full both.

    Probe columns whose name build has get a prefix. null_safe: a null key equals a null key.
    """
    if how not in JOINS:
        raise ValueError(f"unknown join type {how}")
    if not build_keys or len(build_keys) != len(probe_keys):
        raise ValueError("keys of both sides must pair up")
    probe = probe.toDF(*[prefix + c if c in build.columns else c for c in probe.columns])
    condition = None
    for b, p in zip(build_keys, probe_keys):
        left, right = build[build.columns[b]], probe[probe.columns[p]]
        this = left.eqNullSafe(right) if null_safe else left == right
        condition = this if condition is None else condition & this
    return build.join(probe, condition, how)


def split_by_hash(df: DataFrame, keys: Sequence[str], parts: int) -> DataFrame:
    """Column part: the partition that rows go to by key."""
    if parts < 1:
        raise ValueError("parts must be at least 1")
    return df.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))


def assigned_partitions(partitions: DataFrame, parallelism: int, subtask: int, column: str = "partition") -> DataFrame:
    """The source partitions of a subtask: those equal to it modulo the parallelism."""
    if parallelism < 1 or not 0 <= subtask < parallelism:
        raise ValueError("subtask must be in 0 .. parallelism - 1")
    return partitions.where(F.pmod(F.col(column), F.lit(parallelism)) == subtask)
