"""Expressions by column position, with the null and division rules of the operators.

Nulls propagate through arithmetic and comparison, AND and OR are three-valued, integers divide to integers, and doubles divide as IEEE 754
says (no error by zero).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG_MIN = -(1 << 63)


def col_at(df: DataFrame, index: int) -> Column:
    if not 0 <= index < len(df.columns):
        raise IndexError(f"column {index} of {len(df.columns)}")
    return F.col(f"`{df.columns[index]}`") if df.columns.count(df.columns[index]) == 1 else df[index]


def div_long(a: Column, b: Column) -> Column:
    """Integer quotient, cut toward zero; division by zero is an error."""
    return F.call_function("div", a, b)


def div_double(a: Column, b: Column) -> Column:
    """IEEE 754: x / 0 is infinite with the sign of both, 0 / 0 is not a number."""
    a, b = a.cast("double"), b.cast("double")
    inf = F.lit(float("inf"))
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).otherwise(F.when((a > 0) == ~b.cast("string").startswith("-"), inf).otherwise(-inf))
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, zero).otherwise(F.try_divide(a, b))


OPS = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b, "neq": lambda a, b: a != b, "and": lambda a, b: a & b, "or": lambda a, b: a | b,
}


def build(df: DataFrame, spec: dict) -> Column:
    """A column from nested dicts: {"col": i}, {"lit": v}, {"op": name, "args": [...]}; op may be one of OPS, div, not, is_null or is_not_null."""
    if "col" in spec and "op" not in spec:
        return col_at(df, spec["col"])
    if "lit" in spec:
        return F.lit(spec["lit"])
    args = [build(df, a) for a in spec["args"]]
    op = spec["op"]
    if op in ("not", "is_null", "is_not_null"):
        return {"not": lambda a: ~a, "is_null": Column.isNull, "is_not_null": Column.isNotNull}[op](*args)
    if op == "div":
        kinds = [df.select(a).schema[0].dataType.simpleString() for a in args]
        return div_long(*args) if all(k in ("bigint", "int", "smallint", "tinyint") for k in kinds) else div_double(*args)
    if op not in OPS:
        raise ValueError(f"unknown operator {op}")
    return OPS[op](*args)


def predicate(df: DataFrame, spec: dict | None) -> Column:
    """A filter from {"op": "gt" | "gte" | "lt", "col": i, "val": n}; without one, all rows whose first column isn't null."""
    if not spec or spec.get("op") in (None, "pass_all"):
        return col_at(df, 0) >= LONG_MIN
    if spec["op"] not in ("gt", "gte", "lt"):
        raise ValueError(f"unknown predicate {spec['op']}")
    return OPS[spec["op"]](col_at(df, spec["col"]), F.lit(spec["val"]))
