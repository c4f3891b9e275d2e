"""Operators from JSON: {"type": "filter" | "hash_aggregate" | "hash_join" | "window_aggregate", ...} with columns by position."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from millrace.functions.expressions import predicate
from millrace.operators.relational import JOINS, Aggregate, hash_aggregate, hash_join
from millrace.operators.windows import Sliding, Tumbling, window_aggregate

#: Ids of operators that a plan may name besides registered ones.
BUILTIN = "builtin::"


class Registry:
    """Named plan steps; an id must be registered or start with builtin::, followed by an operator's type."""

    def __init__(self):
        self.known: dict = {}

    def register(self, name: str, build) -> None:
        if name in self.known:
            raise ValueError(f"{name} is registered already")
        self.known[name] = build

    def build(self, name: str, df: DataFrame, spec: dict) -> DataFrame:
        if name in self.known:
            return self.known[name](df, spec)
        if name.startswith(BUILTIN):
            return run(df, {**spec, "type": name.removeprefix(BUILTIN)})
        raise KeyError(f"operator {name} isn't registered")


def _aggregates(spec: dict) -> list[Aggregate]:
    return [Aggregate(a["function"].lower(), a["input_col"], a["output_name"]) for a in spec["aggregates"]]


def run(df: DataFrame, spec: dict | str, other: DataFrame | None = None) -> DataFrame:
    """One operator over df; a join has df as its build and other as its probe side."""
    spec = json.loads(spec) if isinstance(spec, str) else spec
    kind = spec.get("type")
    if kind == "filter":
        return df.where(predicate(df, spec.get("predicate")))
    if kind == "hash_aggregate":
        return hash_aggregate(df, spec["group_by_cols"], _aggregates(spec))
    if kind == "hash_join":
        how = spec.get("join_type", "inner").lower() or "inner"
        if how not in JOINS:
            raise ValueError(f"unknown join type {how}")
        return hash_join(df, other, spec["build_key_cols"], spec["probe_key_cols"], how)
    if kind == "window_aggregate":
        w = spec["window_type"]
        assigner = {"tumbling": lambda: Tumbling(w["size_ms"]), "sliding": lambda: Sliding(w["size_ms"], w["slide_ms"])}[w["kind"]]()
        return window_aggregate(df, assigner, spec["event_time_col"], spec["partition_cols"], _aggregates(spec))
    raise ValueError(f"unknown operator type {kind}")


def run_all(df: DataFrame, specs: list[dict]) -> DataFrame:
    for s in specs:
        df = run(df, s)
    return df
