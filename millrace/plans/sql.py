"""SQL over registered tables: everything the session's SQL can do, or a small strict subset.

The strict subset is one statement of table scans with aliases, WHERE, projections, and GROUP BY plain columns with exactly one SUM of a plain column, which is a double. Anything else is an error there.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

STRICT_NODES = {"Project", "Filter", "SubqueryAlias", "Aggregate", "UnresolvedRelation", "View", "LogicalRDD", "LocalRelation", "Relation", "LogicalRelation", "Range", "RelationV2"}


class SqlError(ValueError):
    pass


def statements(text: str) -> list[str]:
    """Statements between semicolons that are outside of quotes and comments."""
    out, part = [], []
    for token in re.findall(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^;'\"`\-/]+|.", text, re.S):
        if token == ";":
            out.append("".join(part))
            part = []
        elif not token.startswith(("--", "/*")):
            part.append(token)
    out.append("".join(part))
    return [s.strip() for s in out if s.strip()]


class SqlContext:
    def __init__(self, spark: SparkSession, strict: bool = False):
        self.spark, self.strict = spark, strict

    def register(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)

    def register_batches(self, name: str, batches: Iterable[pa.RecordBatch]) -> None:
        batches = list(batches)
        if not batches:
            raise SqlError(f"table {name} has no batches, so its schema is unknown")
        self.register(name, self.spark.createDataFrame(pa.Table.from_batches(batches)))

    def sql(self, text: str) -> DataFrame:
        found = statements(text)
        if len(found) != 1:
            raise SqlError(f"expected one statement, found {len(found)}")
        df = self.spark.sql(found[0])
        return self._strict(df) if self.strict else df

    def _strict(self, df: DataFrame) -> DataFrame:
        """Check the analyzed plan; sums become doubles."""
        plan = df._jdf.queryExecution().analyzed()
        sums = self._walk(plan)
        for name in sums:
            df = df.withColumn(name, df[name].cast("double"))
        return df

    def _walk(self, node) -> list[str]:
        name = node.nodeName()
        if name not in STRICT_NODES and "Relation" not in name:
            raise SqlError(f"{name} is outside the strict subset")
        sums: list[str] = []
        if name == "Aggregate":
            if node.groupingExpressions().isEmpty():
                raise SqlError("an aggregate needs keys")
            out = node.aggregateExpressions()
            for k in range(node.groupingExpressions().length()):
                if node.groupingExpressions().apply(k).nodeName() != "AttributeReference":
                    raise SqlError("keys must be plain columns")
            calls = [out.apply(k) for k in range(out.length()) if out.apply(k).nodeName() != "AttributeReference"]
            text = [c.sql() for c in calls if "sum(" in c.sql().lower() or "(" in c.sql()]
            if len(text) != 1 or not re.match(r"(?i)^sum\([^()+*/%-]+\)( AS .*)?$", text[0]):
                raise SqlError("exactly one SUM of a plain column is allowed")
            sums.append(calls[[c.sql() for c in calls].index(text[0])].name())
        if name in ("View", "SubqueryAlias") and name == "View":
            return sums  # what a table is made of doesn't matter
        for k in range(node.children().length()):
            sums += self._walk(node.children().apply(k))
        return sums
