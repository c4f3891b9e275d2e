"""Kafka through Spark's own connector, where its jar is present, and a model of manual offsets.

Options are checked here, without the jar. Offsets of a running query live in its checkpoint; :class:`Offsets` is for code that keeps its own.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Offsets:
    """Next offset to read for each (topic, partition)."""

    next: dict[tuple[str, int], int] = field(default_factory=dict)

    def mark(self, topic: str, partition: int, offset: int) -> None:
        """A record was processed; marks never go back."""
        key = (topic, partition)
        self.next[key] = max(self.next.get(key, 0), offset + 1)

    def snapshot(self) -> str:
        """JSON as the connector's startingOffsets takes it."""
        out: dict[str, dict[str, int]] = {}
        for (topic, partition), offset in sorted(self.next.items()):
            out.setdefault(topic, {})[str(partition)] = offset
        return json.dumps(out)

    @classmethod
    def restore(cls, text: str) -> Offsets:
        return cls({(t, int(p)): o for t, parts in json.loads(text).items() for p, o in parts.items()})


def source_options(servers: str, topic: str, starting: Offsets | str = "earliest", most_per_trigger: int | None = None) -> dict[str, str]:
    if not servers or not topic:
        raise ValueError("servers and topic are needed")
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting.snapshot() if isinstance(starting, Offsets) else starting, "failOnDataLoss": "true"}
    return out | ({"maxOffsetsPerTrigger": str(most_per_trigger)} if most_per_trigger else {})


def read(spark: SparkSession, options: dict[str, str], streaming: bool = True) -> DataFrame:
    return (spark.readStream if streaming else spark.read).format("kafka").options(**options).load()


def records(df: DataFrame, key: Column, value: Column, partition: Column | None = None) -> DataFrame:
    """Columns as the sink takes them; with a partition, records go there whatever their key."""
    out = df.select(key.cast("binary").alias("key"), value.cast("binary").alias("value"), *([partition.cast("int").alias("partition")] if partition is not None else []))
    return out


def write(df: DataFrame, servers: str, topic: str, checkpoint: str):
    """At least once; consumers that need more drop repeated keys."""
    return df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def parallel_read(partitions: DataFrame, parallelism: int) -> DataFrame:
    """Column subtask: partition modulo parallelism."""
    return partitions.withColumn("subtask", F.pmod("partition", F.lit(parallelism)))
