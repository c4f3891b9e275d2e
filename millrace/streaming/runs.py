"""Run streaming plans to the end of bounded input: one folder for each micro-batch, so batch ids are checkpoint ids."""

from __future__ import annotations

import json
import uuid
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The year 9999 in milliseconds: where a mark of the end of input stands.
END_MS = 253_370_764_800_000


#: Rows of a file, at most about.
FILE_ROWS = 1 << 20


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_parts(df: DataFrame, order: list[str], positions: list[int], folder: str, end: str | None = None) -> int:
    """A folder of files for the rows before, between and behind these positions in the order; returns how many. All folders have the same number of files, some of them
    empty, so that read_parts makes a micro-batch of each. The order is that of files sorted by ranges, so no task gets more than a range or FILE_ROWS.

    end: a column of milliseconds. One more folder has a row with the largest time that timestamps have there, and nulls elsewhere: it marks the end of input, carries the
    watermark past all windows of other rows. Its own window stays open, but for sessions that aren't merged. Positions are sorted and distinct; one behind the last row is an error.
    """
    spark, whole = df.sparkSession, f"{folder}-sorted"
    try:
        df.orderBy(*order).write.parquet(whole)
        found = spark.read.schema(df.schema).parquet(whole).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n")).collect()
        files, n = [], 0
        for name, k in sorted((tuple(r) for r in found), key=lambda x: (int(x[0].split("-")[1]), x[0])):
            files.append((name, n, n + k))
            n += k
        positions = sorted(set(positions))
        if positions and (positions[0] < 0 or positions[-1] > n):
            raise ValueError(f"position {positions[-1]} is outside of 0 .. {n}")
        edges = [0, *positions, n]
        parts = [(a, b) for a, b in zip(edges, edges[1:]) if b > a]
        each = max([1, *(-(-(b - a) // FILE_ROWS) for a, b in parts)])
        for made, (a, b) in enumerate(parts):
            own = [f for f in files if f[1] < b and f[2] > a]
            starts = F.broadcast(spark.createDataFrame([f[:2] for f in own], "_name string, _start long"))
            rows = spark.read.schema(df.schema).parquet(*[f"{whole}/{f[0]}" for f in own]).select("*", F.col("_metadata.file_name").alias("_name"), F.col("_metadata.row_index").alias("_at"))
            rows = rows.join(starts, "_name").withColumn("_row", F.col("_start") + F.col("_at")).where(f"_row >= {a} and _row < {b}").withColumn("_file", F.expr(f"int((_row - {a}) * {each} div {b - a})"))
            _write(rows.repartitionById(each, "_file").sortWithinPartitions("_row").select(*df.columns), f"{folder}/{made:06d}", each - min(each, b - a))
    finally:
        path, fs = _path(spark, whole)
        fs.delete(path, True)
    if end is not None:
        mark = df.limit(0).unionByName(spark.range(1).select(F.lit(END_MS).alias(end)), allowMissingColumns=True)
        _write(mark.select(*[F.col(f.name).cast(f.dataType) for f in df.schema]).coalesce(1), f"{folder}/{len(parts):06d}", each - 1)
    return len(parts) + (end is not None)


def _write(df: DataFrame, folder: str, empty: int) -> None:
    df.write.mode("append").parquet(folder)
    for _ in range(empty):
        df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(folder)


def read_parts(spark: SparkSession, schema: str, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of these folders; a micro-batch takes as many files as the first folder has."""
    if files_per_trigger is None:
        path, fs = _path(spark, folder)
        first = min((s.getPath() for s in fs.listStatus(path) if s.isDirectory()), key=lambda p: p.getName())
        files_per_trigger = sum(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(first))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/*")


def run_to_end(df: DataFrame, checkpoint: str, mode: str = "append", ordered: bool = False) -> tuple[DataFrame, list[int], list[dict]]:
    """Process what is there, then stop: all rows that came out, completed batch ids and progress reports.

    Appended rows go to files beside the checkpoint; other modes, whose results are aggregates, to memory. ordered: the plan sorts rows within micro-batches
    (state.process(order=...)), which Spark's check of plans refuses although it runs them, so the query starts without that check.
    """
    name, folder = f"out_{uuid.uuid4().hex}", f"{checkpoint}-out"
    out = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    conf, check = df.sparkSession.conf, "spark.sql.streaming.unsupportedOperationCheck"
    before = conf.get(check, "true")
    try:
        conf.set(check, "false" if ordered else before)
        query = out.format("parquet").option("path", folder).start() if mode == "append" else out.format("memory").queryName(name).start()
    finally:
        conf.set(check, before)
    query.awaitTermination()
    progress = [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]
    rows = df.sparkSession.read.schema(df.schema).parquet(folder) if mode == "append" else df.sparkSession.table(name)
    return rows, [p["batchId"] for p in progress if p["numInputRows"]], progress
