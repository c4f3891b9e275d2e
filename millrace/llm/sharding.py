"""Shards of near equal bytes by sampled splitters.

Records are ordered by (CRC-32 of the text, hash of the id, id), so equal texts stand together. A sample of the keys, drawn by
hash with odds in proportion to size, gives quantile boundaries; a record's range is found by binary search among them.
Ranges that turn out to hold much more than their part are subdivided at quantiles of their own sample, until none is or
the boundaries no longer split it. Byte totals of the ranges, a bounded list, are then added up, and prefix sums inside each range place
every record on the line from 0 to the total; shards are equal parts of that line. Only ids, sizes and checksums are
shuffled, and a text that fills a third of all rows is spread over many ranges by the hash of the id (rows without an id by where they are read,
which is fixed by a checkpoint).

Built-in expressions only. Defined cases: a null text has size 16 and CRC-32 0 like an empty one; a null id sorts first
within its key; repeated rows are records of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common

OVERHEAD = 16
#: Sampled keys for each range, and ranges for each shard: together they bound what the driver holds.
SAMPLE = 64
RANGES = 8
#: Rows in a range, about, when there are many.
RANGE_ROWS = 1 << 20
MOST_RANGES = 1 << 14
#: Times its part that a range may hold, besides its largest record. So fewer than a third of the ranges are ever subdivided.
OVERFULL = 3


def _position(crc: Column, id_: Column) -> Column:
    """CRC-32 and 20 bits of the id's hash as one number below 2**52; rows with a null id are told apart by where they are read."""
    return (crc * F.lit(1 << 20) + F.shiftrightunsigned(F.xxhash64(F.coalesce(id_, -F.monotonically_increasing_id())), 44)).cast("double")


def _quantiles(df: DataFrame, rate: float, n: int) -> list[float]:
    """Boundaries of n parts of near equal bytes, from a sample with odds of size * rate (large records count more than once)."""
    draw = F.shiftrightunsigned(F.xxhash64("id", "crc", F.lit(7)), 11) / F.lit(float(1 << 53))
    times = F.floor(F.col("size") * F.lit(rate) + draw).cast("long")
    sample = df.select("position", F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
    at = sample.agg(F.percentile_approx("position", [k / n for k in range(1, max(2, n))], 100 * n).alias("q")).first()["q"]
    return sorted(set(at or []))


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: shards of near equal total size, slots gapless from 0 in key order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    rows = common.cut(rows.withColumn("position", _position(F.col("crc"), F.col("id"))))
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    n = min(MOST_RANGES, max(shards * RANGES, (count or 0) // RANGE_ROWS))
    inner = _quantiles(rows, SAMPLE * n / max(1, total or 0), n)
    while True:
        ranged = Bucketizer(splits=[float("-inf"), *(inner or [0.0]), float("inf")], inputCol="position", outputCol="range").transform(rows)
        sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.max("size").alias("top")).orderBy("range").collect()
        over = [r["range"] for r in sums if r["bytes"] > OVERFULL * total / n + r["top"]]
        finer = set(_quantiles(ranged.where(F.col("range").isin(over)), 4 * SAMPLE * n / total, 4 * len(over) + 1)) if over else set()
        if finer <= set(inner):
            break
        inner = sorted({*inner, *finer})

    base, placed = 0, []
    for r in sums:
        placed.append((r["range"], base))
        base += r["bytes"]
    starts = F.broadcast(docs.sparkSession.createDataFrame(placed, "range double, base long"))
    in_range = Window.partitionBy("range").orderBy("crc", "position", "id", "size")
    before = F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    rows = ranged.join(starts, "range", "left").withColumn("before", F.col("base") + before)
    shard = F.least(F.lit(shards - 1), F.floor((F.col("before") + F.col("size") / 2) * shards / F.lit(max(1, total or 0)))).cast("int")
    rows = common.cut(rows.withColumn("shard", shard).withColumn("row", F.row_number().over(in_range)))
    # The first row of each shard within each range, and how many rows of the shard lie in earlier ranges: at most ranges + shards pieces.
    pieces = rows.groupBy("shard", "range").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first"))
    rows = rows.join(F.broadcast(pieces.select("shard", "range", "offset")), ["shard", "range"])
    return rows.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") + F.col("offset")).cast("long").alias("slot"))
