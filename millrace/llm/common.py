"""What several operators need: a place for intermediate tables, rows of whole texts, bounded filters, words and shingles."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of bytes other than these; bytes.split() cuts at exactly the same six.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Distinct words that a Python worker remembers before it starts afresh.
CACHE_WORDS = 250_000
#: Rows and bytes of texts that a Python worker gets at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Bits of a filter that is sent to every executor: about ten for each key, and never more than 32 MB.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28


def shared_dir(spark: SparkSession) -> None:
    """Make checkpoint() usable: the cluster's own folder. A temporary one serves only a session that runs on this machine alone."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))


@contextmanager
def small_batches(spark: SparkSession):
    """Texts may be very long: what runs inside gets them in batches of bounded rows and bytes. The session's own settings come back."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    old = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """Compute df now, in small batches, and keep it in the shared checkpoint folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded rows for plans that run outside of :func:`cut`, with whatever settings the session has."""
    for b in batches:
        for low in range(0, max(1, b.num_rows), BATCH_ROWS):
            yield b.slice(low, BATCH_ROWS)


def tidied(task: Callable) -> Callable:
    """The same task, whose worker gives back at its end what it remembers and has freed: workers stay, and the next stages need the memory."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            release()

    return run


def release() -> None:
    _HASHES.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that :func:`cut` made and nothing needs any more."""
    spark = df.sparkSession
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Stands for a null id on the way through Python, where a column of longs with nulls would turn into floats.
NO_ID = (1 << 63) - 1


def sealed(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def opened(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(NO_ID))


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, text)."""
    return docs.select(sealed(id_col).alias("id"), F.col(text_col).alias("text"))


def wrapped(docs: DataFrame) -> DataFrame:
    """Rows (row): a struct of all columns, so that no helper column can clash with them; select("row.*") gives them back."""
    return docs.select(F.struct("*").alias("row"))


def row_key(id_: int, text: bytes) -> bytes:
    """16 bytes for the id and the whole text of a row: rows with one key are equal for every decision. Ids may be null or repeat."""
    return hashlib.sha256(id_.to_bytes(8, "little", signed=True) + text).digest()[:16]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Filter:
    """Bloom filter of 64-bit keys with four probes."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    def _at(self, keys: np.ndarray) -> np.ndarray:
        a = keys * np.uint64(0x9E3779B97F4A7C15)
        b = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1)
        return np.stack([((a + np.uint64(i) * b) >> np.uint64(20)) % np.uint64(self.bits) for i in range(4)])

    def add(self, keys: np.ndarray) -> None:
        at = self._at(keys).ravel()
        np.bitwise_or.at(self.data, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self._at(keys)
        return ((self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def key_numbers(keys) -> np.ndarray:
    """The first eight bytes of each of these byte strings as a number."""
    return np.frombuffer(b"".join(bytes(k[:8]).ljust(8, b"\0") for k in keys), ">u8").astype(np.uint64)


def sent_filter(keys: DataFrame, column: str, number: Callable = key_numbers):
    """A broadcast filter of this column's keys, and its bits: sized by a count, up to a bound. A full one lets rows through, and loses none."""
    spark, n = keys.sparkSession, keys.count()
    if 4 * n > MOST_BITS:  # more than four probes a bit would let nearly all through
        return spark.sparkContext.broadcast(b"\xff" * 8), 64
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (10 * n).bit_length()))
    schema = pa.schema([("bits", pa.binary())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = Filter(bits)
        for b in batches:
            test.add(number(b.column(0).to_pylist()))
        yield pa.RecordBatch.from_pydict({"bits": [test.data.tobytes()]}, schema)

    data = np.zeros(bits // 8, np.uint8)
    if n:  # filters of a million keys each, 64 at most, which pass through the driver one by one
        for r in keys.select(column).repartition(max(1, n >> 20)).mapInArrow(tidied(fill), "bits binary").toLocalIterator():
            data |= np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(data.tobytes()), bits


def kept_rows(docs: DataFrame, id_col: str, text_col: str, verdicts: DataFrame) -> DataFrame:
    """docs without the rows that verdicts (key binary, kept boolean) drop; a kept key keeps one of its equal rows.

    Only rows whose key passes a filter of the verdicts' keys are shuffled; all others stay where they are. A row whose key has no verdict stays.
    """
    sent, bits = sent_filter(verdicts, "key")
    keyed = docs.select(sealed(id_col).alias("id"), F.struct("*").alias("row"))
    place = docs.columns.index(text_col)
    schema = T.StructType([T.StructField("key", T.BinaryType()), keyed.schema["row"]])

    def part(through: bool) -> DataFrame:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = Filter(bits, np.frombuffer(sent.value, np.uint8))
            for b in sliced(batches):
                keys = [row_key(i, t or b"") for i, t in zip(b.column(0).to_pylist(), b.column(1).field(place).cast(pa.binary()).to_pylist())]
                may = test.has(key_numbers(keys)) if keys else np.empty(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column(1)], ["key", "row"]).filter(pa.array(may == through))

        return keyed.mapInArrow(tidied(task), schema)

    told = verdicts.groupBy("key").agg(F.bool_or("kept").alias("kept"))
    some = part(True).join(told, "key", "left").where("kept is null or kept")
    some = some.withColumn("own", F.when(F.col("kept").isNull(), F.monotonically_increasing_id())).dropDuplicates(["key", "own"])
    return part(False).select("row.*").unionByName(some.select("row.*"))


def join_by_size(rows: DataFrame, table: DataFrame, on: str, size: str, total: int) -> DataFrame:
    """rows joined with table, which has each key once and in column ``size`` how many rows have it; total: all rows.

    Keys of more than a ten-thousandth of all rows, of which there are 10,000 at most, are sent to every executor; the others are shuffled.
    """
    limit = max(1 << 12, total // 10_000)
    if total <= limit:
        return rows.join(table, on)
    hot = F.broadcast(table.where(F.col(size) > limit))
    return rows.join(hot, on).unionByName(rows.join(hot.select(on), on, "left_anti").join(table.where(F.col(size) <= limit), on))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


class WordHashes(dict):
    """Word to 64-bit hash. Forgets all words when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = WordHashes()
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def shingles(text: str | bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of so many lower-cased words (A-Z only). A shorter text is one run; no word, none.

    Two runs of one document share a hash with odds of about n * n / 2**65.
    """
    found = (text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")).lower().split()
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i : len(w) - k + 1 + i]) * _ODD[i % 4]
        h ^= h >> np.uint64(31)
    return np.unique(h * _ODD[1])
