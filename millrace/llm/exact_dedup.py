"""Exact duplicates by a log-structured merge index of digests.

Texts count as equal when they agree after all of space, tab, newline, vertical tab, form feed and return are deleted.

1. Each task feeds digests to an :class:`Index`: a memtable takes entries until it is full and is then flushed as a run,
   sorted by digest, with a Bloom filter. A digest that a filter lets through is searched for in that run. When there are
   too many runs they are compacted to one; an entry keeps the largest original and, among these, the smallest id. An index that
   has grown to HELD entries leaves its task as a run of the table, and the task starts another, so memory is bounded.
2. The tasks' runs are cut by digest range; ranges are compacted across tasks. A digest has few entries from each task, so a very
   frequent text is no hot spot.
3. Hits, that is rows of digests that occur more than once, receive byte verification: a task passes on the bytes of a digest once for
   each kind of bytes it sees, and a digest's smallest and largest bytes must be the same. Digests that fail (possible with a short digest
   only) are grouped by their whole SHA-256.

Defined cases: a null text is empty and equals all texts of white space only. A null id comes after all others. Rows that
repeat an id with an equal text are members like others; each repetition of the id that stays is marked as kept, unless
:func:`drop_duplicates` is used, which leaves one row of each text, whatever ids repeat or are null. An empty table gives an empty result. Other columns are ignored, or
passed through by :func:`drop_duplicates`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.common import Filter
from millrace.llm.common import key_numbers as _keys

MEMTABLE = 65_536
RUNS = 4
#: Entries with which an index leaves its task, and about as many rows are compacted together across tasks.
HELD = 1 << 20
#: Bytes of texts that a task remembers while it verifies, to pass on what differs only.
REMEMBERED = 1 << 25
_BLANK = common.SPACES.encode()
_CONTINUED = bytes(range(0x80, 0xC0))
_ORDER = ["digest", "chars", "id", "key"]


def compact(runs: list[pd.DataFrame]) -> pd.DataFrame:
    """One run: an entry for each digest, sorted, with the largest original, then the smallest id and key, and the number of rows."""
    rows = pd.concat(runs, ignore_index=True)
    rows = rows.sort_values(_ORDER, ascending=[True, False, True, True], kind="stable", ignore_index=True)
    first = ~rows["digest"].duplicated()
    out = rows[first].reset_index(drop=True)
    out["n"] = rows.groupby((first.cumsum() - 1).to_numpy())["n"].sum().to_numpy()
    return out


class Index:
    """Log-structured merge index: digest to (chars, id, key, n)."""

    def __init__(self, memtable: int = MEMTABLE, runs: int = RUNS):
        self.memtable, self.most, self.limit = {}, runs, memtable
        self.runs: list[tuple[pd.DataFrame, Filter]] = []

    def put(self, digest: bytes, chars: int, id_: int, key: bytes = b"") -> None:
        old = self.memtable.get(digest)
        if old is None:
            if len(self.memtable) >= self.limit:
                self.flush()
            self.memtable[digest] = (-chars, id_, key, 1)
        else:
            self.memtable[digest] = (*min(old[:3], (-chars, id_, key)), old[3] + 1)

    def __len__(self) -> int:
        return sum(len(r) for r, _ in self.runs) + len(self.memtable)

    def flush(self) -> None:
        """Entries that an earlier run has are merged into it; the others become a run."""
        if not self.memtable:
            return
        new = pd.DataFrame([(d, -c, i, k, n) for d, (c, i, k, n) in self.memtable.items()], columns=[*_ORDER, "n"])
        new = new.sort_values("digest", ignore_index=True)
        self.memtable = {}
        for k, (run, seen) in enumerate(self.runs):
            hit = seen.has(_keys(new["digest"]))
            hit[hit] = new["digest"][hit].isin(run["digest"])
            if hit.any():
                self.runs[k] = (compact([run, new[hit]]), seen)
                new = new[~hit]
        if len(new):
            self._add(new.reset_index(drop=True))
        if len(self.runs) > self.most:
            merged = compact([r for r, _ in self.runs])
            self.runs = []
            self._add(merged)

    def _add(self, run: pd.DataFrame) -> None:
        seen = Filter(max(64, 1 << (10 * len(run)).bit_length()))
        seen.add(_keys(run["digest"]))
        self.runs.append((run, seen))

    def close(self) -> pd.DataFrame | None:
        """All entries as one run; the index is empty then."""
        self.flush()
        out, self.runs = compact([r for r, _ in self.runs]) if self.runs else None, []
        return out


_ENTRY = "range int, digest binary, chars long, id long, key binary, n long"


def _runs(ranges: int, memtable: int):
    def ranged(run: pd.DataFrame) -> pd.DataFrame:
        run.insert(0, "range", [d[0] * ranges >> 8 if len(d) < 4 else int.from_bytes(d[:4], "big") * ranges >> 32 for d in run["digest"]])
        return run

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(memtable)
        for f in frames:
            for digest, chars, id_, key in zip(f["digest"], f["chars"].tolist(), f["id"].tolist(), f["key"]):
                index.put(bytes(digest), chars, id_, bytes(key))
            if len(index) >= HELD:
                yield ranged(index.close())
        if (run := index.close()) is not None:
            yield ranged(run)

    return task


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    return compact([rows[[*_ORDER, "n"]]])


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, key, sha of the text without white space, and code points of the original."""
    for b in batches:
        found = [t or b"" for t in b.column(1).to_pylist()]
        keys = [common.row_key(i, t) for i, t in zip(b.column(0).to_pylist(), found)]
        sha = [hashlib.sha256(t.translate(None, _BLANK)).digest() for t in found]
        chars = [len(t) if t.isascii() else len(t.translate(None, _CONTINUED)) for t in found]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(sha, pa.binary()), pa.array(chars, pa.int64())], ["id", "key", "sha", "chars"])


def _hits(sent, bits: int, digest_bytes: int):
    """Digests that may occur more than once, with the bytes of their texts: what a task has seen it doesn't pass on again."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test, seen, size = Filter(bits, np.frombuffer(sent.value, np.uint8)), {}, 0
        for b in batches:
            bare = [(t or b"").translate(None, _BLANK) for t in b.column(0).to_pylist()]
            digest = [hashlib.sha256(x).digest()[:digest_bytes] for x in bare]
            out = []
            for k in np.flatnonzero(test.has(_keys(digest))) if digest else ():
                if seen.get(digest[k]) != bare[k]:
                    out.append(k)
                    if digest[k] not in seen and size < REMEMBERED:
                        seen[digest[k]] = bare[k]
                        size += len(bare[k]) + 100
            yield pa.RecordBatch.from_arrays([pa.array([digest[k] for k in out], pa.binary()), pa.array([bare[k] for k in out], pa.binary())], ["digest", "bare"])

    return task


def _grouped(docs: DataFrame, id_col: str, text_col: str, digest_bytes: int, memtable: int) -> DataFrame:
    """id, key, sha, keep_id, keep_key and group_size of every row."""
    spark = docs.sparkSession
    rows = docs.select(common.sealed(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    slim = common.cut(rows.mapInArrow(common.tidied(_profiles), "id long, key binary, sha binary, chars long"))
    slim = slim.withColumn("digest", F.substring("sha", 1, digest_bytes))
    total = slim.count()
    ranges = max(common.partitions(spark), total // HELD) if digest_bytes >= 4 else 1
    entries = slim.select("id", "digest", "chars", "key").mapInPandas(common.tidied(_runs(ranges, memtable)), _ENTRY)
    index = common.cut(entries.groupBy("range").applyInPandas(_merge, "digest binary, chars long, id long, key binary, n long"))
    index = index.select("digest", F.col("id").alias("keep_id"), F.col("key").alias("keep_key"), F.col("n").alias("group_size"))
    out = common.join_by_size(slim, index, "digest", "group_size", total)

    # Byte verification: digests whose smallest and largest bytes differ.
    many = index.where("group_size > 1")
    sent, bits = common.sent_filter(many, "digest")
    hits = rows.select("text").mapInArrow(common.tidied(_hits(sent, bits, digest_bytes)), "digest binary, bare binary")
    wrong = common.cut(hits.groupBy("digest").agg(F.min("bare").alias("low"), F.max("bare").alias("high")).where("low <> high").select("digest"))
    if not wrong.isEmpty():
        again = slim.join(wrong, "digest", "left_semi").groupBy("sha").agg(F.min(F.struct(-F.col("chars"), "id", "key")).alias("best"), F.count("*").alias("own_n"))
        out = out.join(again, "sha", "left")
        own = {"keep_id": F.coalesce("best.id", "keep_id"), "keep_key": F.coalesce("best.key", "keep_key"), "group_size": F.coalesce("own_n", "group_size")}
        out = out.withColumns(own)
    return out.select("id", "key", "sha", "keep_id", "keep_key", "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 16, memtable: int = MEMTABLE) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    out = _grouped(docs, id_col, text_col, digest_bytes, memtable)
    return out.select(common.opened("id").alias("doc_id"), common.opened("keep_id").alias("keep_id"), "group_size", (F.col("id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns: the longest, then that of the smallest id, then that of the smallest hash.

    Null ids and ids that repeat with different texts are no groups: each text stays once. Rows with a null id go if a row with an id has a text as long.
    """
    found = _grouped(docs, id_col, text_col, 16, MEMTABLE).where("group_size > 1")
    return common.kept_rows(docs, id_col, text_col, common.cut(found.select("key", (F.col("key") == F.col("keep_key")).alias("kept")).distinct()))


ORACLE = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as h from documents
), k as (
  select doc_id, h, first_value(doc_id) over (partition by h order by chars desc, doc_id) as keep_id, count(*) over (partition by h) as n from d
)
select doc_id, keep_id, cast(n as bigint) as group_size, doc_id = keep_id as kept, h as text_sha256 from k
"""
