"""A table of immutable snapshots with two-phase commit.

Data files of an epoch are written under a folder that no snapshot names; a commit publishes a manifest in one atomic rename, under the next snapshot's number, that lists
the folders of all epochs so far. Readers see the last manifest. Files lie on any Hadoop file system.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class SnapshotTable:
    def __init__(self, spark: SparkSession, warehouse: str, database: str, table: str):
        self.spark, self.root = spark, f"{warehouse.rstrip('/')}/{database}/{table}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._util = jvm.org.apache.commons.io.IOUtils
        self._charset = jvm.java.nio.charset.StandardCharsets.UTF_8

    def create(self, schema: str) -> SnapshotTable:
        self.fs.mkdirs(self._path(f"{self.root}/snapshots"))
        self._write(f"{self.root}/schema", schema, new=True)
        return self

    def _write(self, path: str, text: str, new: bool) -> None:
        """Write beside and rename, so a reader sees all or nothing; the rename fails if the name is taken."""
        at = self._path(f"{path}.{uuid.uuid4().hex}")
        out = self.fs.create(at)
        out.write(bytearray(text.encode()))
        out.close()
        if new and self.fs.exists(self._path(path)) or not self.fs.rename(at, self._path(path)):
            self.fs.delete(at, False)
            raise FileExistsError(path)

    def _read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self._util.toString(stream, self._charset)
        finally:
            stream.close()

    @property
    def schema(self) -> str:
        return self._read(f"{self.root}/schema")

    def snapshots(self) -> list[int]:
        found = self.fs.listStatus(self._path(f"{self.root}/snapshots"))
        return sorted(int(f.getPath().getName()) for f in found if f.getPath().getName().isdigit())

    def manifest(self, snapshot: int | None = None) -> dict:
        number = snapshot if snapshot is not None else max(self.snapshots(), default=0)
        return json.loads(self._read(f"{self.root}/snapshots/{number}")) if number else {"epoch": -1, "folders": []}

    def scan(self, snapshot: int | None = None) -> DataFrame:
        """Rows of the last snapshot, or of the one asked for."""
        folders = self.manifest(snapshot)["folders"]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/{f}" for f in folders])

    def publish(self, epoch: int, folders: list[str]) -> int:
        """A snapshot with these folders added; nothing if the epoch is in already."""
        last = self.manifest()
        number = max(self.snapshots(), default=0)
        if epoch <= last["epoch"]:
            return number
        self._write(f"{self.root}/snapshots/{number + 1}", json.dumps({"epoch": epoch, "folders": last["folders"] + folders}), new=True)
        return number + 1


class TwoPhaseSink:
    """open a transaction, write batches, pre-commit under a rising epoch, then commit or abort.

    A prepared epoch is a file that names its folders, so a sink that is made anew after a crash finds it and can commit or abort it.
    """

    guarantee = "two_phase_commit"

    def __init__(self, table: SnapshotTable):
        self.table = table
        self.open: list[str] | None = None
        self.pending: dict[int, list[str]] = {e: json.loads(table._read(self._file(e))) for e in self._prepared()}

    def _file(self, epoch: int) -> str:
        return f"{self.table.root}/prepared/{epoch}"

    def _prepared(self) -> list[int]:
        folder = self.table._path(f"{self.table.root}/prepared")
        if not self.table.fs.exists(folder):
            self.table.fs.mkdirs(folder)
        names = [f.getPath().getName() for f in self.table.fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def _done(self, epoch: int) -> None:
        self.table.fs.delete(self.table._path(self._file(epoch)), False)

    def begin(self) -> None:
        if self.open is not None:
            raise RuntimeError("a transaction is open already")
        self.open = []

    def write(self, df: DataFrame) -> None:
        if self.open is None:
            raise RuntimeError("no transaction is open")
        folder = uuid.uuid4().hex
        df.write.parquet(f"{self.table.root}/data/{folder}")
        self.open.append(folder)

    def pre_commit(self, epoch: int) -> None:
        if self.open is None:
            raise RuntimeError("no transaction is open")
        if epoch <= max([self.table.manifest()["epoch"], *self.pending]):
            raise ValueError(f"epoch {epoch} doesn't rise")
        self.table._write(self._file(epoch), json.dumps(self.open), new=True)
        self.pending[epoch], self.open = self.open, None

    def commit(self, up_to: int) -> list[int]:
        """Publish all prepared epochs up to this one, in order."""
        done = [e for e in sorted(self.pending) if e <= up_to]
        for e in done:  # a crash in between publishes an epoch that is in already, which does nothing
            self.table.publish(e, self.pending.pop(e))
            self._done(e)
        return done

    def abort(self) -> None:
        """Drop the open transaction and all prepared epochs, with their files."""
        for folder in [*(self.open or []), *[f for folders in self.pending.values() for f in folders]]:
            self.table.fs.delete(self.table._path(f"{self.table.root}/data/{folder}"), True)
        for e in self.pending:
            self._done(e)
        self.open, self.pending = None, {}

    @property
    def pending_epochs(self) -> list[int]:
        return sorted(self.pending)


def write_stream(df: DataFrame, table: SnapshotTable, checkpoint: str, available_now: bool = True):
    """A streaming query that publishes a snapshot for each micro-batch, exactly once: a batch that runs again finds its epoch published, and its first files are named by no snapshot."""

    def each(batch: DataFrame, epoch: int) -> None:
        if epoch > table.manifest()["epoch"]:
            folder = f"{epoch}-{uuid.uuid4().hex}"
            batch.write.parquet(f"{table.root}/data/{folder}")
            table.publish(epoch, [folder])

    out = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
