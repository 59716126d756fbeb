"""Versioned Parquet tables: atomic overwrite (S4) and insert-once batches.

A table is a folder of data folders and of small manifests, one a version.  A manifest
lists the data folders that make up its version and the batches that are in it; it is
created, never changed, so publishing one is the only step that readers can see.

* ``overwrite`` writes its rows to a new folder first, then publishes.  Readers see the
  old table or the new one, never an empty one, and the rows may be computed from the
  table itself.
* ``insert_once`` adds a batch's new keys under the batch's name.  Given again, or tried
  again after a failure, it changes nothing: rows of a try that was not published lie in
  a folder that no manifest names.
* Two writers at once: only one can create the next manifest; the other reads that
  version and decides its new keys again.

The writes are Spark jobs (a lost executor's tasks run again, the commit protocol drops
partial files); the manifest is the only thing the driver writes, through the same file
system as the data.
"""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quality import mark_new_keys

TRIES = 20
# HDFS refuses to move a file onto another; a local file system does not, so writers of one
# driver take turns there.
_TURN = threading.Lock()


class Conflict(RuntimeError):
    """Another writer published the version first."""


@dataclass
class Version:
    number: int
    folders: list[str]
    batches: dict[str, int]          # batch -> rows it inserted
    schema: str


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._bytes = jvm.org.apache.commons.io.IOUtils

    # --- manifests ---

    def _manifest(self, number: int) -> str:
        return f"{self.path}/_versions/{number:012d}.json"

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/_versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def version(self, number: int | None = None) -> Version | None:
        """A version (the last one by default), or None if there is none yet."""
        numbers = self._numbers()
        if number is None:
            number = numbers[-1] if numbers else None
        if number not in numbers:
            return None
        stream = self._fs.open(self._path(self._manifest(number)))
        try:
            told = json.loads(bytes(self._bytes.toByteArray(stream)).decode())
        finally:
            stream.close()
        return Version(number, told["folders"], told["batches"], told["schema"])

    def _publish(self, version: Version) -> None:
        """Write the manifest beside its place and move it there; the move fails if the place is taken."""
        told = json.dumps({"folders": version.folders, "batches": version.batches, "schema": version.schema})
        staged, place = self._path(f"{self.path}/_versions/.{uuid.uuid4().hex}"), self._path(self._manifest(version.number))
        out = self._fs.create(staged, True)
        try:
            out.write(bytearray(told.encode()))
        finally:
            out.close()
        with _TURN:
            done = not self._fs.exists(place) and self._fs.rename(staged, place)
        if not done:
            self._fs.delete(staged, False)
            raise Conflict(f"version {version.number} of {self.path} exists")

    # --- data ---

    def read(self, number: int | None = None) -> DataFrame:
        v = self.version(number)
        if v is None:
            raise FileNotFoundError(f"no version {'' if number is None else number} of {self.path}")
        schema = T.StructType.fromJson(json.loads(v.schema))
        if not v.folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in v.folders])

    def _write(self, df: DataFrame, partitions: int | None) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        (df if partitions is None else df.coalesce(partitions)).write.parquet(f"{self.path}/{folder}")
        return folder

    def overwrite(self, df: DataFrame, partitions: int | None = None) -> int:
        """The next version holds exactly ``df``; the batches known so far stay known."""
        folder = self._write(df, partitions)
        for _ in range(TRIES):
            last = self.version()
            following = Version(last.number + 1 if last else 1, [folder], last.batches if last else {}, df.schema.json())
            try:
                self._publish(following)
                return following.number
            except Conflict:
                continue
        raise Conflict(f"{self.path}: {TRIES} tries")

    def insert_once(self, batch: DataFrame, key: str, name: str, order: list[str] | None = None) -> int:
        """Add the batch's rows of new keys, the first of each key; the number of rows it inserted, also
        when the batch is in the table already."""
        for _ in range(TRIES):
            last = self.version()
            if last is None:
                raise FileNotFoundError(f"no table at {self.path}")
            if name in last.batches:
                return last.batches[name]
            columns = self.read(last.number).columns
            new = mark_new_keys(self.read(last.number), batch.select(*columns), key, order=order).filter(F.col("outcome") == "inserted")
            folder = self._write(new.select(*columns), None)
            n = self.spark.read.parquet(f"{self.path}/{folder}").count()
            folders = last.folders + ([folder] if n else [])
            try:
                self._publish(Version(last.number + 1, folders, last.batches | {name: n}, last.schema))
                return n
            except Conflict:
                continue
        raise Conflict(f"{self.path}: {TRIES} tries")

    def compact(self, partitions: int | None = None) -> int:
        """The same rows in one folder."""
        return self.overwrite(self.read(), partitions)

    def prune(self, keep: int = 2) -> list[str]:
        """Delete the manifests before the last ``keep`` versions and the data folders that only they name,
        or that no version names (failed tries).  Run it when no writer is at work."""
        numbers = self._numbers()
        named = {f for n in numbers[-keep:] for f in self.version(n).folders}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(self._manifest(n)), False)
        data = self._path(f"{self.path}/data")
        found = [f"data/{s.getPath().getName()}" for s in self._fs.listStatus(data)] if self._fs.exists(data) else []
        gone = sorted(set(found) - named)
        for f in gone:
            self._fs.delete(self._path(f"{self.path}/{f}"), True)
        return gone
