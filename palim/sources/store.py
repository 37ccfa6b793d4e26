"""Tables of the memory model as Parquet folders under numbered manifests: one commit may change several tables, and is seen whole or not at all."""

from __future__ import annotations

import functools
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; a cluster must name one."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="palim-")
    return f"{top.rstrip('/')}/palim-{uuid.uuid4().hex}"


def stored(table: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read again: what several parts of a plan read is made once."""
    path = scratch_folder(table.sparkSession)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


class ConcurrentWrite(Exception):
    """Another writer has committed since this one read."""


class Store:
    """A manifest names the folders of every table; the newest readable one holds. A table with a key has the last row of each key, so an upsert writes the changed rows only."""

    #: Folders of a table from which on it is written anew as one.
    MOST_FOLDERS = 24

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        path, fs = self._path("_commits")
        if not fs.exists(path):
            return []
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit())

    def _manifest_of(self, number: int) -> dict[str, list[str]] | None:
        path, fs = self._path("_commits", f"{number:08d}")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:  # a writer ended in the middle
            return None
        finally:
            stream.close()

    def manifest(self) -> tuple[int, dict[str, list[str]]]:
        """The number of the last commit (whole or not), and what the last whole one says."""
        numbers = self._numbers()
        for n in reversed(numbers):
            if (found := self._manifest_of(n)) is not None:
                return numbers[-1], found
        return numbers[-1] if numbers else 0, {}

    def _publish(self, number: int, tables: dict[str, list[str]]) -> None:
        path, fs = self._path("_commits", f"{number:08d}")
        try:
            stream = fs.create(path, False)
        except Exception as e:
            if "exist" in str(e).lower():
                raise ConcurrentWrite(f"commit {number} is there already") from e
            raise
        stream.write(bytearray(json.dumps(tables).encode()))
        stream.close()

    def commit(self, changes: dict[str, DataFrame], replace: tuple[str, ...] = (), base: int | None = None) -> None:
        """Adds rows to tables (or replaces their rows) in one step. base: the commit that the changes were made from; a later one is an error."""
        last, tables = self.manifest()
        if base is not None and last != base:
            raise ConcurrentWrite(f"commit {last} came after {base}")
        made = {name: f"{name}/{uuid.uuid4().hex}" for name in changes}
        try:
            for name, rows in changes.items():
                rows.write.parquet(f"{self.root}/{made[name]}")
            self._publish(last + 1, tables | {name: [*([] if name in replace else tables.get(name, [])), folder] for name, folder in made.items()})
        except BaseException:
            self._delete(made.values())
            raise
        self._forget(last)

    def _forget(self, last: int) -> None:
        """Commits before the last two go, with the folders that only they name."""
        kept = {f for n in (last, last + 1) if n for folders in (self._manifest_of(n) or {}).values() for f in folders}
        for n in self._numbers():
            if n < last:
                self._delete({f for folders in (self._manifest_of(n) or {}).values() for f in folders} - kept)
                self._delete([f"_commits/{n:08d}"])

    def _delete(self, folders) -> None:
        for f in folders:
            path, fs = self._path(f)
            fs.delete(path, True)

    def read(self, name: str, schema: T.StructType, key: str | None = None) -> DataFrame:
        folders = [f"{self.root}/{f}" for f in self.manifest()[1].get(name, [])]
        if not folders:
            return self.spark.createDataFrame([], schema)
        if key is None or len(folders) == 1:
            return self.spark.read.schema(schema).parquet(*folders)
        parts = [self.spark.read.schema(schema).parquet(f).withColumn("__at", F.lit(i)) for i, f in enumerate(folders)]
        rows = functools.reduce(DataFrame.unionByName, parts)
        latest = rows.groupBy(key).agg(F.max_by(F.struct(*schema.fieldNames()), "__at").alias("row"))
        return latest.select("row.*")

    def write(self, name: str, table: DataFrame) -> None:
        """The table's rows from now on."""
        self.commit({name: table}, (name,))

    def append(self, name: str, schema: T.StructType, rows: DataFrame) -> None:
        self.commit({name: rows.select(*[rows[f.name].cast(f.dataType) for f in schema.fields])})

    def compact(self, name: str, schema: T.StructType, key: str | None = None) -> None:
        """Writes a table of many folders anew as one."""
        base, tables = self.manifest()
        if len(tables.get(name, [])) > self.MOST_FOLDERS:
            self.commit({name: self.read(name, schema, key)}, (name,), base)
