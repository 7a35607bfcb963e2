"""Versioned tables: every change writes a new snapshot and then adds a pointer to it."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Seconds after which an empty pointer counts as left behind.
PATIENCE = 600.0


class Conflict(Exception):
    """Somebody else published in the meantime."""


class Catalog:
    """Tables under a folder that the cluster shares. A table is its newest pointer; older snapshots stay for undo."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointer(self, table: str) -> str:
        return f"{self.folder}/{table}/_versions"

    def _files(self, path: str):
        made = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return made.getFileSystem(self.spark._jsc.hadoopConfiguration()), made

    def _pointers(self, table: str) -> dict[int, object]:
        fs, path = self._files(self._pointer(table))
        return {int(s.getPath().getName()): s for s in fs.listStatus(path) if s.getPath().getName().isdigit()} if fs.exists(path) else {}

    def version(self, table: str) -> int:
        """0 before the first snapshot. A pointer without content is one that is being written, or whose writer died: it doesn't count."""
        return max((n for n, s in self._pointers(table).items() if s.getLen()), default=0)

    def _folder(self, table: str, version: int) -> str:
        """The folder that a version's pointer names."""
        named = self.spark.read.text(f"{self._pointer(table)}/{version}").first()
        return f"{self.folder}/{table}/{named.value}"

    def read(self, table: str, schema: str, version: int | None = None) -> DataFrame:
        """The table at a version, or an empty one of the schema; columns that a snapshot lacks are null."""
        at = self.version(table) if version is None else version
        if not at:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._folder(table, at))

    def publish(self, table: str, df: DataFrame, expected: int | None = None) -> int:
        """Writes df as the next version. With `expected`, only if that is still the newest.

        Rows are written to a folder of their own first. What decides is the pointer file of the next number: it is created only if there
        is none, so that of two publishers who start from one version one gets a Conflict. A pointer that has stayed empty for
        longer than PATIENCE was left by a writer that died; it is cleared away. A writer reads its pointer back, and takes what
        it doesn't find as a Conflict. This needs a store that creates a file for one writer only, as HDFS and local disks do; on an
        object store without such a create let one application publish.
        """
        before = self.version(table) if expected is None else expected
        name = f"rows-{uuid.uuid4().hex}"
        df.write.mode("error").parquet(f"{self.folder}/{table}/{name}")
        fs, pointer = self._files(f"{self._pointer(table)}/{before + 1}")
        try:
            if self.version(table) != before:
                raise Conflict(table)
            started = self._pointers(table).get(before + 1)
            if started is not None and not started.getLen() and time.time() - started.getModificationTime() / 1000 > PATIENCE:
                fs.delete(pointer, False)
            out = fs.create(pointer, False)  # refuses a pointer that is there
        except Exception as error:
            fs.delete(self._files(f"{self.folder}/{table}/{name}")[1], True)
            if isinstance(error, Conflict) or fs.exists(pointer):
                raise Conflict(table) from error
            raise
        out.write(bytearray(name.encode()))
        out.close()
        if self._folder(table, before + 1) != f"{self.folder}/{table}/{name}":
            raise Conflict(table)
        return before + 1

    def undo(self, table: str, schema: str) -> int:
        """The version before the newest becomes the newest again, as a snapshot of its own."""
        now = self.version(table)
        return self.publish(table, self.read(table, schema, now - 1) if now > 1 else self.spark.createDataFrame([], schema), now)


def stage(catalog: Catalog, table: str, schema: str, key: str, version: list[str], wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> int:
    """Computes what is stale and publishes the union with what isn't; returns the number of computed rows."""
    from .scopes import stale
    from .tables import upsert

    at = catalog.version(table)
    done = catalog.read(table, schema, at) if at else catalog.spark.createDataFrame([], schema)
    todo = stale(wanted, done, key, version)
    n = todo.count()
    if n:
        catalog.publish(table, upsert(done, compute(todo).select(*done.columns), [key]), at)
    return n


def stage_in_parts(catalog: Catalog, table: str, schema: str, key: str, version: list[str], wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], rows: int = 3000) -> int:
    """stage(), with what is stale computed in parts of some `rows` rows, each kept as soon as it is done; returns the number of computed rows.

    A run that stops half way leaves its finished parts under the table's `_pending` folder; the next run counts them as done and only computes
    the rest. A part counts once its writer has finished it. The table itself is published once, at the end, from the parts and what it
    held; a part that has been published is removed. Later runs' parts go before earlier ones', and before the table.
    """
    from .scopes import stale
    from .tables import upsert

    spark, folder = catalog.spark, f"{catalog.folder}/{table}/_pending"
    fs, path = catalog._files(folder)
    at = catalog.version(table)
    done = catalog.read(table, schema, at)
    earlier = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
    runs: dict[str, list[str]] = {}
    for name in earlier:
        for part in fs.listStatus(catalog._files(f"{folder}/{name}")[1]):
            if fs.exists(catalog._files(f"{folder}/{name}/{part.getPath().getName()}/_SUCCESS")[1]):
                runs.setdefault(name, []).append(f"{folder}/{name}/{part.getPath().getName()}")
    for name in sorted(runs):
        done = upsert(done, spark.read.schema(schema).parquet(*runs[name]), [key])
    todo = written(stale(wanted, done, key, version))
    n = todo.count()
    now = f"{1 + max((int(x) for x in earlier), default=0):09d}"
    parts = -(-n // rows)
    mine = []
    for i in range(parts):
        mine.append(f"{folder}/{now}/{i}")
        compute(todo.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i)).select(*done.columns).write.parquet(mine[-1])
    if mine:
        done = upsert(done, spark.read.schema(schema).parquet(*mine), [key])
    if n or runs:
        catalog.publish(table, done, at)
        fs.delete(path, True)
    return n


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one on a single machine without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: the plan ends there, and lost executors cost a re-read."""
    path = f"{shared_folder(df.sparkSession)}/tessera/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stamp(df: DataFrame, column: str) -> DataFrame:
    """Count and largest value: changes whenever rows come or go or are touched."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.max(column).alias("latest"))
