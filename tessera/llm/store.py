"""Where operators keep intermediate tables.

A cluster names a folder that driver and executors share in spark.checkpoint.dir.
Intermediate results are written there as Parquet and read back: the lineage ends at
the files, so that a lost executor costs a re-read and not a recomputation. Only where the
setting is absent and the master is local (tests on one machine) a temporary folder takes its place; on a
cluster without the setting, which would scatter tables over machines, an error says so. `drop_written` deletes
what a session has written.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back; options are the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Deletes every table that this application has written, once no result that reads them is wanted any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/tessera/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by Spark's own reader, so that any store Spark reaches will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with its columns other than doc_id and text under names of their own (_own_0, ...), and what gives the names back."""
    names = {f.name if f.name in ("doc_id", "text") else f"_own_{i}": f.name for i, f in enumerate(docs.schema.fields)}
    plain = docs.select(*(F.col(f"`{name}`").alias(alias) for alias, name in names.items()))
    return plain, lambda df: df.select(*(F.col(alias).alias(name) for alias, name in names.items()))


def hash_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, those of least hash of the key. Rows with larger hashes are sorted out before the sort, so
    that what tasks send stays near `most` in all, however many tasks there are."""
    share = min(1.0, 1.2 * most / max(1, df.count()) + 1e-6)
    near = df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))
    return near.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 30)), key).limit(most)
