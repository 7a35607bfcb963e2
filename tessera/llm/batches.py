"""Arrow batches in small parts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows that Spark hands to Python at a time.
ROWS, SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on Spark hands Python at most `ROWS` rows at a time in this session (its default is 10,000); a smaller setting stays.

    A batch is held by the executor's JVM and by the worker, a few times over while it is built and read. Rows of texts or features are kilobytes each.
    """
    now = int(spark.conf.get(SETTING))
    if not 0 < now <= ROWS:
        spark.conf.set(SETTING, str(ROWS))


def parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows, at most `rows` at a time: Python objects and results exist for one part only."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
