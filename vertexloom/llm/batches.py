"""How many rows Python gets at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Texts in an Arrow batch. With the default of 10,000, a batch of long documents takes hundreds of MB beside the heap.
ROWS = 1_000
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ROWS rows. It holds from then on, since plans run after an operator returns."""
    held = int(spark.conf.get(_KEY))
    if held <= 0 or held > ROWS:
        spark.conf.set(_KEY, str(ROWS))
