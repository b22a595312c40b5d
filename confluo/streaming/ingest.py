"""Archives or rows that arrive in a folder, taken in as they come.

Late rows need no watermark here: every batch is appended as it is, and the best row of a station and day is picked
when the table is read (:func:`confluo.operators.streamflow.best_rows`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d, files_at_once: int = 500) -> StreamingQuery:
    """Append what is new in a folder of Parquet files to ``target``, ``files_at_once`` at a time, and end when there is no more.

    A batch is written to a folder of its own number and replaces it if it runs again, so a restart repeats none.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_at_once)).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
