"""Incremental intake of carrier lines: an extension; the batch operators apply to each new part.

Lines stream in as files, are classified once, and go to a table of rows and one of rejects; a line sent
again within the watermark is dropped by its file, number and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.operators import malformed

LINES = "line_id bigint, file_name string, line_no int, raw_line string, received_at timestamp_ntz"


def lines(spark: SparkSession, folder: str, schema: str = LINES, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def once(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Lines without those sent again within the delay; state older than it is let go."""
    timed = stream.withColumn("received_at", F.col("received_at").cast("timestamp"))
    return timed.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["file_name", "line_no", "raw_line"])


def start(stream: DataFrame, rows_path: str, rejects_path: str, checkpoint: str, once_only: bool = True) -> StreamingQuery:
    """Writes typed rows and rejects; a batch that is run again overwrites its own part, so nothing is doubled."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            malformed.loaded(batch, "raw_line").write.mode("overwrite").parquet(f"{rows_path}/batch={number}")
            malformed.rejected(batch, "raw_line").write.mode("overwrite").parquet(f"{rejects_path}/batch={number}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once_only else writer).start()


def reject_rates(stream: DataFrame, window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """(start, reason, n): rejects by time of receipt and reason; late lines count until the watermark."""
    timed = stream.withColumn("received_at", F.col("received_at").cast("timestamp")).withWatermark("received_at", delay)
    bad = malformed.rejected(timed, "raw_line")
    return bad.groupBy(F.window("received_at", window).alias("w"), "reason").agg(F.count(F.lit(1)).alias("n")).select("w.start", "reason", "n")
