"""Streams over tables that are there already: run to their end, or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame


def written(rows: DataFrame, given: str, out: str, checkpoint: str) -> DataFrame:
    """``rows``, a stream with a row for each one of the table at ``given``, written to ``out`` and read back.

    The stream is waited for however long it takes, as after a time limit a part of the rows would look like the result.
    A stream that fails raises its error; one that ended without all rows, since it was stopped or passed some over, is an
    error too.
    """
    spark = rows.sparkSession
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.parquet(out)
    came, due = done.count(), spark.read.parquet(given).count()
    if came != due:
        raise RuntimeError(f"the stream ended with {came} of {due} rows")
    return done
