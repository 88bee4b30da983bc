"""Cutting lineage and shipping code: what every operator here needs from the session."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parents[1]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session has none and runs in this process alone (local
    tests) a folder of our own is set; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="catalume-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written files survive lost executors, and what reads them twice does
    not compute ``df`` twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` made and that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for file in df.inputFiles()[:1]:
        folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_or_not(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` (a few short columns), broadcast if it was counted to have ``rows`` rows at most; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= rows else df


def ship_package(spark: SparkSession) -> None:
    """Let executors import this package even where it is not installed (once per context).

    Where nobody has said how many rows Python workers get at once, it is set to 2,048, as rows are whole texts; a number
    that the session was given, the usual 10,000 too, stays.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "-7") == "-7":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    if getattr(context, "_catalume_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="catalume-code-")
    target = os.path.join(folder, "catalume_code.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(_PACKAGE.rglob("*.py")):
            archive.write(file, str(file.relative_to(_PACKAGE.parent)))
    context.addPyFile(target)
    context._catalume_shipped = True


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, whose task gives memory that it no longer needs back to the machine; a worker that is used again would keep it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def rank_in_cells(df: DataFrame, cells: list[str], order: list[str], rows_a_part: int = 250_000, dealt: int = 64) -> tuple[DataFrame, DataFrame]:
    """Exact 0-based ranks inside each cell without sorting a cell in one task.

    Cells are counted first. Each is dealt by a hash of the ``order`` columns
    over as many parts as its rows need at ``rows_a_part`` each, and over up to
    ``dealt`` before that (a part for each thousand rows); parts are counted
    (partially before the shuffle) and a row's rank is its part's offset plus
    its place in the part. Returns ``df`` with ``sub`` and ``place`` and the
    table of parts (cells, sub, rows, before): at most distinct cells x
    ``dealt`` and one for each ``rows_a_part`` rows.
    """
    from pyspark.sql import Window

    counted = materialize(df.groupBy(*cells).agg(F.count("*").alias("_rows")), "cells")
    parts = F.greatest(F.ceil(F.col("_rows") / rows_a_part), F.least(F.lit(dealt), F.ceil(F.col("_rows") / 1000)))
    sized = df.join(F.broadcast(counted.select(*cells, parts.cast("int").alias("_parts"))), cells)
    with_sub = sized.withColumn("sub", F.pmod(F.xxhash64(*order), F.col("_parts")).cast("int")).drop("_parts")
    parts = with_sub.groupBy(*cells, "sub").agg(F.count("*").alias("rows"))
    running = Window.partitionBy(*cells).orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("rows").over(running), F.lit(0)))
    inside = Window.partitionBy(*cells, "sub").orderBy(*order)
    return with_sub.withColumn("place", F.row_number().over(inside) - 1), materialize(parts, "parts")
