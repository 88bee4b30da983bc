"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where the session has none and runs in one process (tests) a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="catalume-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: what reads it twice does not compute it twice, and lost executors lose nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table that ``keep`` made and that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for file in df.inputFiles()[:1]:
        folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def stamp(spark: SparkSession, *paths: str) -> tuple:
    """What tells the state of stored tables: each file's name, length and time of change."""
    context, found = spark.sparkContext, []
    for path in paths:
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(context._jsc.hadoopConfiguration())
        found += sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in system.listStatus(folder))
    return (context.applicationId, tuple(found))


def once(spark: SparkSession, name: str, paths: tuple[str, ...], make) -> str:
    """The folder that ``make(folder)`` filled from the tables at ``paths``; made again only if they have changed."""
    key = (name, stamp(spark, *paths))
    if key not in _made:
        folder = new_path(spark, name)
        make(folder)
        _made[key] = folder
    return _made[key]
