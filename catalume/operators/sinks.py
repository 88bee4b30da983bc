"""Where results go: appended records, quarantine, tables that are replaced as a whole."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.operators import vectors


def append_records(records: DataFrame, path: str) -> None:
    """Raw records (raw) as they are, a line each, behind what is there."""
    records.select("raw").write.mode("append").text(path)


def append_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines behind what is there: failures, evaluation runs, answers, cache entries."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def replace_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines instead of what is there: the quarantine of one run."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


class Conflict(Exception):
    """Another writer committed a state behind the one that this writer began from."""


#: Seconds that a marker may be there without its content before its writer counts as dead.
CLAIM_SECONDS = 5.0


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _markers(spark: SparkSession, path: str) -> dict[int, str]:
    """Number -> name of the folder with the state's rows; empty where a marker has no content (yet)."""
    place, system = _at(spark, f"{path}/current")
    listed = [f.getPath() for f in system.listStatus(place)] if system.exists(place) else []
    read = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString
    return {int(f.getName()): read(system.open(f), "UTF-8") for f in listed if f.getName().isdigit()}


def versions(spark: SparkSession, path: str) -> dict[int, str]:
    """The committed states of a table: number -> folder."""
    return {n: f"{path}/{name}" for n, name in sorted(_markers(spark, path).items()) if name}


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The state that was committed last; None before the first."""
    known = versions(spark, path)
    return spark.read.parquet(known[max(known)]) if known else None


def _claim(spark: SparkSession, path: str, base: int, name: str) -> None:
    """Name the state behind ``base`` with a marker that must not exist yet; ``Conflict`` if another writer has done so.

    A marker is made by exclusive creation, which only one writer can, and filled at once. One that stays empty for
    CLAIM_SECONDS was left by a writer that died; its number is passed over.
    """
    number, waited = base + 1, 0.0
    while True:
        markers = _markers(spark, path)
        if any(n > base and said for n, said in markers.items()):
            raise Conflict(f"{path}: a state behind {base} was committed by another writer")
        if number in markers and waited < CLAIM_SECONDS:
            time.sleep(0.25)
            waited += 0.25
        elif number in markers:
            number, waited = number + 1, 0.0
        else:
            place, system = _at(spark, f"{path}/current/{number}")
            try:
                out = system.create(place, False)
            except Py4JJavaError as error:
                if "AlreadyExists" not in str(error.java_exception):
                    raise
                continue
            out.write(name.encode())
            out.close()
            return


def commit(table: DataFrame, path: str, base: int) -> DataFrame:
    """Make ``table`` the state behind number ``base`` (0: none yet); ``Conflict``, and no trace, if another writer was first.

    Rows go to a folder of this writer's own before a marker names it, so readers see one whole state or the other.
    """
    spark, name = table.sparkSession, f"v{base + 1}-{uuid.uuid4().hex}"
    table.write.parquet(f"{path}/{name}")
    try:
        _claim(spark, path, base, name)
    except Conflict:
        place, system = _at(spark, f"{path}/{name}")
        system.delete(place, True)
        raise
    return spark.read.parquet(f"{path}/{name}")


def update(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame], keep: int = 3, tries: int = 20) -> DataFrame:
    """Commit what ``change`` makes of the current state (None before the first); started again from the winner's state if another writer was first.

    Behind that only the last ``keep`` states stay; a reader of an older one has to read again.
    """
    for turn in range(tries):
        known = versions(spark, path)
        base = max(known, default=0)
        try:
            made = commit(change(spark.read.parquet(known[base]) if known else None), path, base)
        except Conflict:
            if turn + 1 == tries:
                raise
            continue
        forget(spark, path, keep)
        return made


def replace(table: DataFrame, path: str) -> DataFrame:
    """A table's next state as a whole, whatever the one before; returns it."""
    return update(table.sparkSession, path, lambda old: table)


def forget(spark: SparkSession, path: str, keep: int) -> None:
    """Remove the states but the last ``keep``; their markers go last, so an interrupted removal goes on in the next one."""
    for number, folder in list(versions(spark, path).items())[:-keep]:
        for name in (folder, f"{path}/current/{number}"):
            place, system = _at(spark, name)
            system.delete(place, True)


def write_bucketed(table: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """``table`` kept in buckets of ``key``, sorted by it; returns the table that Spark knows to be dealt out so.

    Two such tables with as many buckets are joined on their keys, and one is grouped by its key, without a shuffle.
    """
    spark, name = table.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    table.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def with_columns(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``table`` with the columns (name -> type) that it lacks, null; those that it has stay as they are."""
    have = {c.lower() for c in table.columns}
    return table.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in columns.items() if name.lower() not in have))


def write_vectors(rows: DataFrame, cards: DataFrame, path: str, model: str, version: str, dim: int) -> DataFrame:
    """Vectors (id, vetor) and their manifest; refused unless they fit the cards (id). Returns the manifest."""
    vectors.require(vectors.gates(rows, cards, dim), "passed", "vectors do not fit the cards")
    kept = replace(rows, f"{path}/vectors")
    manifest = vectors.vector_digest(kept).select(F.lit(model).alias("modelo"), F.lit(version).alias("versao"), F.lit(dim).alias("dimensoes"), F.col("digest").alias("sha256"))
    return replace(manifest, f"{path}/manifest")
