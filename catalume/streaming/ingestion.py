"""Ingestion that can be stopped anywhere: pages as a stream, batches with commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.operators import health, ingest
from catalume.sources.portal import PortalSource

Batch = Callable[[DataFrame, int], None]


def put(rows: DataFrame, path: str, batch: int) -> None:
    """Write a batch's rows under its number, instead of what an earlier try of the same batch left there."""
    rows.write.mode("overwrite").parquet(f"{path}/lote={batch}")


def taken(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches, with their ``lote``; none where nothing was written yet."""
    empty = spark.createDataFrame([], f"{schema}, lote int")
    try:
        return spark.read.schema(f"{schema}, lote int").parquet(path)
    except AnalysisException:
        return empty


PAGES, RECORDS, FAILURES = "pagina int, n int", "id string, pagina int, raw string", "identificador string, motivo string, pagina int"


def progress(spark: SparkSession, target: str) -> DataFrame:
    """One row: ultima_pagina taken (0: none), concluida, motivo; see ``ingest.listing_end``."""
    pages = taken(spark, f"{target}/pages", PAGES)
    end = ingest.listing_end(pages.select("pagina", "n"))
    last = pages.agg(F.coalesce(F.max("pagina"), F.lit(0)).alias("ultima_pagina"))
    return last.join(end, F.lit(True), "left").select("ultima_pagina", F.coalesce("concluida", F.lit(False)).alias("concluida"), "motivo", F.col("pagina").alias("fim"))


def keyed(rows: DataFrame) -> DataFrame:
    """A stream's rows with ``chave``: a record's identifier; a page's own row, and a record without one, are each a key."""
    found = rows.withColumn("id", ingest.extract_id(F.try_parse_json("raw")))
    own = F.when(F.col("raw").isNull(), F.format_string("#%d", "pagina")).otherwise(F.concat(F.format_string("!%d ", "pagina"), F.sha2("raw", 256)))
    return found.withColumn("chave", F.coalesce(F.concat(F.lit("="), "id"), own))


def _store(target: str, then: Batch | None) -> Batch:
    def store(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        put(rows.where("n is not null").select("pagina", "n"), f"{target}/pages", batch)
        put(rows.where("id is not null").select("id", "pagina", "raw"), f"{target}/records", batch)
        lost = rows.where("raw is not null and id is null")
        put(lost.select(F.lit("<sem identificador>").alias("identificador"), F.lit("registro sem campo de id").alias("motivo"), "pagina"), f"{target}/failures", batch)
        rows.unpersist()
        if then:
            then(rows, batch)

    return store


def collect(spark: SparkSession, options: dict[str, str], target: str, checkpoint: str, then: Batch | None = None) -> dict:
    """Take the pages of a portal that are still to be taken; returns ``progress`` afterwards.

    A run that is stopped, or fails, goes on in the next one with the same ``target`` and ``checkpoint``: Spark's
    checkpoint holds the last page of each batch before it begins, so a batch that was begun is taken again, and what it
    writes stands under its number. Identifiers already seen are state of the stream; a record that moves to a later page
    while pages are taken is stored once. A listing that has ended, see ``ingest.listing_end``, is not asked again; what
    came behind its end is not read by ``records``. A page that keeps failing stops the run with its error, the pages
    before its batch are kept. ``then`` is called behind each batch's writes.
    """
    spark.dataSource.register(PortalSource)
    at = progress(spark, target).first()
    if not at.concluida:
        pages = spark.readStream.format("portal").options(**options, after=str(at.ultima_pagina)).load()
        query = keyed(pages).dropDuplicates(["chave"]).writeStream.foreachBatch(_store(target, then)).option("checkpointLocation", checkpoint).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        at = progress(spark, target).first()
    return at.asDict()


def records(spark: SparkSession, target: str) -> DataFrame:
    """(id, pagina, raw): every record once, up to the listing's end."""
    end = progress(spark, target).select(F.when(F.col("concluida"), F.col("fim")).alias("fim"))
    return taken(spark, f"{target}/records", RECORDS).join(F.broadcast(end), F.col("fim").isNull() | (F.col("pagina") <= F.col("fim"))).select("id", "pagina", "raw")


# -- link health in batches ---------------------------------------------------

PROBES = "id bigint, status_http int, classe_saude string, motivo_saude string, latencia_ms int, checado_em timestamp"


def probe_batches(probes: DataFrame, target: str, checkpoint: str, then: Batch | None = None) -> None:
    """Store a stream of probes (id, HEALTH) batch by batch until there are no more.

    Each batch holds the last probe of each of its links (ties: the greatest values) and stands under its number, so a
    batch that is run twice changes nothing; stored links are not rewritten. ``health_state`` reads them over the links.
    """

    def store(rows: DataFrame, batch: int) -> None:
        put(_last(rows), target, batch)
        if then:
            then(rows, batch)

    query = probes.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _last(probes: DataFrame) -> DataFrame:
    order = ["checado_em", *(c for c in health.HEALTH if c != "checado_em")]
    return probes.groupBy("id").agg(F.max(F.struct(*order)).alias("h")).select("id", *(f"h.{c}" for c in health.HEALTH))


def health_state(stored: DataFrame, target: str, schema: str = PROBES) -> DataFrame:
    """``stored`` links with the health columns of their last probe in any batch; links that none has keep theirs."""
    return health.updated(stored, _last(taken(stored.sparkSession, target, schema)))
