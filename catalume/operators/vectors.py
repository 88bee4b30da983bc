"""Vectors: normalization, consistency gates, exact cosine search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.sources.kept import keep, new_path

#: Queries that are broadcast at once, and rows that are held against them at once.
BLOCK, AT_ONCE = 2048, 2048


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(vector: Column) -> Column:
    """The vector over its length; a zero vector is an error."""
    length = norm(vector)
    checked = F.when(length == 0, F.raise_error(F.lit("zero vector"))).otherwise(length)
    return F.transform(vector, lambda x: (x / checked).cast("float"))


def gates(vectors: DataFrame, cards: DataFrame, dim: int, tolerance: float = 1e-3) -> DataFrame:
    """One row: vectors, cards, ids on one side only, wrong sizes, the largest distance of a norm from 1, verdict."""
    both = vectors.select(F.col("id"), "vetor").join(cards.select(F.col("id").alias("card")), F.col("id") == F.col("card"), "full_outer")
    seen = both.agg(
        F.count("id").alias("vectors"),
        F.count("card").alias("cards"),
        F.count_if(F.col("card").isNull()).alias("without_card"),
        F.count_if(F.col("id").isNull()).alias("without_vector"),
        F.count_if(F.size("vetor") != dim).alias("wrong_size"),
        F.round(F.max(F.abs(norm(F.col("vetor")) - 1)), 6).alias("norm_error"),
    )
    fits = (F.col("without_card") == 0) & (F.col("without_vector") == 0) & (F.col("wrong_size") == 0) & (F.col("norm_error") <= tolerance)
    return seen.withColumn("passed", fits)


def require(gate: DataFrame, column: str, message: str) -> None:
    """Raise unless the one row of ``gate`` has ``column`` true."""
    row = gate.first()
    if row is None or not row[column]:
        raise ValueError(f"{message}: {row.asDict() if row is not None else None}")


def ready(vectors: DataFrame, cards: DataFrame, dim: int, model: str, manifest: DataFrame) -> DataFrame:
    """One row: whether a search by vectors may start, and each gate's verdict.

    ``cards`` (id, texto); ``manifest`` (modelo, versao, sha256) of the kept vectors, one row.
    """
    from catalume.operators import publish

    fits = gates(vectors, cards, dim).select(F.col("passed").alias("vectors_fit"))
    version = publish.catalog_fingerprint(cards).select(F.col("fingerprint"))
    digest = vector_digest(vectors).select("digest")
    rows = manifest.join(F.broadcast(fits)).join(F.broadcast(version)).join(F.broadcast(digest))  # one row each
    rows = rows.select(
        "vectors_fit",
        (F.col("modelo") == model).alias("same_model"),
        (F.col("versao") == F.col("fingerprint")).alias("same_catalog"),
        (F.col("sha256") == F.col("digest")).alias("same_vectors"),
    )
    return rows.withColumn("ready", F.col("vectors_fit") & F.col("same_model") & F.col("same_catalog") & F.col("same_vectors"))


def vector_digest(vectors: DataFrame) -> DataFrame:
    """One row: SHA-256 over all (id, vetor), whatever the partitioning; see ``publish.catalog_fingerprint``."""
    from catalume.operators import publish

    shown = F.array_join(F.transform("vetor", lambda x: F.hex(F.round(x.cast("double") * 1e6).cast("bigint"))), ",")
    return publish.catalog_fingerprint(vectors.select(F.col("id").cast("string").alias("id"), shown.alias("texto"))).select(F.col("fingerprint").alias("digest"))


def parity(vectors: DataFrame, reference: DataFrame, least: float = 0.999) -> DataFrame:
    """One row: the least cosine of vectors to the reference's of the same id (a missing one: 0), and whether it is above ``least``."""
    dot = F.aggregate(F.zip_with("vetor", "_other", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    met = reference.select("id", F.col("vetor").alias("_other")).join(vectors.select("id", "vetor"), "id", "left")
    seen = met.agg(F.round(F.min(F.coalesce(dot, F.lit(0.0))), 6).alias("least"))
    return seen.withColumn("passed", F.col("least") > least)


def same_order(vectors: DataFrame, cards: DataFrame) -> DataFrame:
    """One row: whether vectors (pos, id) stand in the order of the cards' (id) sorted identifiers.

    Ids are dealt out by range; the order holds if the counts and the ids on
    both sides are equal and positions rise within and across the ranges.
    """
    both = vectors.join(cards.select("id"), "id", "full_outer").select("id", "pos")
    ranged = both.repartitionByRange("id").select("*", F.spark_partition_id().alias("part"))
    ranged = keep(ranged, "vector-order")
    falls = F.col("pos") <= F.lag("pos").over(Window.partitionBy("part").orderBy("id"))
    inside = ranged.select("part", "pos", F.coalesce(falls, F.lit(False)).alias("falls"))
    parts = inside.groupBy("part").agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.count_if(F.col("pos").isNull() | F.col("falls")).alias("wrong"))
    across = F.coalesce(F.col("low") <= F.lag("high").over(Window.orderBy("part")), F.lit(False))  # one row a range
    seen = parts.withColumn("across", across).agg(F.sum("wrong").alias("wrong"), F.count_if("across").alias("breaks"))
    extra = cards.join(vectors, "id", "left_anti").agg(F.count("*").alias("missing"))
    return seen.join(extra).select(((F.col("wrong") == 0) & (F.col("breaks") == 0) & (F.col("missing") == 0)).alias("same_order"))


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """(qid, id, posicao, score) of the ``k`` most like vectors (id, vetor) of each query (qid, vetor), ties by id.

    With ``by`` only vectors with the query's value of that column count.
    Queries are taken in blocks of about ``BLOCK``; each block is broadcast,
    held against all rows by matrix products, its best written, and its
    broadcast given up before the next one. A task passes on its own best
    ``k`` of each query.
    """
    spark = vectors.sparkSession
    queries = keep(queries, "asked")
    blocks = max(1, -(-queries.count() // BLOCK))
    path = new_path(spark, "cosine")
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block)
        part, shared = _block_top(vectors, own, k, by)
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")).cast("long")
        part.withColumn("posicao", place).where(F.col("posicao") <= k).select("qid", "id", "posicao", "score").write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.schema("qid bigint, id bigint, posicao bigint, score double").parquet(path)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows by queries, each query's ``k`` best rows: highest score, then smallest id."""
    order = np.lexsort((ids, -scores), axis=0)[:k]
    return np.take_along_axis(ids, order, 0), np.take_along_axis(scores, order, 0)


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), dim)


def _block_top(vectors: DataFrame, queries: DataFrame, k: int, by: str | None) -> tuple[DataFrame, Broadcast]:
    rows = queries.select("qid", "vetor", *([by] if by else [])).toArrow()  # about BLOCK rows
    wanted = np.array(rows.column("vetor").to_pylist(), np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast((rows.column("qid").to_numpy(), wanted, np.array(rows.column(by).to_pylist(), object) if by else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, wanted, kinds = shared.value
        found = None
        for whole in batches if len(qids) else ():
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                scores = np.round(_matrix(batch.column(1), wanted.shape[1]) @ wanted.T, 6) + 0.0
                if kinds is not None:
                    scores[np.array(batch.column(2).to_pylist(), object)[:, None] != kinds[None, :]] = -np.inf
                ids = np.broadcast_to(batch.column(0).to_numpy()[:, None], scores.shape)
                best = _best(ids, scores, k)
                found = best if found is None else _best(np.concatenate((found[0], best[0])), np.concatenate((found[1], best[1])), k)
        if found is not None:
            fine = np.isfinite(found[1].ravel())
            out = (np.tile(qids, len(found[0]))[fine], found[0].ravel()[fine], found[1].ravel()[fine])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2])], ["qid", "id", "score"])

    columns = ["id", "vetor", *([by] if by else [])]
    return vectors.select(*columns).where("vetor is not null").mapInArrow(run, "qid bigint, id bigint, score double"), shared
