"""Fingerprints and manifests of a published catalog."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def catalog_fingerprint(cards: DataFrame, buckets: int = 256) -> DataFrame:
    """One row: SHA-256 over all (id, texto), whatever the partitioning.

    Each card is hashed with its separators, the hashes of a bucket (the first
    two bytes of the id's hash) are joined in order of id and hashed, then the
    buckets'. Any change of an id or a text changes it; no list of all cards
    is ever in one place.
    """
    zero, record = F.lit("\x00"), F.lit("\x1e")
    line = F.sha2(F.concat("id", zero, F.coalesce("texto", F.lit("")), record).cast("binary"), 256)
    key = F.sha2(F.col("id").cast("binary"), 256)
    rows = cards.select("id", line.alias("line"), F.conv(F.substring(key, 1, 4), 16, 10).cast("int").alias("slot"))
    fine = rows.groupBy("slot").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda r: r["line"]), "").cast("binary"), 256).alias("part"))
    coarse = fine.groupBy((F.col("slot") % buckets).alias("bucket")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "part"))), lambda r: r["part"]), "").cast("binary"), 256).alias("whole")
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "whole"))), lambda r: r["whole"]), "")
    return coarse.agg(F.sha2(joined.cast("binary"), 256).alias("fingerprint"))


def manifest_counts(datasets: DataFrame, resources: DataFrame, cards: DataFrame) -> DataFrame:
    """One row: counts of the catalog and the sorted distinct models of its cards."""
    return (
        datasets.agg(F.count("*").alias("conjuntos"))
        .join(resources.agg(F.count("*").alias("recursos")))
        .join(cards.agg(F.count("*").alias("fichas"), F.array_join(F.array_sort(F.collect_set(F.nullif("modelo", F.lit("")))), ",").alias("modelos")))
    )


def file_digests(spark, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files under ``path``."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest(datasets: DataFrame, resources: DataFrame, cards: DataFrame, assets: DataFrame) -> DataFrame:
    """One row: the counts, the cards' latest gerada_em, their models, and the assets (path, bytes, sha256) by path."""
    latest = cards.agg(F.max("gerada_em").alias("gerado_em"))
    named = assets.select(F.substring_index("path", "/", -1).alias("nome"), "bytes", "sha256")
    listed = named.agg(F.array_sort(F.collect_list(F.struct("nome", "bytes", "sha256"))).alias("assets"))  # a row an asset
    return manifest_counts(datasets, resources, cards).join(latest).join(listed)


def checked_files(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(nome, ok): expected files (nome, sha256) and whether one of that digest was found (path, sha256)."""
    have = found.select(F.substring_index("path", "/", -1).alias("nome"), F.col("sha256").alias("_have"))
    return expected.join(have, "nome", "left").select("nome", F.coalesce(F.col("_have") == F.col("sha256"), F.lit(False)).alias("ok"))


def retrieval_version(cards: DataFrame, kind: str, settings, model: str = "", version: str = "") -> DataFrame:
    """One row that identifies what an evaluation measured: kind, cards, models and the parameters that kind reads, as JSON."""
    said: dict[str, object] = {}
    if kind in ("semantica", "hibrida"):
        said |= {"modelo_embedding": model, "versao_vetores": version[:16]}
    if kind in ("lexica", "hibrida"):
        said |= {"pesos": settings.weights, "fatores": settings.confidence}
    if kind == "hibrida":
        said |= {"rrf_k": settings.rrf_k, "profundidade": settings.depth}
    seen = cards.agg(F.count("*").alias("fichas"), F.array_join(F.array_sort(F.collect_set("modelo")), ",").alias("modelos"))
    return seen.select(F.lit(kind).alias("recuperacao"), "fichas", "modelos", F.lit(json.dumps(said, ensure_ascii=False)).alias("parametros"))
