"""Recorded catalog files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.functions import text


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(linha, raw): the lines of text files with their 1-based number, blank ones counted too.

    Partitions are counted, one row each, and a line's number is its
    partition's offset plus its place, so files are read in parallel.
    """
    marked = spark.read.text(path).select(F.monotonically_increasing_id().alias("m"), F.col("value").alias("raw"))
    rows = marked.select(F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND((1 << 33) - 1).alias("at"), "raw")
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    offsets, before = [], 0
    for part in sorted(counts):
        offsets.append((part, before))
        before += counts[part]
    starts = F.broadcast(spark.createDataFrame(offsets, "part bigint, before bigint"))
    return rows.join(starts, "part").select((F.col("before") + F.col("at") + 1).alias("linha"), "raw")


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """Identifiers, one a line; blank lines and comments are skipped."""
    lines = spark.read.text(path).select(text.strip(F.col("value")).alias("id"))
    return lines.where("id <> '' and not startswith(id, '#')")


def question_set(spark: SparkSession, path: str) -> DataFrame:
    """(texto, aceitaveis, tema, dificuldade) of an evaluation set in CSV; blank questions are skipped."""
    rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    return rows.where(text.strip(F.coalesce("pergunta", F.lit(""))) != "").select(
        text.strip(F.col("pergunta")).alias("texto"),
        text.identifiers(F.col("conjuntos_aceitaveis")).alias("aceitaveis"),
        F.coalesce(text.blank_to_null(F.col("tema")), F.lit("sem tema")).alias("tema"),
        F.coalesce(text.blank_to_null(F.col("dificuldade")), F.lit("sem nível")).alias("dificuldade"),
    )


def last_run(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The last valid line of an evaluation history of a kind of retrieval; lines without kind are lexical."""
    read = numbered_lines(spark, path).withColumn("r", F.from_json("raw", "recuperacao string, recall_5 double, recall_10 double, mrr double, total int"))
    fine = read.where("r.recall_5 is not null").select("linha", "r.*").withColumn("recuperacao", F.coalesce("recuperacao", F.lit("lexica")))
    return fine.where(F.col("recuperacao") == kind).orderBy(F.desc("linha")).limit(1)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A release's manifest, a JSON object over any number of lines."""
    return spark.read.option("multiLine", True).json(path)
