"""One row of each group of documents: what every deduplication here ends with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalume.llm.storage import free_name, materialize, small_or_not


def text_key(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def drop_rows(docs: DataFrame, odd: DataFrame, key: Column) -> DataFrame:
    """``docs`` without the rows that ``odd`` (_id, _odd, kept) names by doc_id and ``key``, but one of each that is kept.

    Few such rows are broadcast, so that no text moves; many are shuffled.
    """
    name = free_name(docs, "_key")
    keyed = docs.withColumn(name, key)

    def on(other: DataFrame) -> Column:
        return keyed["doc_id"].eqNullSafe(other["_id"]) & (keyed[name] == other["_odd"])

    gone, repeated = small_or_not(odd), odd.where("kept")
    stay = keyed.join(gone, on(gone), "left_anti")
    if not repeated.isEmpty():
        once = small_or_not(repeated)
        stay = stay.unionByName(keyed.join(once, on(once), "left_semi").dropDuplicates(["doc_id", name]))
    return stay.drop(name)


def keep_first(docs: DataFrame, rows: DataFrame, linked: DataFrame) -> DataFrame:
    """``docs`` with one row of each group, all columns as they are.

    ``rows`` (doc_id, key, node) has a row for each row of ``docs`` with its
    ``text_key``; ``linked`` (node, root) says which nodes are one group, a
    node without a row there is a group of its own. The row with the smallest
    doc_id stays (null ids last; of one doc_id on several texts the smallest
    key; of repeated rows one).
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    lows = rows.groupBy("node").agg(F.min(order).alias("low"))
    tied = lows.join(linked, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    least = tied.groupBy("root").agg(F.min("low").alias("least"))
    # the further key has both sides dealt out for the join, so that a hot group can be split
    named = tied.select("node", "root", F.hash("root").alias("deal")).join(least.withColumn("deal", F.hash("root")), ["root", "deal"])
    placed = rows.withColumn("deal", F.hash("node")).join(named.select("node", F.hash("node").alias("deal"), "least"), ["node", "deal"])
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("key") == F.col("least.key"))
    odd = placed.select("doc_id", "key", kept.alias("kept")).groupBy("doc_id", "key").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    odd = materialize(odd.where("not kept or rows > 1").select(F.col("doc_id").alias("_id"), F.col("key").alias("_odd"), "kept"), "group-dropped")
    return drop_rows(docs, odd, text_key(docs))
