"""Exact duplicates by content-defined chunk recipes (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.llm.storage import materialize
from catalume.llm.survivors import drop_rows

#: Characters of an anchor window: code points 1 modulo 4 below U+0180.
_ANCHORS = "".join(f"\\x{{{c:x}}}" for c in range(0x180) if c % 4 == 1)


def chunks(text: Column, min_chars: int = 1024, max_chars: int = 8192, window: int = 3) -> Column:
    """Cut a text where its own characters say so.

    A chunk ends after ``window`` anchor characters in a row, at least
    ``min_chars`` and at most ``max_chars`` long, so equal passages are cut
    alike wherever they stand. Joined, the chunks are the text; an empty or
    null text has none.
    """
    pattern = f"(?s).{{{min_chars},{max_chars}}}?(?<=[{_ANCHORS}]{{{window}}})|.{{1,{max_chars}}}"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def _key(chunk: Column, key_bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(chunk), 64 - key_bits) if key_bits < 64 else F.xxhash64(chunk)


def colliding_chunks(docs: DataFrame, key_bits: int = 64) -> DataFrame | None:
    """Chunks whose hash key another, different chunk has too: (key, chunk, variant); None if there are none.

    Every distinct chunk's content is compared here once, after copies have
    been dropped before the shuffle; keys missing from the result are
    verified identifiers. Contents are moved again only for keys that clash.
    """
    distinct = (
        docs.select(F.explode(chunks(F.col("text"))).alias("chunk"))
        .select(_key(F.col("chunk"), key_bits).alias("key"), "chunk")
        .dropDuplicates(["key", "chunk"])
    )
    twice = materialize(distinct.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "chunk-clashes")
    if twice.isEmpty():
        return None
    clash = distinct.join(twice, "key", "left_semi")
    return materialize(clash.withColumn("variant", F.row_number().over(Window.partitionBy("key").orderBy("chunk"))), "chunk-variants")


def _recipes(docs: DataFrame, key_bits: int) -> DataFrame:
    """(doc_id, row_no, recipe, text_sha256): the ordered verified chunk identifiers of each row."""
    rows = docs.select(
        "doc_id",
        "text",
        F.monotonically_increasing_id().alias("row_no"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )
    clash = colliding_chunks(docs, key_bits)
    if clash is None:
        recipe = F.transform(chunks(F.col("text")), lambda c: _key(c, key_bits))
        return rows.select("doc_id", "row_no", recipe.alias("recipe"), "text_sha256")
    pieces = rows.select("row_no", F.posexplode(chunks(F.col("text"))).alias("at", "chunk"))
    pieces = pieces.withColumn("key", _key(F.col("chunk"), key_bits)).join(clash, ["key", "chunk"], "left")
    listed = pieces.groupBy("row_no").agg(
        F.sort_array(F.collect_list(F.struct("at", "key", F.coalesce("variant", F.lit(0)).alias("variant")))).alias("steps")
    )
    recipe = F.transform("steps", lambda s: F.struct(s["key"].alias("key"), s["variant"].alias("variant")))
    recipes = listed.select("row_no", recipe.alias("recipe"))
    empty = F.array().cast("array<struct<key:bigint,variant:int>>")
    return rows.join(recipes, "row_no", "left").select("doc_id", "row_no", F.coalesce("recipe", empty).alias("recipe"), "text_sha256")


def exact_duplicates(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its group of identical texts.

    Returns doc_id, keep_id (the group's largest doc_id), group_size, kept,
    text_sha256. Texts are equal when their lists of verified chunk
    identifiers are; a null text counts as empty, empty texts are equal to
    each other. Of rows that repeat the kept doc_id exactly one is kept; a
    group of null doc_ids keeps one row. Other columns are ignored. An empty
    table gives an empty result. ``key_bits`` narrows the chunk hash in tests,
    to make keys clash.

    A group may hold any share of the rows: groups are counted before the
    shuffle, and rows meet their group's count in a join whose large
    partitions can be split.
    """
    docs = docs.select("doc_id", "text")
    recipes = materialize(_recipes(docs, key_bits), "recipes")
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # Joined on a further key, so that both sides are dealt out for the join and a hot group can be split.
    groups = groups.select(F.col("recipe").alias("_recipe"), F.hash("recipe").alias("_deal"), "keep_id", "group_size")
    rows = recipes.withColumn("_own", F.hash("recipe"))
    found = rows.join(groups, (rows["_own"] == groups["_deal"]) & (rows["recipe"] == groups["_recipe"]))
    first = F.row_number().over(Window.partitionBy("doc_id", F.hash("recipe"), "recipe").orderBy("row_no")) == 1
    return found.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & first).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of identical texts, all columns as they are.

    Only identifiers of dropped rows are joined back. Where one doc_id stands
    on several rows of the same text, one of those rows stays.
    """
    found = exact_duplicates(docs)
    pairs = found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    odd = pairs.where("not kept or rows > 1").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_odd"), "kept")
    odd = materialize(odd, "dropped")
    return drop_rows(docs, odd, F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256))
