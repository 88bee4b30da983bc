"""Shards along a Hilbert curve through quantised metadata (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.llm.storage import materialize, rank_in_cells, small_or_not

DIMENSIONS, BITS = ("q_lang", "q_size", "q_source"), 4


def quantised(value: Column) -> Column:
    """A text value's cell, 0 to 15, by its hash; null counts as a value."""
    return F.pmod(F.xxhash64(F.coalesce(value, F.lit(""))), F.lit(1 << BITS)).cast("int")


def quantised_size(size: Column) -> Column:
    """The size's power of two, 0 for 8 to 15 bytes, 15 from 256 KiB on."""
    power = F.floor(F.log2(size.cast("double"))).cast("int") - 3
    return F.greatest(F.lit(0), F.least(power, F.lit((1 << BITS) - 1)))


def hilbert_index(df: DataFrame, dims: tuple[str, ...] = DIMENSIONS, bits: int = BITS, name: str = "curve") -> DataFrame:
    """``df`` with the place of its cell (integer columns ``dims``, ``bits`` bits each) on the Hilbert curve.

    The cell's coordinates are turned level by level, the highest bit first,
    then Gray-coded and interleaved. Each step is its own projection, so the
    expressions stay small.
    """
    kept = df.columns
    axes = [f"_axis{i}" for i in range(len(dims))]
    df = df.select("*", *(F.col(d).cast("int").alias(a) for d, a in zip(dims, axes, strict=True)))
    first = axes[0]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for axis in axes:
            is_set = F.col(axis).bitwiseAND(1 << level) != 0
            swap = F.when(is_set, 0).otherwise(F.col(first).bitwiseXOR(F.col(axis)).bitwiseAND(low))
            df = df.withColumn("_swap", swap).withColumn("_flip", F.when(is_set, low).otherwise(F.col("_swap")))
            df = df.withColumn(first, F.col(first).bitwiseXOR(F.col("_flip")))
            if axis != first:
                df = df.withColumn(axis, F.col(axis).bitwiseXOR(F.col("_swap")))
    for before, axis in zip(axes, axes[1:], strict=False):
        df = df.withColumn(axis, F.col(axis).bitwiseXOR(F.col(before)))
    turn = F.lit(0)
    for level in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.col(axes[-1]).bitwiseAND(1 << level) != 0, (1 << level) - 1).otherwise(0))
    df = df.withColumn("_turn", turn)
    index = F.lit(0)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            bit = F.shiftright(F.col(axis).bitwiseXOR(F.col("_turn")), level).bitwiseAND(1)
            index = index * 2 + bit
    return df.withColumn(name, index.cast("int")).select(*kept, name)


def hilbert_shards(docs: DataFrame, shards: int = 24, rows_a_part: int = 250_000) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, lang, source) in one of ``shards`` runs of the curve.

    Rows are ordered by the Hilbert index of (language, size, source), then
    cut into runs whose counts differ by at most one (law ``rows``), so a
    file's metadata cover a compact part of the space. Returns doc_id, size
    (UTF-8 bytes of the text plus 8; null text: 8), text_crc32, law, shard,
    slot (0-based place in the shard), grown_shard (null under this law),
    curve. Null languages and sources are values of their own; repeated rows
    take a slot each; an empty table gives an empty result; other columns are
    ignored.

    The only sort is inside parts: a cell is dealt by document over as many
    parts as its rows need (see ``rank_in_cells``), so no language, source or
    text fills a task, and a row's rank is its part's offset plus its place.
    The table of parts is broadcast if it is counted to be small.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        quantised(F.col("lang")).alias("q_lang"),
        quantised(F.col("source")).alias("q_source"),
    ).withColumn("q_size", quantised_size(F.col("size")))
    rows = materialize(rows, "shard-rows")
    placed, parts = rank_in_cells(rows, list(DIMENSIONS), ["doc_id", "size", "text_crc32"], rows_a_part)
    cells = hilbert_index(parts.groupBy(*DIMENSIONS).agg(F.sum("rows").alias("rows")))
    along = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,096 cells
    cells = cells.withColumn("ahead", F.coalesce(F.sum("rows").over(along), F.lit(0)))
    total = F.sum("rows").over(Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cells = cells.select(*DIMENSIONS, "curve", "ahead", total.alias("total"))
    offsets = parts.join(F.broadcast(cells), list(DIMENSIONS)).select(
        *DIMENSIONS, "sub", "curve", "total", (F.col("ahead") + F.col("before")).alias("offset")
    )
    ranked = placed.join(small_or_not(offsets), [*DIMENSIONS, "sub"]).withColumn("rank", F.col("offset") + F.col("place"))
    shard = F.expr(f"rank * {shards} div total")
    ranked = ranked.withColumn("shard", shard.cast("int"))
    start = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("rank") - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )
