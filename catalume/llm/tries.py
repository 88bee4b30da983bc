"""Conversations as a tree of shared beginnings, numbered in preorder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.llm.storage import materialize, ship_package

#: 64-bit hashes whose xor over the turns tells one beginning from another.
_KEYS = 4


def running(df: DataFrame, group: list[str], order: list[str], values: dict[str, tuple[str, str]], name: str) -> DataFrame:
    """``df`` with running aggregates over each group's rows by ``order`` (nulls first), the row itself included.

    ``values``: new column -> (``count``, ``sum`` or ``bit_xor``, column). Rows are cut into ranges of (group, order), so a
    group of any size is dealt over many tasks; what a group has in earlier ranges is added from a table of two rows a
    range at most. ``df`` is written to the shared folder as ``name``.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parted = materialize(df.repartitionByRange(ranges, *group, *order).withColumn("_range", F.spark_partition_id()), name)
    make = {"count": F.count, "sum": F.sum, "bit_xor": F.bit_xor}
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for new, (op, column) in values.items():
        parted = parted.withColumn(new, make[op](column).over(inside))
    totals = parted.groupBy("_range", *group).agg(*(make[op](column).alias(f"_{new}") for new, (op, column) in values.items()))
    # only the first and the last group of a range can have rows in other ranges
    low, high = (Window.partitionBy("_range").orderBy(*(f(g) for g in group)) if group else Window.partitionBy("_range").orderBy("_range") for f in (F.asc, F.desc))
    edges = totals.withColumn("_low", F.row_number().over(low)).withColumn("_high", F.row_number().over(high)).where("_low = 1 or _high = 1")
    edges = materialize(edges.drop("_low", "_high"), f"{name}-edges")
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    add = {new: make["sum" if op == "count" else op] for new, (op, _) in values.items()}
    carried = edges.select("_range", *group, *(F.coalesce(add[new](f"_{new}").over(before), F.lit(0)).alias(f"_{new}") for new in values))
    on = parted["_range"] == carried["_range"]
    for g in group:
        on &= parted[g].eqNullSafe(carried[g])
    found = parted.join(F.broadcast(carried), on, "left")
    out = {new: F.coalesce(carried[f"_{new}"], F.lit(0)).bitwiseXOR(parted[new]) if op == "bit_xor" else F.coalesce(carried[f"_{new}"], F.lit(0)) + parted[new] for new, (op, _) in values.items()}
    return found.select(*(parted[c] for c in df.columns), *(v.alias(k) for k, v in out.items()))


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, digest, chars) of each turn; no text goes further."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = conversations.select("conv_id", "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    return running(turns, ["conv_id"], ["turn", "digest"], {"place": ("count", "digest")}, "trie-turns")


def rebuild(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their block: (conv_id, place, digest, chars), and all conv_ids.

    Conversation c takes the first h turns of c - c % ``block`` (all if there are fewer, none if it is absent) and then its
    own turns after its first h; h = crc32(decimal c) % ``most``. At most ``block`` x 2 conversations share a base, and
    each takes fewer than ``most`` of its turns. A null conv_id is a conversation with h = 0.
    """
    convs = materialize(
        turns.groupBy("conv_id")
        .agg(F.count("*").alias("size"))
        .withColumn("h", F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % most, F.lit(0)))
        .withColumn("base", F.col("conv_id") - F.col("conv_id") % block),
        "trie-conversations",
    )
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    convs = convs.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_size", F.lit(0))))
    heads = turns.where((F.col("place") < most) & (F.col("conv_id") % block == 0)).withColumnRenamed("conv_id", "base")
    heads = heads.join(convs.select("conv_id", "base", "taken"), "base").where("place <= taken").select("conv_id", "place", "digest", "chars")
    plan = convs.select(F.col("conv_id").alias("_id"), "h", "taken")
    # a further key has both sides dealt out for the join, so that a conversation of very many turns can be split
    own = turns.withColumn("_deal", F.hash("conv_id")).join(plan.withColumn("_deal_", F.hash("_id")), (F.col("_deal") == F.col("_deal_")) & F.col("conv_id").eqNullSafe(F.col("_id")))
    own = own.where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "chars")
    return heads.unionByName(own), convs.select("conv_id")


def _hash_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of equal nodes: the digest of its ids, comma-joined, fed as they come."""
    node, digest = None, None
    done: tuple[list[str], list[str]] = ([], [])
    for batch in batches:
        for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            said = b"" if conv is None else b"%d" % conv
            if key == node:
                digest.update(b"," + said)
                continue
            if node is not None:
                done[0].append(node)
                done[1].append(digest.hexdigest())
            node, digest = key, hashlib.sha256(said)
        if done[0]:
            yield pa.RecordBatch.from_arrays([pa.array(done[0]), pa.array(done[1])], ["node", "ends_sha256"])
            done = ([], [])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])


def _key(prefix: str) -> Column:
    return F.concat(*(F.lpad(F.hex(f"{prefix}{k}"), 16, "0") for k in range(_KEYS)))


def prefix_trie(conversations: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """A row for each distinct beginning of the rebuilt conversations, the empty one included.

    Reads conv_id, turn, role, text; other columns are ignored; turns stand by turn, nulls first, ties by the digest of
    role and text; null roles and texts are empty; repeated rows are repeated turns; a null conv_id is one more
    conversation, whose id is no smallest member where there is another and is the empty string among ends. No
    conversations: no rows. Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 as the contract of op13 has them, and preorder with subtree_end, both from 0.

    A beginning is known by its turns' SHA-256 and places (four 64-bit hashes, xored along the turns). Copies of a whole
    conversation are counted once and go on as one row with a weight. Distinct whole conversations are ranked by their
    turns' digests (64 characters a turn, one row a conversation); a node's subtree is the range of ranks of those through
    it, the node's place in preorder that of (first such rank, depth), and its end that of the last such conversation's
    own node. Leaves and savings are then differences of running sums along the preorder. Running sums and places are
    made in ranges, so no conversation, node or group of copies is one task's; the digest of a node's ids alone has to
    take them in order, and takes them as a stream.
    """
    ship_package(conversations.sparkSession)
    rebuilt, convs = rebuild(_turns(conversations), block, most)
    for k in range(_KEYS):
        rebuilt = rebuilt.withColumn(f"x{k}", F.xxhash64(F.lit(k), "place", "digest"))
    along = materialize(running(rebuilt, ["conv_id"], ["place"], {f"p{k}": ("bit_xor", f"x{k}") for k in range(_KEYS)}, "trie-along"), "trie-nodes-of-turns")
    along = along.select("conv_id", "place", "digest", "chars", _key("p").alias("node"), F.concat(*(F.lpad(F.hex(F.col(f"p{k}").bitwiseXOR(F.col(f"x{k}"))), 16, "0") for k in range(_KEYS))).alias("parent"))
    root = "0" * 16 * _KEYS
    last = along.groupBy("conv_id").agg(F.max(F.struct("place", "node")).alias("last"))
    ends = convs.join(last, convs["conv_id"].eqNullSafe(last["conv_id"]), "left").select(
        convs["conv_id"], F.coalesce("last.node", F.lit(root)).alias("node"), F.coalesce("last.place", F.lit(0)).alias("depth")
    )
    ends = materialize(ends, "trie-ends")
    wholes = ends.groupBy("node", "depth").agg(
        F.count("*").alias("weight"), F.min("conv_id").alias("least"), F.min(F.struct(F.col("conv_id").isNull(), "conv_id")).alias("one")
    )
    wholes = materialize(wholes.select("node", "depth", "weight", "least", F.col("one.conv_id").alias("one")), "trie-wholes")
    named = wholes.select(F.col("one").alias("_one"), "weight", "least", F.col("node").alias("whole"), F.col("depth").alias("whole_depth"))
    steps = along.withColumn("_deal", F.hash("conv_id")).join(named.withColumn("_deal_", F.hash("_one")), (F.col("_deal") == F.col("_deal_")) & F.col("conv_id").eqNullSafe(F.col("_one")))
    steps = steps.select("whole", "whole_depth", "weight", "least", "place", "digest", "chars", "node", "parent")
    paths = steps.groupBy("whole").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "digest"))), lambda t: t["digest"]), "").alias("path"))
    paths = wholes.select(F.col("node").alias("whole")).join(paths, "whole", "left").select("whole", F.coalesce("path", F.lit("")).alias("path"))
    ranks = running(paths, [], ["path"], {"rank": ("count", "whole")}, "trie-paths").select("whole", "rank")
    ranks = materialize(ranks, "trie-ranks")
    none = F.lit(None).cast("string")
    tops = wholes.select(F.col("node").alias("whole"), F.col("depth").alias("whole_depth"), "weight", "least", F.lit(0).alias("place"), F.lit(0).cast("long").alias("chars"), F.lit(root).alias("node"), none.alias("parent"))
    members = steps.drop("digest").unionByName(tops).join(ranks, "whole")
    nodes = members.groupBy("node").agg(
        F.min("parent").alias("parent"),
        F.min("place").cast("long").alias("depth"),
        F.sum("weight").alias("n_convs"),
        F.min("least").alias("conv_id"),
        F.max("chars").alias("chars"),
        F.min("rank").alias("first"),
        F.max("rank").alias("last"),
    )
    nodes = materialize(nodes, "trie-nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    told = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    told = told.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("own", (F.col("n_convs") - 1) * F.col("chars"))
    order = running(told, [], ["first", "depth"], {"preorder": ("count", "node"), "leaves": ("sum", "leaf"), "saved": ("sum", "own")}, "trie-preorder")
    order = materialize(order, "trie-placed")
    # where a subtree ends: at the node of the last whole conversation in it
    stops = ranks.join(order.select(F.col("node").alias("whole"), F.col("preorder").alias("end"), F.col("leaves").alias("end_leaves"), F.col("saved").alias("end_saved")), "whole")
    stops = stops.select(F.col("rank").alias("last"), "end", "end_leaves", "end_saved")
    listed = ends.repartition("node").sortWithinPartitions("node", "conv_id").select("node", "conv_id").mapInArrow(_hash_ends, "node string, ends_sha256 string")
    out = order.join(stops, "last").join(parents, "parent", "left").join(listed, "node", "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("end_leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("end_saved") - F.col("saved") + F.col("own")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        (F.col("preorder") - 1).alias("preorder"),
        (F.col("end") - 1).alias("subtree_end"),
    )
