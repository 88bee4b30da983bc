"""SimHash near-duplicates linked through covering masks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalume.llm.storage import materialize, remove, ship_package
from catalume.llm.survivors import keep_first, text_key

BITS, RADIUS, SEED, SHINGLE = 64, 3, 42, 3
#: Shingle hashes counted at once.
_BLOCK = 16_384


def shingle_hashes(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """XXH64 of a text's runs of ``words`` words (of all words of a shorter text) in order, repeats included.

    A-Z are lower-cased; words are runs without ASCII white space; no word: no hash.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half of the hashes; none: 0."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        rows = hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.nonzero(counts * 2 > len(hashes))[0].tolist())


def simhash(text: str | None, words: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text's shingles."""
    return majority(shingle_hashes(text, words))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, key, fp): each row's text key and SimHash as a signed long. A null text is empty; other columns are ignored."""
    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array((_signed(simhash(x.as_py(), words)) for x in batch.column(2)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["doc_id", "key", "fp"])

    return docs.select("doc_id", text_key(docs).alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key bigint, fp bigint")


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks such that any ``radius`` bits lie outside at least one of them.

    Bit i gets a non-zero vector m(i) over GF(2) of radius+1 places, in turn.
    Mask v keeps the bits with <m(i), v> = 1. Any ``radius`` vectors leave some
    v orthogonal to all of them, and that mask keeps none of their bits.
    """
    vectors = (1 << (radius + 1)) - 1
    return [
        sum(1 << i for i in range(bits) if ((i % vectors + 1) & v).bit_count() % 2)
        for v in range(1, vectors + 1)
    ]


def links(points: DataFrame, max_bucket: int = 64, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that join the distinct fingerprints ``points`` (fp) as linking at ``radius`` bits does.

    Fingerprints meet in the buckets of their masked values. In a bucket of up
    to ``max_bucket`` every close pair is an edge. Fingerprints of a larger
    bucket are joined exactly without pairs: each announces the points within
    half the radius of it (rounded down) and asks at those at half of it
    (rounded up); two fingerprints are within the radius just if one announces
    a point at which the other asks, and all who meet at a point are then
    linked to one that announces it. At 3 bits that is 2,081 rows for each
    fingerprint concerned, whatever the bucket's size. Spark judges tables of
    rows that each become many by the size before that and would gather them
    on the driver for a broadcast, so their joins are told to shuffle.
    """
    close = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= radius
    masks = F.array(*(F.lit(_signed(m)) for m in covering_masks(radius=radius)))
    keyed = points.select("fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("mask", "key"))
    sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialize(sizes.withColumn("large", F.col("n") > max_bucket), "buckets")
    # the further key has both sides dealt out for the join, so that large partitions can be split
    met = keyed.withColumn("deal", F.hash("key")).hint("merge").join(sizes.withColumn("deal", F.hash("key")), ["mask", "key", "deal"])
    met = materialize(met.select("fp", "mask", "key", "large"), "bucket-members")
    small = met.where("not large").select("fp", "mask", "key")
    other = small.select(F.col("fp").alias("b"), "mask", "key")
    pairs = small.join(other, ["mask", "key"]).where((F.col("fp") < F.col("b")) & close(F.col("fp"), F.col("b"))).select(F.col("fp").alias("a"), "b")
    dense = met.where("large").select("fp").distinct()
    flips = lambda n: F.array(*(F.lit(_signed(sum(1 << i for i in some))) for some in combinations(range(BITS), n)))
    near = dense.select("fp", F.explode(F.concat(*map(flips, range(radius // 2 + 1)))).alias("flip"), F.lit(True).alias("announced"))
    far = dense.select("fp", F.explode(flips(radius - radius // 2)).alias("flip"), F.lit(False).alias("announced"))
    stands = near.unionByName(far).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "announced")
    hubs = stands.where("announced").groupBy("point").agg(F.min("fp").alias("hub"))
    stands, hubs = (df.withColumn("deal", F.hash("point")) for df in (stands, hubs))
    spokes = stands.hint("merge").join(hubs, ["point", "deal"]).where("fp <> hub").select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b"))
    return pairs.unionByName(spokes).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the smallest node it is connected with.

    Large and small stars in turn: each node hands its larger neighbours, then
    its smaller ones, to the smallest neighbour, until every edge leads to its
    component's root. Every round is written to the shared folder. Minima are
    taken before rows meet, so no node's neighbours are gathered.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, larger: bool) -> DataFrame:
        around = both(e) if larger else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = around.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"), F.hash("a").alias("deal"))
        around = around.withColumn("deal", F.hash("a"))
        if larger:
            around = around.where("b > a")
        met = around.join(least, ["a", "deal"]).select(F.col("low").alias("a"), "b")
        if not larger:
            met = met.unionByName(least.select(F.col("low").alias("a"), F.col("a").alias("b")))
        return met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def stamp(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = stamp(edges)
    while before[0]:
        last, edges = edges, materialize(star(star(edges, True), False), "edges")
        remove(last)
        after = stamp(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )


def near_duplicates(docs: DataFrame, max_bucket: int = 64, words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id.

    Fingerprints (16 hex digits) link at ``radius`` or fewer differing bits;
    component_id is the smallest doc_id reachable. A null or empty text has
    fingerprint zero, linked like any other. Repeated rows get a row each,
    null doc_ids count only if a component has no other; an empty table gives
    an empty result; other columns are ignored. Copies are linked as one
    fingerprint, however many there are.
    """
    rows = materialize(fingerprints(docs, words), "fingerprints")
    points = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "points")
    found = components(links(points.select("fp"), max_bucket, radius))
    tied = points.join(found, points["fp"] == found["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = tied.groupBy("root").agg(F.min("low").alias("component_id"))
    named = tied.select("fp", "root", F.hash("root").alias("deal")).join(low.withColumn("deal", F.hash("root")), ["root", "deal"])
    named = named.select("fp", F.hash("fp").alias("deal"), "component_id")
    placed = rows.withColumn("deal", F.hash("fp")).join(named, ["fp", "deal"])
    return placed.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, max_bucket: int = 64, words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component of fingerprints, all columns as they are; see ``keep_first`` for which."""
    rows = materialize(fingerprints(docs, words), "fingerprints")
    linked = components(links(rows.select("fp").distinct(), max_bucket, radius))
    return keep_first(docs, rows.select("doc_id", "key", F.col("fp").alias("node")), linked)
