"""Near copies by Jaccard similarity of word shingles: SimHash and MinHash find candidates, whole sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalume.llm.simhash import components, links, majority, shingle_hashes
from catalume.llm.storage import materialize, remove, ship_package, small_or_not, tidy
from catalume.llm.survivors import keep_first, text_key

WORDS, SIMILARITY, RADIUS, BANDS, ROWS, SEED = 5, 0.8, 3, 24, 5, 42
#: Members of a bucket whose pairs are all looked at; of larger ones those that one task holds against as many others.
BUCKET, BLOCK = 32, 256
#: Shingle hashes of a block's side: 8 MB, and one set more, however long.
HASHES = 1 << 20
#: Shingle hashes taken at once.
_AT_ONCE = 2_048
_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(shingle_hashes(text, words))


def bands(found: np.ndarray) -> list[int]:
    """BANDS unsigned hashes of ROWS minima each; none for an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _AT_ONCE):
        least = np.minimum(least, (found[None, at : at + _AT_ONCE] * _FACTORS + _TERMS).min(axis=1))
    return [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))]


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _point(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def points(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, key, point, n, fp, bands): each row's text key, the hash of its shingle set, its size, SimHash and bands."""
    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, prints, keys = [], [], [], []
            for x in batch.column(2):
                hashes = shingle_hashes(x.as_py(), words)
                found = np.unique(hashes)
                names.append(_point(found))
                sizes.append(len(found))
                prints.append(majority(hashes))
                keys.append(_signed(bands(found)))
            columns = [pa.array(_signed(names)), pa.array(sizes, pa.int64()), pa.array(_signed(prints)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "key", "point", "n", "fp", "bands"])

    rows = docs.select("doc_id", text_key(docs).alias("key"), "text")
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, key bigint, point bigint, n bigint, fp bigint, bands array<bigint>")


def sets(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(point, held): the shingle set of each row of ``texts`` (text)."""
    ship_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                held = [shingles(x.as_py(), words) for x in batch.column(0).slice(at, 512)]
                columns = [pa.array(_signed([_point(x) for x in held])), pa.array([x.view(np.int64) for x in held], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["point", "held"])

    return texts.select("text").mapInArrow(tidy(run), "point bigint, held array<bigint>")


def _dealt(df: DataFrame, by: str) -> DataFrame:
    """A further join key: with it both sides are dealt out for the join, so that large partitions can be split."""
    return df.withColumn("deal", F.hash(by))


def _fits(a: Column, b: Column, similarity: float) -> Column:
    """Sets of these sizes can be that similar."""
    return F.least(a, b) / F.greatest(a, b) >= similarity


def bucket_members(found: DataFrame, max_bucket: int = BUCKET) -> DataFrame:
    """(point, n, band, key, large): who shares a band's value with others, and whether more than ``max_bucket`` do."""
    keyed = found.select("point", "n", F.posexplode("bands").alias("band", "key"))
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("rows")).where("rows > 1")
    sizes = materialize(sizes.select("band", "key", (F.col("rows") > max_bucket).alias("large")), "bands")
    # a merge: Spark judges ``keyed`` by its size before each row became many, and would broadcast it
    met = materialize(_dealt(keyed, "key").hint("merge").join(_dealt(sizes, "key"), ["band", "key", "deal"]).drop("deal"), "band-members")
    remove(sizes)
    return met


def candidates(found: DataFrame, met: DataFrame, similarity: float = SIMILARITY, max_bucket: int = BUCKET, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: pairs of ``found`` (point, n, fp, bands) to be compared first, in number proportional to the points.

    Points whose SimHashes are linked through the covering masks; all pairs of
    a small bucket of ``met``; the members of a large one with its smallest
    point, and with the smallest of those that share the next band too.
    """
    prints = found.groupBy("fp").agg(F.min("point").alias("first"))
    same = found.select("fp", "point", F.hash("fp").alias("deal")).join(_dealt(prints, "fp"), ["fp", "deal"]).where("first < point")
    close = links(prints.select("fp"), radius=radius)
    close = close.join(prints.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    alike = same.select(F.col("first").alias("a"), F.col("point").alias("b")).unionByName(close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    small = met.where("not large").select(F.col("point").alias("a"), F.col("n").alias("n_a"), "band", "key")
    other = small.select(F.col("a").alias("b"), F.col("n_a").alias("n_b"), "band", "key")
    pairs = small.join(other, ["band", "key"]).where((F.col("a") < F.col("b")) & _fits(F.col("n_a"), F.col("n_b"), similarity))
    dense = met.where("large").select("point", "n", "band", "key")
    after = met.select("point", F.pmod(F.col("band") - 1, F.lit(BANDS)).alias("band"), F.col("key").alias("next"))
    dense = dense.unionByName(dense.join(after, ["point", "band"]).select("point", "n", "band", F.xxhash64("key", "next").alias("key")))
    hubs = dense.groupBy("band", "key").agg(F.min(F.struct("point", "n")).alias("hub"))
    spokes = _dealt(dense, "key").join(_dealt(hubs, "key"), ["band", "key", "deal"])
    spokes = spokes.where((F.col("hub.point") < F.col("point")) & _fits(F.col("n"), F.col("hub.n"), similarity))
    spokes = spokes.select(F.col("hub.point").alias("a"), F.col("point").alias("b"))
    return alike.unionByName(pairs.select("a", "b")).unionByName(spokes).distinct()


def similar_pairs(pairs: DataFrame, held: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The ``pairs`` (a, b) whose whole shingle sets ``held`` have the Jaccard similarity."""

    def side(name: str) -> DataFrame:
        return _dealt(held.select(F.col("point").alias(name), F.col("held").alias(f"held_{name}")), name)

    met = _dealt(_dealt(pairs, "a").join(side("a"), ["a", "deal"]), "b").join(side("b"), ["b", "deal"])
    met = met.withColumn("shared", F.size(F.array_intersect("held_a", "held_b")))
    return met.where(F.col("shared") / (F.size("held_a") + F.size("held_b") - F.col("shared")) >= similarity).select("a", "b")


def _forest(left: pa.Table, right: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """Links between sets of two blocks (point, root, held) that join different roots; of each pair of roots at most one way."""

    def flat(side: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        held = side.column("held").combine_chunks()
        sizes = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        return held.flatten().to_numpy(zero_copy_only=False), sizes

    (own, own_n), (other, other_n) = flat(left), flat(right)
    common = np.intersect1d(own, other)
    shared = np.zeros((len(own_n), len(other_n)))
    for at in range(0, len(common), 4096):
        part = common[at : at + 4096]
        sides = []
        for values, sizes in ((own, own_n), (other, other_n)):
            place = np.minimum(np.searchsorted(part, values), len(part) - 1)
            there = part[place] == values
            table = np.zeros((len(sizes), len(part)), np.float32)
            table[np.repeat(np.arange(len(sizes)), sizes)[there], place[there]] = 1
            sides.append(table)
        shared += sides[0] @ sides[1].T
    alike = shared / (own_n[:, None] + other_n[None, :] - shared) >= similarity
    roots = [side.column("root").to_numpy() for side in (left, right)]
    names = [side.column("point").to_pylist() for side in (left, right)]
    joined: dict[int, int] = {}

    def find(root: int) -> int:
        while root in joined:
            root = joined[root]
        return root

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(alike & (roots[0][:, None] != roots[1][None, :]))), strict=True):
        a, b = find(int(roots[0][i])), find(int(roots[1][j]))
        if a != b:
            joined[max(a, b)] = min(a, b)
            out.append((min(names[0][i], names[1][j]), max(names[0][i], names[1][j])))
    return out


def settle(met: DataFrame, linked: DataFrame, held: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, hashes: int = HASHES) -> DataFrame | None:
    """Links (a, b) between members of large buckets of ``met`` that ``linked`` (node, root) holds in different groups.

    Where a large bucket still has several groups, each member outside of its
    largest one is held against all members, in blocks of about ``block``
    members or ``hashes`` shingle hashes a side, whichever is fewer, and a
    block gives no more links than it has groups. Members are dealt to blocks
    by size, so that those too unlike in size to be similar share none: a
    block is met only where the sizes in it allow. None where every large
    bucket is one group.
    """
    dense = met.where("large").select("point", "n", "band", "key").join(linked.withColumnRenamed("node", "point"), "point", "left")
    dense = dense.withColumn("root", F.coalesce("root", "point")).withColumn("size", F.floor(F.log2(F.greatest("n", F.lit(1)))).cast("int"))
    groups = dense.groupBy("band", "key", "root").agg(F.count("*").alias("rows"))
    open_ = groups.groupBy("band", "key").agg(F.count("*").alias("groups"), F.max(F.struct("rows", "root")).alias("main"))
    open_ = materialize(open_.where("groups > 1").select("band", "key", F.col("main.root").alias("main")), "open-buckets")
    if open_.isEmpty():
        return None
    rows = _dealt(dense, "key").join(_dealt(open_, "key"), ["band", "key", "deal"]).drop("deal")
    parts = lambda chosen: F.ceil(F.greatest(F.sum(F.when(chosen, 1).otherwise(0)) / block, F.sum(F.when(chosen, F.col("n")).otherwise(0)) / hashes)).cast("int")
    cells = rows.groupBy("band", "key", "size").agg(parts(F.lit(True)).alias("all"), parts(F.col("root") != F.col("main")).alias("few"))
    cells = materialize(cells, "open-cells")
    own = lambda n: F.pmod(F.xxhash64("point"), F.greatest(F.col(n), F.lit(1))).cast("int")
    every = lambda n: F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>")))
    # sets at least 0.8 alike differ in size by a quarter at most: their sizes' powers of two are the same or neighbours
    reach = int(np.ceil(-np.log2(similarity))) if similarity > 0 else 64
    near = F.explode(F.sequence(F.col("size") - reach, F.col("size") + reach))
    sides = cells.select("band", "key", F.col("size").alias("of"), F.col("all").alias("all_of"), F.col("few").alias("few_of"))
    own_cell = rows.join(cells, ["band", "key", "size"])
    columns = ["band", "key", "point", "root"]
    left = own_cell.where("root <> main").select(*columns, F.col("size").alias("x"), own("few").alias("i"), near.alias("of"))
    left = left.join(sides, ["band", "key", "of"]).select(*columns, "x", "i", F.col("of").alias("y"), every("all_of").alias("j"), F.lit(True).alias("asks"))
    right = own_cell.select(*columns, F.col("size").alias("y"), own("all").alias("j"), near.alias("of"))
    right = right.join(sides, ["band", "key", "of"]).select(*columns, F.col("of").alias("x"), every("few_of").alias("i"), "y", "j", F.lit(False).alias("asks"))
    met_blocks = left.select(*columns, "x", "i", "y", "j", "asks").unionByName(right.select(*columns, "x", "i", "y", "j", "asks"))
    met_blocks = _dealt(met_blocks, "point").join(_dealt(held, "point"), ["point", "deal"]).drop("deal")

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks")
        found = _forest(table.filter(asks), table.filter(pa.compute.invert(asks)), similarity)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    found = met_blocks.groupBy("band", "key", "x", "i", "y", "j").applyInArrow(run, "a bigint, b bigint")
    return materialize(found.distinct(), "further-links")


def linked_points(docs: DataFrame, found: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, max_bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(node, root) of the points of ``found`` (point, n, fp, bands, key) that are linked with others.

    ``key`` names one text of each point. Sets are made anew for the points
    that are compared, not kept for all.
    """
    met = bucket_members(found, max_bucket)
    pairs = materialize(candidates(found, met, similarity, max_bucket), "candidates")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("point")).unionByName(met.where("large").select("point")).distinct()
    texts = materialize(found.join(asked, "point").select(F.col("key").alias("_key")), "compared")
    keyed = docs.select("text", text_key(docs).alias("_key"))
    held = materialize(sets(keyed.join(small_or_not(texts), "_key", "left_semi").dropDuplicates(["_key"]), words), "sets")
    linked = components(similar_pairs(pairs, held, similarity))
    further = settle(met, linked, held, similarity, block)
    if further is not None and not further.isEmpty():
        linked = components(further.unionByName(linked.select(F.col("root").alias("a"), F.col("node").alias("b"))))
    for done in (met, pairs, texts, held):
        remove(done)
    return linked


def drop_similar(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, max_bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each group of near copies, all columns as they are; see ``keep_first`` for which.

    Texts are linked if the sets of their ``words``-word shingles have a
    Jaccard similarity of ``similarity`` or more; groups are what links
    connect. Candidates are pairs whose SimHashes the covering masks link and
    pairs that share one of BANDS bands of ROWS MinHash values: a pair at 0.8
    shares one with a chance of 0.9999, a closer one more likely. Whole sets
    decide. Null texts and texts without words are alike; an empty table gives
    an empty result.
    """
    rows = materialize(points(docs, words), "points")
    found = rows.groupBy("point").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    found = materialize(found, "sets-of-points")
    linked = linked_points(docs, found, words, similarity, max_bucket, block)
    remove(found)
    return keep_first(docs, rows.select("doc_id", "key", F.col("point").alias("node")), linked)
