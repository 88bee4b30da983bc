"""Phrases whose words stand together more often than chance: n-grams as rows, counted by the cluster, scored exactly."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalume.llm.storage import materialize, ship_package

#: Bits of the filter that says which shorter phrases may be frequent: 4 MB, whatever the corpus.
_BITS = 25
#: Bytes of text that a task counts at once.
_SLICE = 4 << 20
#: Lower case for A-Z, one blank, and a line's end for everything that ends a piece.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_EDGE = re.compile(rb"[ \n]")


def _mix(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    key = (key ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return key ^ (key >> np.uint64(29))


def _hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array([*words, ""], dtype=object), categorize=False)[:-1]


def _split(raw: bytes, size: int, reach: int) -> Iterator[tuple[bytes, int]]:
    """A plain text in parts of about ``size`` bytes and where, in each, the first word that belongs to the next one stands.

    A part ends at a word's end and goes on for ``reach`` words, so that every phrase lies whole in the part that it begins in.
    """
    ahead, at = re.compile(rb"(?: *[^ \n]+){0,%d}" % reach), 0
    while len(raw) - at > size:
        edge = _EDGE.search(raw, at + size)
        if not edge:
            break
        yield raw[at : ahead.match(raw, edge.end()).end()], edge.end() - at
        at = edge.end()
    yield raw[at:], len(raw) - at


def _slices(batches: Iterable[pa.RecordBatch], size: int, reach: int) -> Iterator[list[tuple[str, bytes, int]]]:
    held, total = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for part, limit in _split(text.as_buffer().to_pybytes().translate(_PLAIN), size, reach):
                held.append((lang, part, limit))
                total += len(part)
                if total >= size:
                    yield held
                    held, total = [], 0
    if held:
        yield held


def _count(parts: list[tuple[str, bytes, int]], n: int, bits: np.ndarray | None) -> pa.RecordBatch:
    """The distinct phrases of ``n`` words in ``parts`` with their counts; for single words also a row per lang, without a phrase, that counts all."""
    buffer = np.frombuffer(b"\n".join([p for _, p, _ in parts]), np.uint8)
    inside = (buffer != 32) & (buffer != 10)
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, lengths = edges[0::2], edges[1::2] - edges[0::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(buffer[inside])).dictionary_encode()
    code, known = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
    begins = np.cumsum([0, *(len(p) + 1 for _, p, _ in parts)])
    part = np.searchsorted(begins, starts, "right") - 1
    langs, lang = np.unique(np.array([x for x, _, _ in parts], dtype=object), return_inverse=True)
    lang = lang[part]
    piece = np.searchsorted(np.flatnonzero(buffer == 10), starts)
    at = np.flatnonzero((starts - begins[part] < np.array([x for _, _, x in parts])[part])[: max(0, len(starts) - n + 1)])
    at = at[piece[at] == piece[at + n - 1]]
    if bits is not None:
        hashed = _hashes(known.to_pylist())[code]
        key = _mix(np.zeros(1, np.uint64), _hashes(list(langs)))[lang][: len(starts) - n + 2]
        for k in range(n - 1):
            key = _mix(key, hashed[k : k + len(key)])
        maybe = (bits[key >> np.uint64(64 - _BITS + 6)] >> (key >> np.uint64(64 - _BITS)) % np.uint64(64)) & np.uint64(1) == 1
        at = at[maybe[at] & maybe[at + 1]]
    same, one = lang[at], max(1, len(known))
    for k in range(n):
        same = pd.factorize(same * one + code[at + k])[0]
    counts = np.bincount(same)
    first = np.empty(len(counts), np.int64)
    first[same[::-1]] = at[::-1]
    phrase = pc.binary_join_element_wise(*(known.take(pa.array(code[first + k])) for k in range(n)), " ")
    out = [pa.array(langs[lang[first]], pa.string()), phrase, pa.array(counts, pa.int64())]
    if n == 1:
        all_words = np.bincount(lang[at], minlength=len(langs))
        rest = [pa.array(langs, pa.string()), pa.nulls(len(langs), pa.string()), pa.array(all_words, pa.int64())]
        out = [pa.concat_arrays([a, b]) for a, b in zip(out, rest, strict=True)]
    return pa.RecordBatch.from_arrays(out, ["lang", "phrase", "f"])


def _filter_bits(frequent: DataFrame) -> np.ndarray:
    """A bit for each hash of a frequent phrase; brought to the driver as at most 2^19 numbers."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 16):
                some = batch.slice(at, 1 << 16)
                cut = [p.split(" ") for p in some.column(1).to_pylist()]
                key = _mix(np.zeros(1, np.uint64), _hashes(some.column(0).to_pylist()))
                for k in range(len(cut[0])):
                    key = _mix(key, _hashes([w[k] for w in cut]))
                bit = np.uint64(1) << (key >> np.uint64(64 - _BITS)) % np.uint64(64)
                yield pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(64 - _BITS + 6)).astype(np.int32)), pa.array(bit.view(np.int64))], ["slot", "bits"])

    found = frequent.where("phrase is not null").select("lang", "phrase").mapInArrow(hashed, "slot int, bits long")
    table = found.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (_BITS - 6), np.uint64)
    out[table.column("slot").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def frequent_phrases(docs: DataFrame, max_words: int = 5, min_count: int = 100) -> list[DataFrame]:
    """For each length up to ``max_words`` the phrases met ``min_count`` times or more: lang, phrase, f.

    The first table also has each lang's number of words, in a row whose
    phrase is null. Every n-gram is a row that is counted by its own words,
    in the task that met it and then over all; left out beforehand are only
    those whose first or last n-1 words are no frequent phrase of the level
    before, which cannot be frequent themselves. A filter of 2^25 bits tells
    that: a bit that is set by another phrase too lets more through, never
    less.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    levels: list[DataFrame] = []
    for n in range(1, max_words + 1):
        bits = spark.sparkContext.broadcast(_filter_bits(levels[-1])) if levels else None

        def count(batches: Iterable[pa.RecordBatch], n: int = n, bits=bits) -> Iterator[pa.RecordBatch]:
            for parts in _slices(batches, _SLICE, max_words - 1):
                yield _count(parts, n, bits and bits.value)

        counted = rows.mapInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        levels.append(materialize(counted.where((F.col("f") >= min_count) | F.col("phrase").isNull()), f"phrases-{n}"))
        if bits:
            bits.destroy()
    return levels


def _cut(k: int, first: bool) -> F.Column:
    """The first ``k`` words of ``phrase``, or those behind them."""
    head = F.substring_index("phrase", " ", k)
    return head if first else F.substring(F.col("phrase"), F.length(head) + 2, F.length("phrase"))


def collocations(docs: DataFrame, max_words: int = 5, min_count: int = 100, top: int = 2000, covered: int = 100) -> DataFrame:
    """Each lang's ``top`` phrases by how much oftener their words stand together than chance has it.

    Reads lang and text (null: ``und`` and the empty text); other columns are
    ignored. Texts are lower-cased in A-Z, cut at ``.,;:!?`` and line ends
    into pieces, those at blanks and tabs into words. A candidate is a phrase
    of 2 to ``max_words`` words with ``a`` >= ``min_count`` occurrences; cut
    in two parts met l and r times it scores floor(1000 a n / (l r)) with n
    the lang's words, in decimals of 38 digits; its lowest cut counts (ties:
    the shortest first part). Candidates that stand inside a candidate of one
    word more with at least ``covered`` percent of their count go; as counts
    only fall with length, that finds every longer one too. Returns lang,
    rank, phrase, a, l, r, n, score. Repeated rows count as often as they
    stand. No documents, or no frequent phrase: no rows.

    A lang may hold any share of the rows: counts are made before each
    shuffle, and a lang's best are first sought in 64 parts.
    """
    levels = frequent_phrases(docs, max_words, min_count)
    words = levels[0].where("phrase is null").select("lang", F.col("f").alias("n"))
    counts = levels[0].where("phrase is not null").withColumn("m", F.lit(1))
    for m, level in enumerate(levels[1:], 2):
        counts = counts.unionByName(level.withColumn("m", F.lit(m)))
    long = counts.where("m > 1")
    parts = [F.struct(F.lit(k).alias("k"), _cut(k, True).alias("head"), _cut(k, False).alias("tail"), (F.col("m") > k).alias("real")) for k in range(1, max_words)]
    cuts = long.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.filter(F.array(*parts), lambda p: p["real"])).alias("cut"))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    cuts = cuts.select("lang", "phrase", "a", "cut.k", "cut.head", "cut.tail").join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    exact = {c: F.col(c).cast("decimal(20,0)") for c in "alrn"}
    over = (F.lit(1000).cast("decimal(4,0)") * exact["a"] * exact["n"]).alias("over")
    # a lang's number of words is one row a lang: the join is dealt out by a further key, as one lang may hold most phrases
    deal = F.pmod(F.xxhash64("phrase"), F.lit(64)).cast("int")
    dealt = words.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(63))))
    scored = cuts.withColumn("deal", deal).join(dealt, ["lang", "deal"]).withColumn("over", over).withColumn("under", exact["l"] * exact["r"])
    scored = scored.withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    wider = long.where("m > 2").select("lang", F.col("f").alias("wide"), F.explode(F.array(_inner(True), _inner(False))).alias("phrase"))
    wider = wider.groupBy("lang", "phrase").agg(F.max("wide").alias("wide"))
    hidden = wider.join(long.select("lang", "phrase", "f"), ["lang", "phrase"]).where(100 * F.col("wide") >= covered * F.col("f"))
    best = best.join(hidden.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
    best = best.select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score", deal.alias("deal"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = best.withColumn("place", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("place") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _inner(first: bool) -> F.Column:
    """``phrase`` without its last word, or without its first."""
    blank = F.length(F.substring_index("phrase", " ", -1)) + 1
    return F.substring(F.col("phrase"), F.lit(1), F.length("phrase") - blank) if first else _cut(1, False)
