"""Vectors of texts: a model loaded once in each Python worker, its two prefixes, and a kept table with a manifest."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.functions import text
from catalume.operators import postings, vectors

#: What stands before a text that is searched, and before one that asks.
PASSAGE, QUERY = "passage: ", "query: "
#: Texts that a model gets at once, and their bytes (a longer text comes alone).
AT_ONCE, BYTES = 64, 1 << 20

Encode = Callable[[list[str]], np.ndarray]


@dataclass(frozen=True)
class Model:
    """A model's name, its vectors' length, what makes the function that encodes a list of texts (texts by dim), and what a text becomes first.

    ``table``, if given, is made once by Spark, broadcast, and handed to ``load``.
    """

    name: str
    dim: int
    load: Callable[..., Encode]
    prepare: Callable[[Column], Column] = lambda body: body
    table: Callable[[SparkSession], np.ndarray] | None = None


_loaded: dict[str, Encode] = {}


def _encoder(model: Model, shared: Broadcast | None) -> Encode:
    """The model's function, loaded at this process's first use of it."""
    if model.name not in _loaded:
        _loaded[model.name] = model.load(*([] if shared is None else [shared.value]))
    return _loaded[model.name]


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows over their lengths; a zero row becomes NaN."""
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length == 0, np.nan, length)


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch (key, text) of up to AT_ONCE rows and BYTES bytes of text, one row at least."""
    upto, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(upto):
        fits = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BYTES, "right"))
        size = min(max(fits - at, 1), AT_ONCE)
        yield batch.slice(at, size)
        at += size


def embed(rows: DataFrame, key: str, body: str, model: Model, prefix: str) -> DataFrame:
    """(key, vetor): the unit vector of each text with ``prefix`` before it; a text that the model makes nothing of has none and goes.

    Texts stream through the workers in slices of AT_ONCE, or of BYTES if these are fewer; a worker loads the model once, however many batches it takes.
    """
    kind, spark = dict(rows.dtypes)[key], rows.sparkSession
    shared = spark.sparkContext.broadcast(model.table(spark)) if model.table else None
    model = replace(model, table=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(model, shared)
        for batch in batches:
            for some in _portions(batch):
                made = unit(np.asarray(encode(some.column(1).to_pylist()), np.float64).reshape(some.num_rows, model.dim))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(some.num_rows + 1) * model.dim, pa.int32()), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([some.column(0), lists], [key, "vetor"])

    given = rows.select(key, model.prepare(F.concat(F.lit(prefix), F.coalesce(body, F.lit("")))).alias("entrada"))
    return given.mapInArrow(run, f"{key} {kind}, vetor array<double>").where(~F.isnan(F.element_at("vetor", 1)))


def _md5_heads(words: pa.Array) -> np.ndarray:
    """The first 16 bits of each word's MD5, of many words side by side; of words beyond 55 bytes, which fill more than one block, by the library."""
    _, ends, data = words.buffers()
    at = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    padded = np.zeros(at[-1] + 64, np.uint8)
    padded[: at[-1]] = np.frombuffer(data, np.uint8, at[-1])
    four = np.ndarray(len(padded) - 3, np.uint32, padded, strides=(1,))
    heads = np.empty(len(words), np.uint32)
    for low in range(0, len(words), DIGESTED):
        begins = at[low : min(low + DIGESTED, len(words))]
        size = at[low + 1 : low + 1 + len(begins)] - begins
        held, upto = {}, min(int(size.max()), 55)
        for n in range(upto // 4 + 1):
            left = np.clip(size - 4 * n, -1, 4)
            own = four[np.minimum(begins + 4 * n, len(four) - 1)] & _MD5_KEPT[left]
            held[n] = own | _MD5_ENDS[left]
        held[14] = (held[14] if 14 in held else 0) + (size * 8).astype(np.uint32)
        heads[low : low + len(begins)] = _md5_first(held, len(begins))
    first = (heads & 255) << 8 | heads >> 8 & 255
    for i in np.flatnonzero(np.diff(at) > 55).tolist():
        first[i] = int.from_bytes(hashlib.md5(words[i].as_py().encode()).digest()[:2], "big")
    return first.astype(np.int64)


#: Words whose MD5 is computed at once; of four bytes of which so many (the last item: none, and not its end) are a word's, those kept and the mark of its end.
DIGESTED = 1 << 13
_MD5_KEPT = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF, 0], np.uint32)
_MD5_ENDS = np.array([0x80, 0x8000, 0x800000, 0x80000000, 0, 0], np.uint32)
_MD5_ADDS = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_MD5_TURNS = [[np.uint32(x) for x in turns] for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))]
_MD5_BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_first(held: dict[int, np.ndarray], count: int) -> np.ndarray:
    """The first of the four numbers that make up an MD5, of ``count`` blocks whose 16 numbers are ``held`` (0 if absent)."""
    a, b, c, d = (np.full(count, x, np.uint32) for x in _MD5_BEGIN)
    for i in range(61):  # the three steps behind these do not change the first number
        if i < 16:
            mixed, n = d ^ (b & (c ^ d)), i
        elif i < 32:
            mixed, n = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            mixed, n = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mixed, n = c ^ (b | ~d), 7 * i % 16
        mixed += a
        mixed += _MD5_ADDS[i]
        if n in held:
            mixed += held[n]
        turn = _MD5_TURNS[i // 16][i % 4]
        turned = mixed << turn
        turned |= mixed >> np.uint32(32 - turn)
        turned += b
        a, b, c, d = d, turned, b, c
    return b + np.uint32(_MD5_BEGIN[0])


def hashed(dim: int) -> Model:
    """A stand-in where no model is at hand: a text's tokens counted at the places that the first 16 bits of their MD5 name."""

    def load(folds: np.ndarray) -> Encode:
        def encode(texts: list[str]) -> np.ndarray:
            terms, sizes = postings.cut(pa.array(texts, pa.string()), folds)
            coded = terms.dictionary_encode()
            at = (_md5_heads(coded.dictionary) % dim)[coded.indices.to_numpy()]
            return np.bincount(np.repeat(np.arange(len(texts)), sizes) * dim + at, minlength=len(texts) * dim).reshape(len(texts), dim)

        return encode

    return Model(f"hash/{dim}", dim, load, table=text.fold_table)


def keep_vectors(cards: DataFrame, body: str, model: Model, path: str, version: str) -> None:
    """Embed ``cards`` (id and ``body``) and keep their vectors and a manifest: model, version of the catalog, dimensions, rows, without.

    Written behind the vectors, so a table without a manifest was not finished. Vectors of a wrong size or length are
    refused; texts without vector are counted.
    """
    spark = cards.sparkSession
    embed(cards, "id", body, model, PASSAGE).write.mode("overwrite").parquet(f"{path}/vectors")
    made = spark.read.parquet(f"{path}/vectors")
    gate = vectors.gates(made, made.select("id"), model.dim)
    vectors.require(gate, "passed", "vectors do not fit")
    seen = cards.agg(F.count("*").alias("cards")).join(gate.select("vectors"))
    seen.select(
        F.lit(model.name).alias("modelo"), F.lit(version).alias("versao"), F.lit(model.dim).alias("dimensoes"), F.col("vectors").alias("vetores"), (F.col("cards") - F.col("vectors")).alias("sem_vetor")
    ).write.mode("overwrite").parquet(f"{path}/manifest")


def kept_vectors(spark: SparkSession, path: str, model: Model, version: str) -> DataFrame:
    """The vectors (id, vetor) kept at ``path``; refused if they were made by another model or for another state of the catalog."""
    manifest = spark.read.parquet(f"{path}/manifest").first()
    want = (model.name, version, model.dim)
    if manifest is None or (manifest.modelo, manifest.versao, manifest.dimensoes) != want:
        raise ValueError(f"vectors were made for {manifest and manifest.asDict()}, wanted {want}")
    return spark.read.parquet(f"{path}/vectors")
