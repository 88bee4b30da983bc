"""Quality classifier: averaged subword embeddings and a softmax, trained by stochastic gradient descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalume.llm.storage import ship_package, tidy

#: Rows of the embedding table, its width, the lengths of character n-grams.
BUCKETS, WIDTH, GRAMS = 1 << 16, 8, (3, 4)
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
#: Code points whose features are computed at once.
_AT_ONCE = 1 << 18


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    mixed = hashes * _MIX
    return ((mixed ^ mixed >> np.uint64(32)) * _FACTOR >> np.uint64(48)).astype(np.int64) % BUCKETS


def features(text: str) -> Iterator[np.ndarray]:
    """Buckets of a text's words and character n-grams, in pieces; each is counted once, wherever pieces end.

    White space counts as one blank, also at both ends. An n-gram belongs to the piece it starts
    in; the hash of a word that reaches into further pieces is carried on.
    """
    points = np.frombuffer(f" {' '.join(text.split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < 3:
        return
    begun, long = 0, 0
    for at in range(0, len(points), _AT_ONCE):
        piece = points[at : at + _AT_ONCE + max(GRAMS) - 1].astype(np.uint64)
        own = piece[:_AT_ONCE]
        found = []
        for n in GRAMS:
            starts = min(len(own), len(piece) - n + 1)
            if starts > 0:
                hashes = np.full(starts, n, np.uint64)
                for i in range(n):
                    hashes = hashes * _FACTOR + piece[i : starts + i]
                found.append(_bucket(hashes))
        # a word's hash is the sum of factor^i x point from its start; running sums over factor^start give it anywhere
        sums = np.concatenate(([np.uint64(0)], np.add.accumulate(_powers(_FACTOR, len(own)) * own)))
        blanks = np.nonzero(own == 32)[0]
        first = int(blanks[0]) if len(blanks) else len(own)
        begun = (begun + pow(int(_FACTOR), long, 1 << 64) * int(sums[first])) % (1 << 64)
        long += first
        if len(blanks):
            inverse = _powers(_INVERSE, len(own) + 1)
            starts, ends = blanks[:-1] + 1, blanks[1:]
            hashes = (sums[ends] - sums[starts]) * inverse[starts]
            found.append(_bucket(np.append(hashes, np.uint64(begun)) if long else hashes))
            rest = int(blanks[-1]) + 1
            begun, long = (int(sums[-1]) - int(sums[rest])) * int(inverse[rest]) % (1 << 64), len(own) - rest
        yield np.concatenate(found) if found else np.zeros(0, np.int64)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct buckets, in order, and how often each occurs, as unsigned 16- and 32-bit numbers."""
    total = np.zeros(BUCKETS, np.uint32)
    for found in features(text or ""):
        total += np.bincount(found, minlength=BUCKETS).astype(np.uint32)
    at = np.nonzero(total)[0]
    return at.astype(np.uint16), total[at]


@dataclass(frozen=True)
class Model:
    """Embeddings and the softmax layer; for scoring each bucket's difference of logits suffices."""

    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def margins(self) -> np.ndarray:
        return self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def score(text: str | None, margins: np.ndarray, offset: float) -> float:
    """Probability of label 1: the softmax of the averaged vectors; a text without words gets the bias alone."""
    total, count = 0.0, 0
    for found in features(text or ""):
        total += float(margins[found].sum())
        count += len(found)
    return float(0.5 * (1 + np.tanh((total / max(1, count) + offset) / 2)))


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 8, rate: float = 0.08, seed: int = 0) -> Model:
    """Fit by stochastic gradient descent, one document a step, the rate falling to zero.

    Samples: buckets, counts (see ``counted``), label. A document is the mean
    of the vectors of its words and n-grams. Without samples of both labels the score is their share (a half for none).
    """
    random = np.random.default_rng(seed)
    embeddings = random.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    weights, bias = np.zeros((WIDTH, 2)), np.zeros(2)
    labels = np.array([y for *_, y in samples], np.int64)
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias[:] = np.log(1 - share), np.log(share)
    if len(set(labels.tolist())) < 2:
        return Model(embeddings, weights, bias)
    steps, done = epochs * len(samples), 0
    for _ in range(epochs):
        for i in random.permutation(len(samples)).tolist():
            at, counts, _ = samples[i]
            at, share_of = at.astype(np.int64), counts / max(1, counts.sum())
            pace = rate * (1 - done / steps)
            done += 1
            hidden = share_of @ embeddings[at]
            logits = hidden @ weights + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[labels[i]] -= 1
            back = weights @ error
            weights -= pace * np.outer(hidden, error)
            bias -= pace * error
            # a vector's gradient is scaled up by the document's number of features, as each would get its own step
            embeddings[at] -= pace * np.outer(share_of * len(at), back)
    return Model(embeddings, weights, bias)


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the doc_id's digits is divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_documents: int = 2400) -> Model:
    """A model from the documents labelled for quality, without those held out.

    At most ``max_documents`` labelled rows are used, those of the smallest
    hashes of their doc_id, whole texts each; a doc_id labelled more than once
    has the mean label, rounded up, one that stands on several texts the text
    of the smallest hash. Their ids are broadcast; their buckets and counts,
    six bytes each and ``BUCKETS`` pairs a row at most, go to the driver.
    """
    ship_package(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents).select(F.col("doc_id").alias("_id"), "label")
    texts = docs.select(F.col("doc_id").alias("_doc"), F.coalesce("text", F.lit("")).alias("text"))
    met = texts.join(F.broadcast(chosen), texts["_doc"] == chosen["_id"]).groupBy("_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    kind = dict(met.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counted(x.as_py()) for x in batch.column(2)]
            sides = [pa.array([x[i].tobytes() for x in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sides], ["_id", "label", "buckets", "counts"])

    rows = sorted(met.mapInArrow(tidy(run), f"_id {kind}, label int, buckets binary, counts binary").collect(), key=lambda r: r["_id"])
    return train([(np.frombuffer(r["buckets"], np.uint16), np.frombuffer(r["counts"], np.uint32), r["label"]) for r in rows])


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text).

    ``score`` is the probability of label 1 by the text alone; a null text is
    empty, an empty one gets the model's prior. ``predicted`` is 1 from
    ``threshold`` on. Repeated rows get a row each, a null doc_id is not held
    out; an empty table gives an empty result; other columns are ignored. The
    broadcast model has ``BUCKETS`` numbers.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast((model.margins(), model.offset()))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins, offset = shared.value
        for batch in batches:
            scores = [score(x.as_py(), margins, offset) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double")
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, max_documents: int = 2400) -> DataFrame:
    """Fit on the labelled rows of ``docs`` and score them all; see ``fit`` and ``score_documents``."""
    return score_documents(docs, fit(docs, labels, max_documents))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose score is below ``threshold``, all columns as they are."""
    spark = docs.sparkSession
    ship_package(spark)
    model = fit(docs, labels)
    shared = spark.sparkContext.broadcast((model.margins(), model.offset()))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins, offset = shared.value
        for batch in batches:
            yield batch.filter(pa.array([score(x.as_py(), margins, offset) >= threshold for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
