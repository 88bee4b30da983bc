"""Sequence packing as a cutting-stock problem solved by column generation."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.llm.merges import Merges, merges_alone
from catalume.llm.pieces import PieceCache
from catalume.llm.storage import materialize, rank_in_cells, ship_package, small_or_not, tidy

LENGTH, END = 1024, 0
#: Words and pieces whose ids a worker remembers.
WORDS_KEPT = 500_000
# -- tokens ------------------------------------------------------------------


def token_bytes(tokenizer_json: str, pattern: str, merges: Merges | None = None) -> PieceCache:
    """Ids by a ``tokenizers`` file as little-endian unsigned 32-bit numbers, each word of the pattern encoded once.

    The tokenizer splits a text by the same pattern before it merges, so the
    ids of a text are those of its words in order. Where the file does no more
    than merge, words up to ``LONGEST`` bytes are merged many at a time (see
    ``merges_alone``, which gives ``merges``); the library, loaded when it is
    first needed, encodes the others.
    """
    library = []

    def encode(words: list[str]) -> list[bytes]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out = merges.encode(raw) if merges else [b""] * len(words)
        left = [i for i, w in enumerate(raw) if w and not out[i]]
        if left and not library:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            library.append(Tokenizer.from_str(tokenizer_json))
            library[0].encode_special_tokens = True
        for i, coded in zip(left, library[0].encode_batch_fast([words[i] for i in left], add_special_tokens=False) if left else [], strict=True):
            out[i] = np.array(coded.ids, "<u4").tobytes()
        return out

    return PieceCache(pattern, encode, WORDS_KEPT)


_caches: dict[tuple[int, str], PieceCache] = {}


def cut_documents(docs: DataFrame, tokenizer_path: str, pattern: str, length: int = LENGTH) -> DataFrame:
    """Pieces of each row's tokens: doc_id, start, length, ids_crc32, doc_tokens.

    A row's ids, then ``END``, are cut into full pieces of ``length`` and a
    rest; a null text has just the END. The tokenizer file is read on the
    driver and broadcast.
    """
    spark = docs.sparkSession
    ship_package(spark)
    text = Path(tokenizer_path).read_text(encoding="utf-8")
    shipped = spark.sparkContext.broadcast((text, merges_alone(text)))
    kind = dict(docs.dtypes)["doc_id"]
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, merges = shipped.value
        key = (hash(file), pattern)
        if key not in _caches:
            _caches[key] = token_bytes(file, pattern, merges)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                row, start, size, crc, total = [], [], [], [], []
                for i, coded in enumerate(_caches[key].encode_batch(part.column(1))):
                    ids = coded.tobytes() + end
                    tokens = len(ids) // 4
                    for begin in range(0, tokens, length):
                        piece = ids[4 * begin : 4 * (begin + length)]
                        row.append(i)
                        start.append(begin)
                        size.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(tokens)
                numbers = [pa.array(x, pa.int64()) for x in (start, size, crc, total)]
                ids_of = part.column(0).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids_of, *numbers], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    fields = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return docs.select("doc_id", "text").mapInArrow(tidy(run), fields)


# -- patterns ----------------------------------------------------------------


@dataclass(frozen=True)
class Pattern:
    """What one kind of sequence holds (length -> count) and how many sequences there are."""

    holds: dict[int, int]
    times: int


def _price(value: np.ndarray, sizes: np.ndarray, length: int) -> tuple[float, dict[int, int]]:
    """The knapsack's best value and filling, by dynamic programming over the room left."""
    best, pick = np.zeros(length + 1), np.full(length + 1, -1)
    useful = value > 0
    of, worth = sizes[useful], value[useful]
    for room in range(1, length + 1):
        fits = np.searchsorted(of, room, "right")
        best[room] = best[room - 1]
        if fits:
            sums = worth[:fits] + best[room - of[:fits]]
            at = int(sums.argmax())
            if sums[at] > best[room] + 1e-12:
                best[room], pick[room] = sums[at], of[at]
    holds: dict[int, int] = {}
    room = length
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            holds[int(pick[room])] = holds.get(int(pick[room]), 0) + 1
            room -= int(pick[room])
    return float(best[length]), holds


def solve_patterns(demand: dict[int, int], length: int = LENGTH, grid: int = 8, gap: float = 0.002, pivots: int = 4000) -> list[Pattern]:
    """Patterns that hold each length as often as ``demand`` says, in few sequences.

    The linear program over all patterns has a row per length, rounded up to
    ``grid``, and is solved by column generation: a revised simplex method
    keeps one pattern per row as its basis, the knapsack program finds the
    pattern that its prices undervalue most, until no pattern is worth more
    than 1 + ``gap``, the tokens themselves need as many sequences, or after
    ``pivots`` exchanges (any basis can be packed by, just less tightly). Prices
    are first drawn halfway to the lengths' shares of a sequence, near which
    the best prices lie. The solution is rounded down; what is left, less than
    one sequence per pattern, is filled largest first into the best fitting
    sequence, at exact lengths. Only the histogram of lengths enters, so the
    work does not grow with the documents.
    """
    left = {s: n for s, n in sorted(demand.items()) if n > 0}
    if not left:
        return []
    room = length // grid
    rows: dict[int, list[int]] = {}
    for s in left:
        rows.setdefault(-(-s // grid), []).append(s)
    sizes = np.array(list(rows), np.int64)
    need = np.array([sum(left[s] for s in rows[int(size)]) for size in sizes], np.float64)
    place = {int(s): i for i, s in enumerate(sizes)}
    basis = [{int(s): room // int(s)} for s in sizes]
    inverse = np.diag(1.0 / (room // sizes))
    amounts = inverse @ need
    share = sizes / room
    floor = float(need @ share)
    for _ in range(pivots):
        if amounts.sum() <= floor * (1 + gap):
            break
        prices = inverse.sum(axis=0)
        _, holds = _price((prices + share) / 2, sizes, room)
        if sum(prices[place[s]] * n for s, n in holds.items()) <= 1 + gap:
            worth, holds = _price(prices, sizes, room)
            if worth <= 1 + gap:
                break
        column = np.zeros(len(sizes))
        for s, n in holds.items():
            column[place[s]] = n
        move = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(move > 1e-9, amounts / move, np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        amounts = np.maximum(amounts - step * move, 0)
        amounts[out] = step
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
        basis[out] = holds
    patterns = []
    for holds, amount in zip(basis, amounts, strict=True):
        patterns += _draw(holds, int(amount + 1e-9), rows, left)
    return patterns + _best_fit(left, length)


def _draw(holds: dict[int, int], times: int, rows: dict[int, list[int]], left: dict[int, int]) -> list[Pattern]:
    """Fill ``times`` sequences of a pattern of rounded lengths with exact lengths from ``left``, in long runs."""
    wanted = [size for size, n in holds.items() for _ in range(n)]
    drawn = []
    while times > 0:
        exact: dict[int, int] = {}
        for size in wanted:
            s = next((s for s in rows[size] if left[s] > exact.get(s, 0)), None)
            if s is None:
                return drawn
            exact[s] = exact.get(s, 0) + 1
        run = min([times, *(left[s] // n for s, n in exact.items())])
        for s, n in exact.items():
            left[s] -= n * run
        drawn.append(Pattern(exact, run))
        times -= run
    return drawn


def _best_fit(left: dict[int, int], length: int) -> list[Pattern]:
    """The rest, largest first, each into the fullest sequence that has room."""
    rooms: list[list[dict[int, int]]] = [[] for _ in range(length + 1)]
    for s in sorted((s for s, n in left.items() if n > 0), reverse=True):
        for _ in range(left[s]):
            room = next((r for r in range(s, length) if rooms[r]), length)
            holds = rooms[room].pop() if room < length else {}
            holds[s] = holds.get(s, 0) + 1
            rooms[room - s].append(holds)
    same: dict[tuple[tuple[int, int], ...], int] = {}
    for holds in chain.from_iterable(rooms):
        key = tuple(sorted(holds.items(), reverse=True))
        same[key] = same.get(key, 0) + 1
    return [Pattern(dict(k), n) for k, n in same.items()]


def _places(spark: SparkSession, patterns: list[Pattern]) -> DataFrame:
    """Per length: which ranks go to which pattern, where its sequences start and at what offset.

    At most one row per length and pattern.
    """
    rows, base, used = [], 0, {}
    for pattern in patterns:
        offset = 0
        for s, n in sorted(pattern.holds.items(), reverse=True):
            first = used.get(s, 0)
            used[s] = first + n * pattern.times
            rows.append((s, first, used[s], n, base, offset))
            offset += s * n
        base += pattern.times
    return spark.createDataFrame(rows, "length bigint, first bigint, beyond bigint, each bigint, base bigint, at bigint")


# -- assignment --------------------------------------------------------------


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, length: int = LENGTH, rows_a_part: int = 250_000) -> DataFrame:
    """Every token of ``docs`` (doc_id, text) in a sequence of at most ``length`` tokens.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. Null and empty texts have one token; repeated rows
    are packed as often as they stand; an empty table gives an empty result;
    other columns are ignored.

    The histogram of at most ``length`` piece lengths goes to the driver, the
    patterns come back as a broadcast table that it bounds. Pieces of a length
    are ranked in parts that grow in number with them (see ``rank_in_cells``),
    so a frequent length fills no task; a piece's rank says which pattern, sequence and offset it gets.
    """
    spark = docs.sparkSession
    pieces = materialize(cut_documents(docs, tokenizer_path, pattern, length), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    whole = histogram.pop(length, 0)
    patterns = ([Pattern({length: 1}, whole)] if whole else []) + solve_patterns(histogram, length)
    placed, parts = rank_in_cells(pieces, ["length"], ["doc_id", "start", "ids_crc32"], rows_a_part)
    ranked = placed.join(small_or_not(parts.select("length", "sub", "before")), ["length", "sub"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place"))
    spots = _places(spark, patterns).groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("first", "beyond", "each", "base", "at"))).alias("spots")
    )
    met = ranked.join(F.broadcast(spots), "length").withColumn(
        "spot", F.element_at(F.filter("spots", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["beyond"])), 1)
    )
    within = met.withColumn("nth", F.col("rank") - F.col("spot.first"))
    return within.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("spot.base") + F.expr("nth div spot.each")).alias("sequence_id"),
        (F.col("spot.at") + F.col("nth") % F.col("spot.each") * F.col("length")).alias("offset"),
    )
