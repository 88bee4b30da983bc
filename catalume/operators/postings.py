"""Postings in blocks: a term's documents, columns and positions as arrays, with what a search may know without reading them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalume.functions import text

#: Documents of a block at most; bytes of text that a task cuts at once; documents of terms that it puts into blocks at once.
BLOCK, CUT, MERGED = 256, 1 << 20, 1 << 18
#: A slice's row of a term with so many documents makes blocks of its own, wherever the term's other rows are; such rows go to so many places.
ALONE, SPREAD = 64, 64
#: Rows of scores that are made at once, and added up at once; places of a sieve of terms.
PASSED, ADDED, SIEVE = 1 << 18, 1 << 20, 1 << 21

#: The lists of a row and their items. Between tasks and in files a list is the bytes of its items: Spark then copies it whole.
LISTS = {"docs": np.int64, "lengths": np.int32, "times": np.int32, "cols": np.int8, "pos": np.int32}
#: A term's documents in a slice of the table; a row without term has all documents of the slice and their lengths.
SLICE = "term string, low bigint, docs binary, lengths binary, times binary, cols binary, pos binary"
HEAD = "term string, n int, n_text int, least int, most array<int>, low bigint, high bigint, "
PACKED = HEAD + "docs binary, lengths binary, times binary, cols binary, pos binary"
SCHEMA = HEAD + "docs array<bigint>, lengths array<int>, times array<int>, cols array<tinyint>, pos array<int>"


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _bytes(offsets: np.ndarray, values: np.ndarray, name: str) -> pa.Array:
    """Lists, by where each begins and the last one ends, as the bytes of their items."""
    items = np.ascontiguousarray(values, LISTS[name])
    ends = pa.py_buffer((offsets * items.itemsize).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, ends, pa.py_buffer(items.tobytes())])


def _held(column: pa.Array, name: str) -> tuple[np.ndarray, np.ndarray]:
    """How many items each list of a column has, and all items; of lists or of their bytes."""
    if pa.types.is_list(column.type):
        return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    items = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return np.diff(at) // np.dtype(LISTS[name]).itemsize, items.view(LISTS[name])


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _before(sizes: np.ndarray) -> np.ndarray:
    """Running sums of ``sizes`` with 0 in front: where each list begins, and the last one ends."""
    return np.append(0, np.cumsum(sizes, dtype=np.int64))


def _moved(sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where the items of lists of ``sizes`` are found when the lists stand in ``order``."""
    own = sizes[order]
    return np.arange(own.sum()) + np.repeat(_before(sizes)[order] - _before(own)[:-1], own)


def _points(whole: str, folds: np.ndarray) -> np.ndarray:
    """What ``folds`` makes of each character; as bytes where all of it is below 256, which is a fourth of what to go through."""
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    wide, narrow = np.flatnonzero(codes > 255), folds[:256]
    made = folds[codes[wide]]
    if (made < 0).any() or (made > 255).any() or (narrow < 0).any() or (narrow > 255).any():
        return folds[codes]
    points = np.frombuffer(whole.encode("latin-1", "replace").translate(narrow.astype(np.uint8).tobytes()), np.uint8)
    if len(wide):
        points = points.copy()
        points[wide] = made
    return points


def _letters(points: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The letters among ``points`` (those above 0), and the same in UTF-8."""
    if points.dtype == np.uint8:
        letters = points.tobytes().translate(None, b"\0")
        return np.frombuffer(letters, np.uint8), letters if letters.isascii() else letters.decode("latin-1").encode()
    letters = points[points > 0]
    return letters, letters.tobytes().decode("utf-32-le").encode()


def cut(texts: pa.Array, folds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all ``texts`` (``text.tokens``), and how many each has; ``folds`` is ``text.fold_table``."""
    said = [(x or b"").decode("utf-8", "replace") for x in texts.cast(pa.binary()).to_pylist()]
    whole = "\n".join(said) + "\n"
    if "\u03a3" in whole:  # the one letter whose lower case depends on its neighbours
        whole = whole.replace("\u0130", "i").lower()
    points = _points(whole, folds)
    starts = _before(np.fromiter((len(x) + 1 for x in said), np.int64, len(said)))
    if points.dtype != np.uint8 and not (stays := points >= 0).all():
        starts, points = _before(stays)[starts], points[stays]
    inside = points > 0
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # the last one is behind the last token: a line's end is none
    if inside[0]:
        turns = np.append(0, turns)
    begins, ends = turns[::2], turns[1::2]
    letters, encoded = _letters(points)
    at = _before(ends - begins)
    if len(encoded) > len(letters):
        more = np.flatnonzero(letters >= 0x80)
        at += _before(1 + (letters[more] >= 0x800) + (letters[more] >= 0x10000))[np.searchsorted(more, at)]
    terms = pa.StringArray.from_buffers(len(begins), pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(encoded))
    return terms, np.diff(np.searchsorted(begins, starts))


def _places(terms: pa.Array) -> np.ndarray:
    """A place (of SIEVE) for each term, by its length and its first and last eight bytes."""
    if not len(terms):
        return np.empty(0, np.uint64)
    _, ends, data = terms.buffers()
    at = np.frombuffer(ends, np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    padded = np.zeros(at[-1] + 16, np.uint8)
    padded[8 : 8 + at[-1]] = np.frombuffer(data, np.uint8, at[-1])
    eight = np.ndarray(len(padded) - 7, np.uint64, padded, strides=(1,))
    length = np.diff(at)
    spare = (8 * np.maximum(8 - length, 0)).astype(np.uint64)
    mixed = (eight[at[:-1] + 8] << spare) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= ((eight[at[1:]] >> spare) + length.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed * np.uint64(0x165667B19E3779F9)) >> np.uint64(64 - SIEVE.bit_length() + 1)


def sieve(terms: DataFrame) -> np.ndarray:
    """The places of terms (term) as flags: what a worker holds of them, however many they are. A term at a flagged place may be another."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_places(batch.column(0)).astype(np.int64))], ["place"])

    flags = np.zeros(SIEVE, bool)
    flags[terms.select("term").mapInArrow(run, "place bigint").distinct().toArrow().column("place").to_numpy()] = True
    return flags


def _sliced(folds: Broadcast, flags: Broadcast | None):
    """(doc, texts) -> SLICE of each ``CUT`` bytes of texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = sum(pc.binary_length(whole.column(c)).to_numpy().astype(np.int64) for c in range(1, whole.num_columns))
            new = np.flatnonzero(np.diff(np.cumsum(size) // CUT, prepend=-1)) if len(size) else []
            for low, high in zip(new, [*new[1:], whole.num_rows], strict=True):
                yield _slice(whole.slice(low, high - low), folds.value, None if flags is None else flags.value)

    return run


def _slice(batch: pa.RecordBatch, folds: np.ndarray, flags: np.ndarray | None = None) -> pa.RecordBatch:
    docs, count = batch.column(0).to_numpy(), batch.num_rows
    terms, sizes = zip(*(cut(batch.column(c), folds) for c in range(1, batch.num_columns)), strict=True)
    terms, lengths = pa.concat_arrays(terms), sum(sizes)
    order = np.argsort(docs, kind="stable")
    rank = np.empty(count, np.int64)
    rank[order] = np.arange(count)
    own = np.concatenate([np.repeat(rank, n) for n in sizes])
    cols = np.repeat(np.arange(len(sizes), dtype=np.int8), [n.sum() for n in sizes])
    pos = np.concatenate([np.arange(n.sum()) - np.repeat(_before(n)[:-1], n) for n in sizes])
    if flags is not None:
        stays = np.flatnonzero(flags[_places(terms)])
        terms, own, cols, pos = terms.take(pa.array(stays)), own[stays], cols[stays], pos[stays]
    coded = terms.dictionary_encode()
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * count + own
    by = np.argsort(key, kind="stable")
    key = key[by]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    code, which = np.divmod(key[first], count)
    of = np.flatnonzero(np.diff(code, prepend=-1))
    # Behind the terms' rows the one of all documents, which has no occurrences.
    held = np.append(docs[order][which], docs[order])
    rows = np.append(_before(np.diff(np.append(of, len(code)))), len(held))
    spread = np.append(np.append(first, len(key))[rows[:-1]], len(key))
    columns = [
        pa.concat_arrays([coded.dictionary.take(pa.array(code[of])), pa.nulls(1, pa.string())]),
        pa.array(held[rows[:-1]]),
        _bytes(rows, held, "docs"),
        _bytes(rows, np.append(lengths[order][which], lengths[order]), "lengths"),
        _bytes(rows, np.append(np.diff(np.append(first, len(key))), np.zeros(count)), "times"),
        _bytes(spread, cols[by], "cols"),
        _bytes(spread, pos[by], "pos"),
    ]
    return pa.RecordBatch.from_arrays(columns, _names(SLICE))


def _block(batch: pa.RecordBatch, fields: int, labels: tuple[int, ...]) -> pa.RecordBatch:
    """The blocks of rows of SLICE, however these are ordered."""
    coded = batch.column(0).dictionary_encode("encode")
    docs, lengths, times, cols, pos = (_held(batch.column(c), name)[1] for c, name in enumerate(LISTS, 2))
    code = np.repeat(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), _held(batch.column(2), "docs")[0])
    order = np.lexsort((docs, code))
    moved = _moved(times, order)
    code, docs, lengths, times, cols, pos = code[order], docs[order], lengths[order], times[order], cols[moved], pos[moved]
    count, spread = len(code), _before(times)
    runs = np.flatnonzero(np.diff(code, prepend=-1))
    nth = np.arange(count) - np.repeat(runs, np.diff(np.append(runs, count)))
    starts = np.flatnonzero(nth % BLOCK == 0)
    ends = np.append(starts, count)
    met = np.stack([np.diff(_before(cols == c)[spread]) for c in range(fields)], axis=1)
    plain = met[:, [c for c in range(fields) if c not in labels]].any(axis=1)
    columns = [
        coded.dictionary.take(pa.array(code[starts])),
        pa.array(np.diff(ends), pa.int32()),
        pa.array(np.add.reduceat(plain.astype(np.int64), starts), pa.int32()),
        pa.array(np.minimum.reduceat(lengths, starts), pa.int32()),
        _lists(np.arange(len(starts) + 1) * fields, np.maximum.reduceat(met, starts, axis=0).ravel(), pa.int32()),
        pa.array(docs[starts]),
        pa.array(docs[ends[1:] - 1]),
        _bytes(ends, docs, "docs"),
        _bytes(ends, lengths, "lengths"),
        _bytes(ends, times, "times"),
        _bytes(spread[ends], cols, "cols"),
        _bytes(spread[ends], pos, "pos"),
    ]
    return pa.RecordBatch.from_arrays(columns, _names(PACKED))


def _blocks(fields: int, labels: tuple[int, ...]):
    """Rows of SLICE by term -> blocks of up to BLOCK documents of a term."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            n, _ = _held(whole.column(2), "docs")
            new = np.flatnonzero(np.diff(np.cumsum(n) // MERGED, prepend=-1)) if len(n) else []
            for low, high in zip(new, [*new[1:], whole.num_rows], strict=True):
                yield _block(whole.slice(low, high - low), fields, labels)

    return run


def _blocks_in_place(slices, fields: int, labels: tuple[int, ...]):
    """(doc, texts) -> blocks of what ``slices`` makes of them, of MERGED documents of terms together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for some in slices(batches):
            held.append(some)
            n += int(_held(some.column(2), "docs")[0].sum())
            if n >= MERGED:
                yield _block(pa.concat_batches(held), fields, labels)
                held, n = [], 0
        if held:
            yield _block(pa.concat_batches(held), fields, labels)

    return run


def _cut(index: DataFrame, columns: list[str], asked: DataFrame | None):
    """The rows of an index as texts, and what makes SLICE of them."""
    context = index.sparkSession.sparkContext
    flags = None if asked is None else context.broadcast(sieve(asked))
    rows = index.select(F.col("doc").cast("bigint").alias("doc"), *(F.coalesce(c, F.lit("")).alias(c) for c in columns))
    return rows, _sliced(context.broadcast(text.fold_table(index.sparkSession)), flags)


def by_slice(index: DataFrame, columns: list[str], asked: DataFrame | None = None) -> DataFrame:
    """SLICE of an index (doc and text columns): texts are cut, and their terms grouped, in the tasks that read them.

    With ``asked`` (term) occurrences of other terms go where they are met (those let through by a ``sieve`` stay);
    they count in lengths and positions all the same.
    """
    rows, slices = _cut(index, columns, asked)
    return rows.mapInArrow(slices, SLICE)


def packed_in_place(index: DataFrame, columns: list[str], asked: DataFrame, labels: tuple[str, ...] = ("tags",)) -> DataFrame:
    """The blocks that ``packed`` makes of ``by_slice``, made in the tasks that cut the texts; nothing is shuffled.

    All blocks of a document come from one task, behind one another; a term has blocks from every task that met it, which
    are the fuller the fewer terms are ``asked`` (term).
    """
    rows, slices = _cut(index, columns, asked)
    return rows.mapInArrow(_blocks_in_place(slices, len(columns), _labels(columns, labels)), PACKED)


def _labels(columns: list[str], labels: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(columns.index(x) for x in labels if x in columns)


def lengths(slices: DataFrame) -> DataFrame:
    """(doc, length): tokens of each document of ``by_slice``, or of ``packed``, over all columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pa.array(_held(batch.column(c), name)[1], pa.int64()) for c, name in enumerate(("docs", "lengths"))]
            yield pa.RecordBatch.from_arrays(found, ["doc", "length"])

    return slices.where("term is null").select("docs", "lengths").mapInArrow(run, "doc bigint, length bigint")


def packed(slices: DataFrame, columns: list[str], labels: tuple[str, ...] = ("tags",), parts: int | None = None) -> DataFrame:
    """The blocks (PACKED) of ``by_slice``'s rows, those without term too; positions count from 0 in each column.

    A term's rows come together, save those of many documents, which are dealt out, so a frequent term fills many tasks
    and many blocks. A block says how many documents it has (``n``; ``n_text``: outside of ``labels``), the shortest
    length among them, and the most occurrences in each column.
    """
    place = F.when(F.length("docs") >= ALONE * 8, F.pmod(F.hash("low"), F.lit(SPREAD))).otherwise(0)
    dealt = slices.repartition(parts, "term", place) if parts else slices.repartition("term", place)
    return dealt.sortWithinPartitions("term", "low").mapInArrow(_blocks(len(columns), _labels(columns, labels)), PACKED)


def in_blocks(slices: DataFrame, columns: list[str], labels: tuple[str, ...] = ("tags",), parts: int | None = None) -> DataFrame:
    """``packed`` blocks of terms, with their lists as arrays (SCHEMA)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [(_before(n), items, kind) for kind, (n, items) in ((LISTS[c], _held(batch.column(c), c)) for c in LISTS)]
            opened = [_lists(at, items, pa.from_numpy_dtype(kind)) for at, items, kind in held]
            yield pa.RecordBatch.from_arrays([*batch.columns[: -len(LISTS)], *opened], _names(SCHEMA))

    return packed(slices.where("term is not null"), columns, labels, parts).mapInArrow(run, SCHEMA)


def postings(index: DataFrame, columns: list[str], labels: tuple[str, ...] = ("tags",), parts: int | None = None) -> DataFrame:
    """The blocks of an index (doc and text columns)."""
    return in_blocks(by_slice(index, columns), columns, labels, parts)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each occurrence in a batch of blocks (.., docs, times, cols, pos): its block, document, column, position."""
    (many, docs), (_, n), (_, cols), (_, pos) = (_held(batch.column(c), c) for c in ("docs", "times", "cols", "pos"))
    of = np.repeat(np.arange(batch.num_rows), many)
    return np.repeat(of, n), np.repeat(docs, n), cols, pos


def unpacked(blocks: DataFrame) -> DataFrame:
    """(term, doc, col, pos): every occurrence in ``blocks``; ``col`` is a column's number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                of, docs, cols, pos = _flat(batch)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(docs), pa.array(cols), pa.array(pos)], ["term", "doc", "col", "pos"])

    return blocks.select("term", "docs", "times", "cols", "pos").mapInArrow(run, "term string, doc bigint, col tinyint, pos int")


def counted(blocks: DataFrame) -> DataFrame:
    """(term, doc, col, n): how often each term of ``blocks`` stands in each column of its documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                of, docs, cols, _ = _flat(batch)
                new = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (np.diff(docs) != 0) | (np.diff(cols) != 0)) if len(of) else [])
                n = np.diff(np.append(new, len(of)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[new])), pa.array(docs[new]), pa.array(cols[new]), pa.array(n, pa.int32())], ["term", "doc", "col", "n"])

    return blocks.select("term", "docs", "times", "cols", "pos").mapInArrow(run, "term string, doc bigint, col tinyint, n int")


def _added(asked: np.ndarray, docs: np.ndarray, part: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the same question (a number below ``count``) and document as one, with the sum of their parts."""
    low, high = int(docs.min()), int(docs.max())
    near = docs - low if high - low < (1 << 62) // count else np.unique(docs, return_inverse=True)[1]
    key = near * count + asked
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return asked[order[first]], docs[order[first]], np.add.reduceat(part[order], first)


def scored(blocks: DataFrame, weights: list[float], k1: float, b: float) -> DataFrame:
    """(qid, doc, part): what the terms of blocks add to the BM25 score of their documents, for each of their questions.

    ``blocks`` have besides ``qids`` (array), ``idf`` and ``mean_length``. Lengths stand in the blocks, so a row needs no join.
    Up to ADDED rows are added up by question and document before they are passed on; a document has one row a question where its blocks come together.
    """
    by_column = np.array(weights, np.float64)
    kind = blocks.schema["qids"].dataType.elementType.simpleString()

    def parts(whole: pa.RecordBatch, codes: np.ndarray, at: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        batch = whole.slice(at, 256)
        n, docs = _held(batch.column("docs"), "docs")
        lengths, times, cols = (_held(batch.column(c), c)[1] for c in ("lengths", "times", "cols"))
        idf, mean = (np.repeat(batch.column(c).to_numpy(), n) for c in ("idf", "mean_length"))
        tf = np.add.reduceat(by_column[cols], _before(times)[:-1])
        part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths / mean))
        ends = batch.column("qids").offsets.to_numpy() - whole.column("qids").offsets[0].as_py()
        asked, begin = np.diff(ends), np.repeat(ends[:-1], n)
        each = _before(np.repeat(asked, n))
        for low in range(0, int(each[-1]), PASSED):
            row = np.arange(low, min(low + PASSED, int(each[-1])))
            of = np.searchsorted(each, row, "right") - 1
            yield codes[begin[of] + row - each[of]], docs[of], part[of]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            qids = whole.column("qids").flatten().dictionary_encode()
            codes, held, size = qids.indices.to_numpy(), [], 0
            for at in range(0, whole.num_rows, 256):
                for some in parts(whole, codes, at):
                    held.append(some)
                    size += len(some[0])
                    if size >= ADDED:
                        yield passed(qids.dictionary, held)
                        held, size = [], 0
            if held:
                yield passed(qids.dictionary, held)

    def passed(names: pa.Array, held: list) -> pa.RecordBatch:
        asked, docs, part = _added(*(np.concatenate(x) for x in zip(*held, strict=True)), len(names))
        return pa.RecordBatch.from_arrays([names.take(pa.array(asked)), pa.array(docs), pa.array(part)], ["qid", "doc", "part"])

    return blocks.select("qids", "idf", "mean_length", "docs", "lengths", "times", "cols").mapInArrow(run, f"qid {kind}, doc bigint, part double")
