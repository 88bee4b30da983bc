"""Byte-level BPE: merges found by segment trees over byte positions, many words at a time."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from catalume.llm.pieces import PieceCache
from catalume.llm.storage import ship_package

_NONE = np.iinfo(np.int64).max
#: Leaves of the trees built at once.
_LEAVES = 1 << 15
#: Words of more bytes are merged on their own.
_LONG = 256


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a tiktoken file: base64 token, blank, rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Merger:
    """BPE merges for one rank table.

    Words of like length are encoded together. Each has a segment tree over
    its byte positions; a leaf holds rank x leaves + position of the pair that
    starts there, an inner node the least of its two children, so the root
    names the leftmost pair of minimum rank. A merge links out the pair's
    right half and changes three leaves: the merged one's, its right
    neighbour's and that of the live neighbour before it, each followed up to
    the root.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.bytes_rank = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.pairs: dict[int, int] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The tokens of each word, as little-endian unsigned 32-bit numbers; a word that is a token stays whole."""
        out = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if (whole := self.ranks.get(word)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(word) > _LONG:
                out[i] = self._merge_long(word)
            elif word:
                by_size.setdefault(max(1, (len(word) - 1).bit_length()), []).append(i)
        for height, members in by_size.items():
            step = max(1, _LEAVES >> height)
            for at in range(0, len(members), step):
                some = members[at : at + step]
                for i, ids in zip(some, self._merge([words[i] for i in some], 1 << height), strict=True):
                    out[i] = ids
        return out

    def _merge(self, words: list[bytes], leaves: int) -> Iterator[bytes]:
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(leaves, b"\0") for w in words), np.uint8).reshape(n, leaves)
        token = self.bytes_rank[raw]
        place = np.arange(leaves)
        after = np.where(place + 1 < size[:, None], place + 1, leaves)
        before = np.broadcast_to(place - 1, (n, leaves)).copy()
        tree = np.full((n, 2 * leaves), _NONE, np.int64)
        rank = self.rank_of(token[:, :-1], token[:, 1:])
        tree[:, leaves:-1] = np.where((rank < _NONE) & (place[1:] < size[:, None]), rank * leaves + place[:-1], _NONE)
        level = leaves
        while level > 1:
            tree[:, level // 2 : level] = tree[:, level : 2 * level].reshape(n, level // 2, 2).min(axis=2)
            level //= 2

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + leaves
            tree[rows, node] = value
            while leaves > 1 and len(node) and node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def pair(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
            found = self.rank_of(token[rows, left], token[rows, np.minimum(right, leaves - 1)])
            return np.where((right < leaves) & (found < _NONE), np.where(found < _NONE, found, 0) * leaves + left, _NONE)

        rows = np.nonzero(tree[:, 1] < _NONE)[0]
        while len(rows):
            best = tree[rows, 1]
            left = best % leaves
            gone = after[rows, left]
            right = after[rows, gone]
            token[rows, left] = best // leaves
            token[rows, gone] = -1
            after[rows, left] = right
            back = right < leaves
            before[rows[back], right[back]] = left[back]
            put(rows, gone, np.full(len(rows), _NONE))
            put(rows, left, pair(rows, left, right))
            front = before[rows, left]
            has = front >= 0
            put(rows[has], front[has], pair(rows[has], front[has], left[has]))
            rows = rows[tree[rows, 1] < _NONE]
        live = (token >= 0) & (place < size[:, None])
        flat = token[live].astype("<u4").tobytes()
        at = 0
        for end in (4 * live.sum(axis=1).cumsum()).tolist():
            yield flat[at:end]
            at = end

    def _merge_long(self, word: bytes) -> bytes:
        """The same merges for one long word, over plain lists."""
        n = len(word)
        leaves = 1 << (n - 1).bit_length()
        token = self.bytes_rank[np.frombuffer(word, np.uint8)]
        rank = self.rank_of(token[:-1], token[1:])
        tree = np.full(2 * leaves, _NONE, np.int64)
        tree[leaves : leaves + n - 1] = np.where(rank < _NONE, np.where(rank < _NONE, rank, 0) * leaves + np.arange(n - 1), _NONE)
        level = leaves
        while level > 1:
            tree[level // 2 : level] = tree[level : 2 * level].reshape(-1, 2).min(axis=1)
            level //= 2
        tree, token, after, before, none = tree.tolist(), token.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), int(_NONE)
        if not self.pairs:
            self.pairs.update(zip(self.keys.tolist(), self.merged.tolist(), strict=True))
        rank_of = self.pairs.get

        def put(leaf: int, right: int) -> None:
            found = rank_of(token[leaf] << 32 | token[right]) if right < n else None
            node, value = leaf + leaves, none if found is None else found * leaves + leaf
            tree[node] = value
            while node > 1:
                beside = tree[node ^ 1]
                node >>= 1
                value = value if value < beside else beside
                if tree[node] == value:
                    return
                tree[node] = value

        while tree[1] < none:
            merged, left = divmod(tree[1], leaves)
            gone = after[left]
            right = after[gone]
            token[left], token[gone], after[left] = merged, -1, right
            if right < n:
                before[right] = left
            put(gone, n)
            put(left, right)
            if before[left] >= 0:
                put(before[left], left)
        return np.array([t for t in token if t >= 0], "<u4").tobytes()


class Codec:
    """Encodes and decodes texts, every match of ``pattern`` merged on its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = 1_500_000):
        self.merger = Merger(ranks)
        self.cache = PieceCache(pattern, self._encode, memory)
        self.text, self.decimal = np.full((2, max(self.merger.tokens) + 1), None, object)
        for i, token in self.merger.tokens.items():
            self.text[i], self.decimal[i] = token, str(i)

    def _encode(self, words: list[str]) -> list[bytes]:
        return self.merger.encode([w.encode("utf-8", "surrogatepass") for w in words])

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[int, ...]]:
        return (tuple(ids.tolist()) for ids in self.cache.encode_batch(pa.array(texts, pa.string())))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.text[ids].tolist())

    def decimals(self, ids: np.ndarray) -> str:
        return ",".join(self.decimal[ids].tolist())


_codecs: dict[tuple[int, str], Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """This process's codec for a rank file, kept between tasks."""
    key = (hash(data), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(parse_ranks(data), pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """Tokens of each row of ``docs`` (doc_id, text) and digests of their round trip.

    Returns doc_id, ids (array, if ``with_ids``), n_tokens, ids_sha256 (of the
    decimal ids joined by commas), decoded_sha256 (of the decoded bytes).
    A null text is empty and has no tokens; repeated rows get a row each; an
    empty table gives an empty result; other columns are ignored. The rank
    file is read on the driver and broadcast (its vocabulary bounds it).
    """
    spark = docs.sparkSession
    ship_package(spark)
    ranks = spark.sparkContext.broadcast(Path(ranks_path).read_bytes())
    kind = dict(docs.dtypes)["doc_id"]
    fields = f"doc_id {kind}, " + ("ids array<int>, " if with_ids else "") + "n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, counts, coded, decoded = [], [], [], []
                for one in own.cache.encode_batch(part.column(1)):
                    counts.append(len(one))
                    coded.append(hashlib.sha256(own.decimals(one).encode()).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(one)).hexdigest())
                    if with_ids:
                        ids.append(pa.array(one.astype(np.int32)))
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    offsets = pa.array(np.cumsum([0, *counts]), pa.int32())
                    columns.insert(1, pa.ListArray.from_arrays(offsets, pa.concat_arrays(ids)))
                    names.insert(1, "ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, fields)
