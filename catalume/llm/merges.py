"""Byte-pair merges of many short words at a time, for tokenizer files whose only step is the merging."""

from __future__ import annotations

import json

import numpy as np

#: Bytes of the words that share a table, in steps; longer words are not taken.
_WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128)
LONGEST = _WIDTHS[-1]
#: Words merged at once; bits of the lookup table's places.
_AT_ONCE, _BITS = 2048, 19
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def merges_alone(tokenizer_json: str) -> Merges | None:
    """The merges of a ``tokenizers`` file; None if it does more than byte-level merging of a pattern's matches."""
    file = json.loads(tokenizer_json)
    model, before = file["model"], file["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or file["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    single = np.array([vocabulary[c] for c in byte_letters()], np.int32)
    keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in merges], np.int64)
    return Merges(single, keys, np.array([vocabulary[a + b] for a, b in merges], np.int32))


class Merges:
    """Repeats the merge of lowest rank, leftmost first, in a table of words side by side, until no word has one."""

    def __init__(self, single: np.ndarray, keys: np.ndarray, merged: np.ndarray):
        """``single``: each byte's id; by rank, ``keys``: left id << 32 | right id, ``merged``: the id they make."""
        self.made_of = single, keys, merged
        self.bytes, self.merged, self.none = single, np.append(merged, np.int32(-1)), len(keys)
        place = self._place(keys)
        taken, first = np.unique(place, return_index=True)
        self.keys, self.ranks = np.full(1 << _BITS, -1, np.int64), np.full(1 << _BITS, self.none, np.int32)
        self.keys[taken], self.ranks[taken] = keys[first], first
        rest = np.setdiff1d(np.arange(self.none), first)
        rest = rest[np.argsort(keys[rest])]
        self.shared, self.more, self.more_ranks = np.zeros(1 << _BITS, bool), keys[rest], rest.astype(np.int32)
        self.shared[place[rest]] = True

    def __reduce__(self):
        return Merges, self.made_of

    @staticmethod
    def _place(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _MULTIPLIER >> np.uint64(64 - _BITS)).view(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, ``none`` for no merge."""
        keys = left.astype(np.int64) << 32 | right
        place = self._place(keys)
        fits = self.keys[place] == keys
        found = np.where(fits, self.ranks[place], self.none)
        odd = self.shared[place] & ~fits
        if odd.any():
            at = np.minimum(np.searchsorted(self.more, keys[odd]), len(self.more) - 1)
            found[odd] = np.where(self.more[at] == keys[odd], self.more_ranks[at], self.none)
        return found

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of 1 to LONGEST bytes, as little-endian unsigned 32-bit numbers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = [b""] * len(words)
        least = 0
        for width in _WIDTHS:
            members = np.flatnonzero((sizes > least) & (sizes <= width))
            least = width
            for at in range(0, len(members), _AT_ONCE):
                some = members[at : at + _AT_ONCE]
                raw = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in some.tolist()]), np.uint8).reshape(-1, width)
                done = self._merge(np.where(np.arange(width) < sizes[some, None], self.bytes[raw], -1))
                flat, start = done[done >= 0].astype("<u4").tobytes(), 0
                for i, end in zip(some.tolist(), (4 * (done >= 0).sum(axis=1).cumsum()).tolist(), strict=True):
                    out[i], start = flat[start:end], end
        return out

    def _merge(self, ids: np.ndarray) -> np.ndarray:
        """Rows of ids (-1 behind the last) after all merges."""
        done, rows, width = ids.copy(), np.arange(len(ids)), ids.shape[1]
        place = np.arange(width)
        ranks = np.where(ids[:, 1:] >= 0, self.rank(ids[:, :-1], ids[:, 1:]), self.none)
        while len(rows):
            best = ranks.argmin(axis=1)
            value = ranks[np.arange(len(rows)), best]
            live = value < self.none
            done[rows[~live]] = ids[~live]
            rows, ids, ranks, best, value = rows[live], ids[live], ranks[live], best[live], value[live]
            own = np.arange(len(rows))
            # what stands behind the merged pair moves up by one
            ids = np.take_along_axis(ids, np.minimum(place + (place > best[:, None]), width - 1), 1)
            ids[:, -1] = -1
            ids[own, best] = self.merged[value]
            ranks = np.take_along_axis(ranks, np.minimum(place[:-1] + (place[:-1] >= best[:, None]), width - 2), 1)
            ranks[:, -1] = self.none
            after, before = best < width - 1, best > 0
            for which, left in ((after, best), (before, best - 1)):
                r, a = own[which], left[which]
                right = ids[r, a + 1]
                ranks[r, np.minimum(a, width - 2)] = np.where(right >= 0, self.rank(ids[r, a], right), self.none)
        return done
