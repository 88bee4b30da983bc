"""Texts cut into pieces that tokenizers treat alike everywhere, each looked up once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes of text whose pieces are looked up together.
_TOGETHER = 1 << 23
_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: White space beside a blank or a line's end, a blank at the end, or the mark that is put in at cuts.
_UNSAFE = rf" (?:[{_SPACE}]|\z)|\n[{_SPACE}]|[{_SPACE}]\n|\x00"


class PieceCache:
    """What ``encode`` makes of texts, word by word; remembers up to ``memory`` words and pieces.

    Words are the matches of ``pattern``. A match never holds the blank before
    a word together with what stands before that blank, nor a single line's
    end with what is beside it. So texts are cut before each blank and on both
    sides of each line's end (texts with white space beside either: into their
    words), and a piece, mostly a word with its punctuation, is looked up
    whole; the pattern is only run over new pieces that aren't letters alone.
    ``encode`` gets the new words of many texts at once and returns each one's
    ids as little-endian unsigned 32-bit numbers. This cutting is right for
    ``public_tokenizers.PATTERN``; with any other pattern the matches
    themselves are looked up, found in whole texts.

    There is a younger and an older half: if the younger is full it becomes
    the older, whose entries are forgotten unless they are met again, so
    frequent ones stay.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[bytes]], memory: int = 1_500_000):
        self.find, self.encode, self.half = regex.compile(pattern).findall, encode, max(1, memory // 2)
        self.cuts = pattern == public_tokenizers.PATTERN
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode_batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Each text's ids; null is an empty text."""
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + _TOGETHER)))
            some = texts.slice(at, end - at)
            unsafe = pc.match_substring_regex(some, _UNSAFE if self.cuts else "")
            safe = some.filter(pc.invert(unsafe))
            cut = pc.replace_substring(pc.replace_substring(safe, " ", "\0 "), "\n", "\0\n\0")
            easy = self._ids(pc.split_pattern(cut, "\0"))
            hard = self._ids(pa.array([self.find(t) for t in some.filter(unsafe).to_pylist()], pa.list_(pa.string())))
            for odd in unsafe.to_pylist():
                yield next(hard if odd else easy)
            at = end

    def _ids(self, parts: pa.ListArray) -> Iterator[np.ndarray]:
        if not len(parts):
            return
        coded = parts.flatten().dictionary_encode()
        codes = self._codes(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy(zero_copy_only=False)
        flat, size = np.frombuffer(b"".join(codes), "<u4"), np.fromiter(map(len, codes), np.int32, len(codes)) // 4
        lengths = size[which]
        ends = np.zeros(len(which) + 1, np.int32)
        np.cumsum(lengths, out=ends[1:])
        source = np.repeat((np.cumsum(size, dtype=np.int32) - size)[which] - ends[:-1], lengths)
        source += np.arange(ends[-1], dtype=np.int32)
        ids = flat[source]
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        bounds = ends[np.concatenate(([0], np.cumsum(counts)))].tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield ids[a:b]

    def _codes(self, pieces: list[str]) -> list[bytes]:
        codes = list(map(self.known.get, pieces))
        learnt = self._learn([p for p, c in zip(pieces, codes, strict=True) if c is None])
        return [learnt[p] if c is None else c for p, c in zip(pieces, codes, strict=True)]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The codes of distinct pieces that the younger half lacks, and of new words in them."""
        learnt = {p: c for p in pieces if (c := self.old.get(p)) is not None}
        words, mixed = [], {}
        for p in pieces:
            if p not in learnt:
                if not self.cuts or p.isalpha() or p[:1] == " " and p[1:].isalpha():
                    words.append(p)
                else:
                    mixed[p] = self.find(p)
        inside = {w for found in mixed.values() for w in found}.difference(words)
        learnt.update((w, c) for w in inside if (c := self.known.get(w) or self.old.get(w)))
        words += inside.difference(learnt)
        learnt.update(zip(words, self.encode(words), strict=True))
        for p, found in mixed.items():
            learnt[p] = b"".join([learnt[w] for w in found])
        if len(self.known) + len(learnt) > self.half:
            self.old, self.known = self.known, {}
        if len(learnt) <= self.half:
            self.known.update(learnt)
        return learnt
