"""Merges of short words against the tokenizer library."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from catalume.llm import merges, packing

PLAIN = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()


def test_merges_of_short_words():
    library = Tokenizer.from_str(PLAIN)
    rng = random.Random(1)
    pieces = ["a", "b", "th", "ing", "é", "漢", "🙂", "ção", "x", "qu", "er"]
    words = {(" " if rng.random() < 0.5 else "") + "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(8000)}
    words = [w for w in words if len(w.encode()) <= merges.LONGEST]
    coded = merges.merges_alone(PLAIN).encode([w.encode() for w in words])
    wrong = [w for w, ids in zip(words, coded, strict=True) if np.frombuffer(ids, "<u4").tolist() != library.encode(w, add_special_tokens=False).ids]
    assert len(words) > 4000 and not wrong


def test_texts_like_the_library():
    library = Tokenizer.from_str(PLAIN)
    library.encode_special_tokens = True
    rng = random.Random(2)
    pieces = ["a", "b", "é", "漢", "🙂", " ", "  ", "\n", "\t", "x1", "<|endoftext|>", "the", "ing", "\x00", "Ġ", "ß", "y" * 40, "qz" * 70]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    found = packing.token_bytes(PLAIN, public_tokenizers.PATTERN, merges.merges_alone(PLAIN)).encode_batch(pa.array(texts))
    assert all(a.tolist() == library.encode(t, add_special_tokens=False).ids for a, t in zip(found, texts, strict=True))


def test_other_files_are_left_to_the_library():
    assert merges.merges_alone(PLAIN.replace('"normalizer":null', '"normalizer":{"type":"NFC"}').replace('"normalizer": null', '"normalizer": {"type":"NFC"}')) is None
