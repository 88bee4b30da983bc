import collections
import random
import re

import numpy as np
import pytest

from catalume.llm import phrases

SCHEMA = "lang string, text string"


def plain(docs, max_words=5, least=3, top=2000, covered=100):
    """The contract word by word, over lists."""
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for m in range(1, max_words + 1):
                for i in range(len(words) - m + 1):
                    f[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, seen in f.items():
        cand = {p: a for p, a in seen.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            score, k = min((1000 * a * n[lang] // (seen[p[:k]] * seen[p[k:]]), k) for k in range(1, len(p)))
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if not any(len(q) > len(p) and 100 * b >= covered * a and inside(q) for q, b in cand.items()):
                rows.append((-score, -a, " ".join(p).encode(), seen[p[:k]], seen[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed, rows=120):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "a", "of", "é", "zoö", "x-y", "\x00", "big", "red", "dog"]
    for _ in range(rows):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        yield rng.choice(["en", "de", None, "und", ""]), "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " \r\n"]) for w in words)


@pytest.mark.parametrize("covered", [100, 60])
def test_like_plain(spark, covered):
    docs = [*texts(1), (None, None), ("en", ""), ("xx", None), *[("en", "one two three four five six. " * 4)] * 3]
    frame = spark.createDataFrame([(*d, "x") for d in docs], SCHEMA + ", Rank string")
    for top in (2000, 3):
        found = sorted(map(tuple, phrases.collocations(frame, min_count=4, top=top, covered=covered).collect()))
        assert found == plain(docs, least=4, top=top, covered=covered)
        assert len(found) > 10


def test_ties_and_numbers_past_64_bits(spark):
    docs = [("en", "a b c d " * 50)]
    frame = spark.createDataFrame(docs, SCHEMA)
    assert sorted(map(tuple, phrases.collocations(frame, min_count=10).collect())) == plain(docs, least=10)
    big = spark.range(1).selectExpr("cast(1000 as decimal(4,0)) * cast(3000000000 as decimal(20,0)) * cast(900000000000 as decimal(20,0)) as over", "cast(7 as decimal(20,0)) * cast(3 as decimal(20,0)) as under")
    assert big.selectExpr("over div (under * 1000000) as q").first().q == 1000 * 3000000000 * 900000000000 // (21 * 1000000)


@pytest.mark.parametrize("size", [1, 7, 60, 10**6])
def test_long_texts_are_cut_without_loss(size):
    raw = " ".join(f"w{i % 5}" for i in range(200)).encode() + b"\n" + b"y" * 90 + b"  end \n\n last words here"
    whole = phrases._count([("en", raw, len(raw))], 3, None)
    parts = [("en", p, limit) for p, limit in phrases._split(raw, size, 4)]
    cut = [phrases._count([p], 3, None) for p in parts]
    add = collections.Counter()
    for batch in cut:
        add.update(dict(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)))
    assert dict(add) == dict(zip(whole.column(1).to_pylist(), whole.column(2).to_pylist(), strict=True))
    together = phrases._count(parts, 3, None)
    assert dict(zip(together.column(1).to_pylist(), together.column(2).to_pylist(), strict=True)) == dict(add)


def test_filter_never_loses(spark, monkeypatch):
    """With every bit set, and with very few bits, the counts are the same."""
    docs = list(texts(2))
    want = plain(docs, least=4)
    frame = spark.createDataFrame(docs, SCHEMA)
    monkeypatch.setattr(phrases, "_filter_bits", lambda frequent: np.full(1 << (phrases._BITS - 6), ~np.uint64(0)))
    assert sorted(map(tuple, phrases.collocations(frame, min_count=4).collect())) == want


def test_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", "  .. ")], SCHEMA)).count() == 0
