"""Rules mined from all tokens of a url, against a plain version."""

import itertools
import math
import random
import time

import pytest

from catalume.llm import urls


def test_url_rules_from_late_tokens(spark):
    deep = "/".join(f"part{c}" for c in "abcdefghijklmnopq")
    bad = [f"http://one.site/{deep}/{i}?ref=1" for i in range(40)]
    good = [f"http://one.site/{deep}/{i}?page=1" for i in range(40, 200)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(bad + good)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 40), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    found = urls.judge_urls(pages, labels, rules=()).collect()
    assert {r.page_id for r in found if r.verdict == "block"} == set(range(40)) and len(found) == 200


def test_url_rules_name_every_token_alike(spark):
    rows = [(f"http://a.shop/win/now/{i}?x=1&y=2", True) for i in range(30)] + [(f"http://b.site/read/{i}", False) for i in range(100)]
    rules = urls.mine_rules(spark.createDataFrame(rows, "url string, bad boolean")).collect()
    assert {tuple(r.tokens) for r in rules} == {(t,) for t in ("host:a", "host:shop", "path:win", "path:now", "query:x", "query:y")}


def plain_rules(rows, support, confidence, errors, most=3):
    """tokens -> confidence, over every set of tokens of some row; rows: (tokens, bad)."""
    size, base = len(rows), sum(b for _, b in rows) / len(rows)
    sets = {frozenset(c) for tokens, _ in rows for k in range(1, min(most, len(tokens)) + 1) for c in itertools.combinations(sorted(tokens), k)}
    found = {}
    for tokens in sets:
        held = [b for t, b in rows if tokens <= t]
        if sum(held) >= support * size and sum(held) / len(held) >= confidence:
            if sum(held) / len(held) - base >= errors * math.sqrt(base * (1 - base) / len(held)):
                found[tokens] = sum(held) / len(held)
    return {t: c for t, c in found.items() if not any(s < t and d >= c for s, d in found.items())}


@pytest.mark.parametrize("most", [1, 2, 3])
def test_url_rules_by_either_way(spark, monkeypatch, most):
    """FP-growth and counting the sets of the wanted sizes give the same rules."""
    rng = random.Random(9)
    rows = [("/".join(w := rng.sample(["a", "b", "c", "d", "e", "f"], rng.randint(1, 5))), rng.random() < 0.1 + 0.8 * ({"a", "b"} <= set(w))) for _ in range(600)]
    table = spark.createDataFrame([(f"http://x/{u}/{i}", b) for i, (u, b) in enumerate(rows)], "url string, bad boolean")
    mine = lambda: {(tuple(r.tokens), round(r.confidence, 9), round(r.support, 9)) for r in urls.mine_rules(table, errors=2.0, max_tokens=most).collect()}
    grown = mine()
    monkeypatch.setattr(urls, "WIDE", 0)
    assert grown == mine() and grown


@pytest.mark.parametrize(("n", "rows"), [(17, 680), (40, 300)])
def test_url_rules_of_long_alike_urls(spark, n, rows):
    """Each url has all but one of n path words: 2^n frequent sets, of which few are counted."""
    rng, began = random.Random(n), time.time()
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n)]
    given = []
    for i in range(rows):
        gone = rng.randrange(n)
        given.append(("/".join(w for k, w in enumerate(words) if k != gone) + ("/trap" if i % 4 == 0 else ""), i % 4 == 0))
    table = spark.createDataFrame([(f"http://x/{u}/{i}", b) for i, (u, b) in enumerate(given)], "url string, bad boolean")
    assert {tuple(r.tokens) for r in urls.mine_rules(table).collect()} == {("path:trap",)}
    assert time.time() - began < 90


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_url_rules_like_the_plain_version(spark, seed):
    rng = random.Random(seed)
    given = []
    for i in range(500):
        words = rng.sample(["news", "win", "buy", "cat", "dog", "sun"], rng.randint(1, 4))
        bad = rng.random() < 0.15 + 0.5 * ("win" in words) + 0.3 * ({"cat", "buy"} <= set(words))
        given.append((f"http://{rng.choice(['a', 'b'])}.site/{'/'.join(words)}/{i}", bad))
    tokens = [({"scheme:http", f"host:{u[7]}", "host:site", *(f"path:{w}" for w in u.split("/")[3:-1])}, b) for u, b in given]
    want = plain_rules(tokens, max(0.02, 20 / 500), 0.5, 3.0)
    table = spark.createDataFrame(given, "url string, bad boolean")
    rules = urls.mine_rules(table, min_support=0.02, errors=3.0).collect()
    got = {frozenset(r.tokens): r.confidence for r in rules}
    # tokens on all urls alike stand for each other: scheme:http and host:site make the same rules
    assert want and {t for t in got} == set(want) and all(abs(got[t] - want[t]) < 1e-9 for t in got)
    judged = urls.judge_urls(
        spark.createDataFrame([(i, u) for i, (u, _) in enumerate(given)], "page_id long, url string"),
        spark.createDataFrame([(i, int(not b), 0) for i, (_, b) in enumerate(given)], "doc_id long, quality int, toxic int"),
        rules=(), min_support=0.02, errors=3.0,
    )
    for r in judged.collect():
        fits = [c for t, c in want.items() if t <= tokens[r.page_id][0]]
        assert (r.verdict == "block") == bool(fits) and (r.mined_confidence is None or abs(r.mined_confidence - max(fits)) < 1e-9)


def test_url_rules_need_significance(spark):
    rng = random.Random(4)
    rows = [(f"http://h{i % 7}.site/{rng.choice('abcdef')}/{i}", rng.random() < 0.4) for i in range(600)]
    assert urls.mine_rules(spark.createDataFrame(rows, "url string, bad boolean")).count() == 0
