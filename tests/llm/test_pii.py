import collections
import math
import random
import re
import time

import pytest

from catalume.llm import pii

LETTERS = re.compile(r"[^\W\d_]+")


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if 2 * d > 9 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def number(text):
    return re.sub("[^0-9]", "", text)


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True, str.lower),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split(".")), str),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(number(m)) <= 19 and luhn(number(m)), number),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(number(m)) <= 15, number),
}


def base(text):
    return {k: [(m[0], m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m[0])] for k, (p, ok, _) in KINDS.items()}


def terms(texts, reach=5, support=3, least=0.7):
    """Disclosure of words, over lists."""
    joint, ways, about, met = collections.Counter(), collections.defaultdict(set), collections.Counter(), collections.Counter()
    for text in texts:
        rest = text = text or ""
        met.update(w.lower() for w in LETTERS.findall(re.sub(KINDS["email"][0], lambda m: " " * len(m[0]), text)))
        for kind, (pattern, ok, plain) in KINDS.items():
            edges = [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, rest)]
            for i, (a, b, match) in enumerate(edges):
                if not ok(match):
                    continue
                left = LETTERS.findall(rest[edges[i - 1][1] if i else 0 : a])[-reach:]
                right = LETTERS.findall(rest[b : edges[i + 1][0] if i + 1 < len(edges) else len(rest)])[:reach]
                entity, around = (kind, plain(match)), (" ".join(left).lower(), " ".join(right).lower())
                for w in {x.lower() for x in left + right}:
                    joint[entity, w] += 1
                    ways[entity, w].add(around)
                    about[entity] += 1
            if kind == "email":
                rest = re.sub(pattern, "\n", rest)
    total, out = sum(met.values()), {}
    for (entity, w), n in joint.items():
        if len(ways[entity, w]) >= support and total > about[entity]:
            share = 1 - math.log(max(met[w] / n, 1.0)) / math.log(total / about[entity])
            if share >= least:
                out[w] = max(out.get(w, 0), share)
    return out


TRICKY = [
    "a@b.c_d@e.f x@y a@b@c.d.. a.b+c%d@e-f.g.h, _@_.x é@é.é mailto:Bob@Example.ORG.",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.01.1.001 1.2.3 999.1.2.3.4 1..2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 41111111111111111 4 111111111111111 1 2 3",
    "+1 (333) 555-0100 +1 2 +12345678 +1(2)3.4-5 6789012345678 ++49 30 1234567- +1 234567890123456 ",
    "é\U0001f600 +49 30 1234567 \U0001f600 x@y.zz 10.0.0.1",
    "",
    None,
]


def spans(row, kind):
    return [(s.match, s.start, s.end) for s in row[kind]]


def test_base_like_python(spark):
    rng = random.Random(3)
    texts = TRICKY + ["".join(rng.choice("a1.@+- (9\n") for _ in range(rng.randrange(80))) for _ in range(400)]
    frame = spark.createDataFrame([(i if i % 9 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, Email string")
    found = pii.find_personal_data(frame)
    want = sorted(((i if i % 9 else None, *(tuple(v) for v in base(t).values())) for i, t in enumerate(texts)), key=str)
    assert sorted(((r.doc_id, *(tuple(spans(r, k)) for k in KINDS)) for r in found.collect()), key=str) == want


def test_terms_reveal(spark):
    """A name beside one address in different sentences tells who it is; common words, rare sentences and copies do not."""
    rng = random.Random(4)
    common = ["the", "of", "was", "here", "said", "then", "again", "more"]
    say = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = [f"{say(6)} Zeno {say(2)} zeno@mail.example {say(6)}" for _ in range(6)] + [f"{say(8)} copied rare.one@x.example unique {say(4)}"] * 5
    texts += [say(30) for _ in range(60)] + [f"{say(3)} ZENO {say(3)} \U0001f600 zeno", None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = terms(texts)
    found = {r.term: r.disclosure for r in pii.revealing_terms(frame).collect()}
    assert found == pytest.approx(want) and set(want) == {"zeno"}
    for r in pii.find_personal_data(frame).collect():
        text = texts[r.doc_id] or ""
        masked = re.sub(KINDS["email"][0], lambda m: " " * len(m[0]), text)
        assert spans(r, "term") == [(m[0], m.start(), m.end()) for m in LETTERS.finditer(masked) if m[0].lower() in want]
        assert "zeno" not in r.clean.lower() and "@" not in r.clean
    gentle = pii.find_personal_data(frame, remove=1.1).where("doc_id = 71").first()
    assert "[NAME]" in gentle.clean and "[WORD]" in gentle.clean
    clean = {r.doc_id: r.clean for r in pii.find_personal_data(frame).collect()}
    assert clean[20] == texts[20] and clean[6] == texts[6].replace("rare.one@x.example", "[EMAIL]")


def test_no_rows(spark):
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_texts_take_linear_time(spark):
    """Runs of each pattern's characters, with many matches and with none."""
    texts = ["a" * 400_000, "1" * 400_000, "1 " * 200_000, "+1" + " " * 400_000, "+1 " * 130_000, "1.2.3." * 70_000, "a@" * 200_000, "a@b." * 100_000, "x@y.z " * 60_000, "0" * 400_000 + ".1.1.1"]
    began = time.time()
    found = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert time.time() - began < 120
    assert len(found[8].email) == 60_000 and found[8].email[-1].end == 359_999
    assert len(found[9].ip) == 1 and not found[3].phone
