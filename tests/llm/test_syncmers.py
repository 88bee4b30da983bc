"""Fingerprints against a plain version; short texts, repeated and null ids, texts without blanks."""

import hashlib
import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from catalume.llm import syncmers
from tests.llm.test_operators import rows


def test_syncmers_of_short_texts(spark):
    texts = [" ".join(f"{c}{i}" for i in range(n)) for c in "abcdefghij" for n in range(1, 13)]
    table = spark.createDataFrame(list(enumerate([*texts, None, " "])), "doc_id long, text string")
    marked = syncmers.with_anchors(table, "text", "anchors")
    prints = {r.doc_id: r.fp for r in marked.select("doc_id", syncmers.fingerprint(syncmers.codes(marked["anchors"])).alias("fp")).collect()}
    assert len({prints[i] for i in range(len(texts))}) == len(texts) and all(prints[i] for i in range(len(texts)))
    assert prints[len(texts)] == prints[len(texts) + 1] == ""


def test_syncmers_keep_the_kept_half(spark):
    rows = [(1, "aa bb cc dd ee ff gg hh"), (2, "kk ll mm nn oo pp qq rr")]
    found = syncmers.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(0 < r.near_edited < 1 and r.near_next == 0 for r in found)


# -- a plain version ---------------------------------------------------------


def signed(value, bits=64):
    return value - (1 << bits) if value >> bits - 1 else value


def hashed(*values):
    found = 42
    for v in values:
        found = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), found)
    return signed(found)


def plain_codes(text):
    words = []
    for run in re.findall(r"[^ \t\n\x0b\f\r]+", text):
        words += [run] if len(run) <= 24 else list(run)
    words = [hashed(w) for w in words]
    pair = [hashed(a, b) for a, b in zip(words, words[1:])]
    four = [hashed(a, b) for a, b in zip(pair, pair[2:])]
    eight = [hashed(a, b) for a, b in zip(four, four[4:])]
    anchors = [(i + 1, eight[i]) for i in range(len(eight)) if min(pair[i : i + 7]) in (pair[i], pair[i + 6])]
    out, before = [], None
    for pos, code in anchors:
        gap = 0 if before is None else pos - before
        out.append(((code ^ gap << 32) >> 32) & 0xFFFFFFFF)
        before = pos
    short = (words if len(words) == 1 else pair) if len(words) < 128 else None
    return out, short and [(p >> 32) & 0xFFFFFFFF for p in short] if short is not None else None


def shown(codes):
    runs, pairs = ("".join(f"{c:08x}" for c in x or []) for x in codes)
    return runs + ("." + pairs if pairs else "")


def plain_likeness(a, b):
    a, b = (a[1], b[1]) if a[1] is not None and b[1] is not None else (a[0], b[0])
    a, b = set(a), set(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def plain_edits(given):
    """Each distinct document's columns; given: (doc_id, text), distinct, in descending order."""
    out = {}
    for at, (i, text) in enumerate(given):
        after = given[(at + 1) % len(given)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, other, following = plain_codes(text), plain_codes(edited), plain_codes(after)
        prints = [shown(codes) for codes in (own, other)]
        out[i, prints[0]] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), *prints, plain_likeness(own, other), plain_likeness(own, following))
    return out


def found_edits(docs):
    return [((r.doc_id, r.fingerprint), (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)) for r in syncmers.fingerprint_edits(docs).collect()]


def test_syncmers_like_the_plain_version(spark):
    given = [(i, t or "") for i, t, *_ in rows()]
    given += [(100 + i, "".join(chr(0x4E00 + random.Random(i).randint(0, 900)) for _ in range(300))) for i in range(3)]
    table = spark.createDataFrame(given, "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("mark", F.lit(1))
    assert dict(found_edits(table.repartition(5))) == plain_edits(sorted(given, reverse=True))


def test_syncmers_repeated_and_null_ids(spark):
    texts = [" ".join(f"{c}{i * i % 50}" for i in range(30)) for c in "abcdef"]
    given = [(1, texts[0])] * 9 + [(2, texts[1]), (2, texts[2]), (None, texts[3]), (None, texts[3]), (None, None)]
    found = found_edits(spark.createDataFrame(given, "doc_id long, text string"))
    assert len(found) == len(given) and len(set(found)) == 5
    key = {t: hashed(*([i] if i is not None else []), t) for i, t in ((1, texts[0]), (2, texts[1]), (2, texts[2]), (None, texts[3]), (None, ""))}
    order = [*sorted(texts[1:3], key=key.get, reverse=True), texts[0], *sorted([texts[3], ""], key=key.get, reverse=True)]
    ids = {texts[0]: 1, texts[1]: 2, texts[2]: 2, texts[3]: None, "": None}
    assert dict(found) == plain_edits([(ids[t], t) for t in order])


def test_syncmers_of_text_without_blanks(spark):
    rng = random.Random(8)
    run = "".join(chr(0x4E00 + rng.randint(0, 900)) for _ in range(400))
    marked = syncmers.with_anchors(spark.createDataFrame([(1, run), (2, "x" + run)], "doc_id long, text string"), "text", "anchors")
    code = {r.doc_id: {a.code for a in r.anchors.runs} for r in marked.collect()}
    assert len(code[1]) > 50 and code[1] <= code[2]


def edits(words, rng):
    """One word gone, put in, or changed, at the start, at the end and somewhere between."""
    for at in (0, len(words) - 1, rng.randrange(1, len(words) - 1)):
        yield words[:at] + words[at + 1 :]
        yield [*words[:at], "new", *words[at:]]
        yield [*words[:at], "other", *words[at + 1 :]]


def test_syncmers_bear_one_edit_at_every_length(spark):
    """No edit of one word takes a text of 12 words or more below one half, least of all where texts stop being short."""
    rng, pairs = random.Random(11), []
    for n in [*range(12, 40), *range(40, 124, 9), *range(125, 132), 200, 400]:
        for _ in range(4):
            words = [f"w{rng.randrange(3000)}" for _ in range(n)]
            pairs += [(len(pairs), n, " ".join(words), " ".join(e)) for e in edits(words, rng)]
    table = spark.createDataFrame(pairs, "doc_id long, n int, a string, b string")
    both = syncmers.with_anchors(syncmers.with_anchors(table, "a", "x"), "b", "y")
    both = both.select("n", syncmers.codes(F.col("x")).alias("x"), syncmers.codes(F.col("y")).alias("y"))
    low = {r.n: r.low for r in both.groupBy("n").agg(F.min(syncmers.likeness(F.col("x"), F.col("y"))).alias("low")).collect()}
    assert min(low.values()) >= 0.5, sorted(low.items(), key=lambda x: x[1])[:5]
    assert [plain_likeness(plain_codes(a), plain_codes(b)) for _, _, a, b in pairs] == [r[0] for r in syncmers.with_anchors(syncmers.with_anchors(table, "a", "x"), "b", "y").orderBy("doc_id").select(syncmers.likeness(syncmers.codes(F.col("x")), syncmers.codes(F.col("y")))).collect()]
