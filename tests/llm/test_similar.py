"""Near copies by Jaccard similarity against a plain version of all pairs."""

import random

import pytest

import corpus_pipeline
from catalume.llm import simhash, similar


def plain_shingles(text):
    parts = (text or "").encode().lower().split()
    return {b" ".join(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def plain_kept(rows):
    """Smallest id of each group linked at Jaccard 0.8."""
    held = {i: plain_shingles(t) for i, t in rows}
    root = {i: i for i in held}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in held:
        for b in held:
            x, y = held[a], held[b]
            if a < b and (not x and not y or len(x & y) / max(1, len(x | y)) >= 0.8):
                one, two = find(a), find(b)
                root[max(one, two)] = min(one, two)
    return {i for i in held if find(i) == i}


def near_rows():
    """Texts and copies with 1 to 12 words changed, of which SimHash at 3 bits sees few; blank and short texts."""
    rng = random.Random(5)
    texts = [None, " ", "a b", "A  b", "a c"]
    for _ in range(30):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(words))
        for changed in (1, 2, 4, 8, 12):
            copy = list(words)
            for at in rng.sample(range(len(copy)), changed):
                copy[at] = "x"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_stage_drops_near_copies(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == plain_kept(rows)


def test_large_buckets_are_linked(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join("x" if at == i else w for at, w in enumerate(base))) for i in range(120)]
    rows.append((500, " ".join(rng.sample(base, 200))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in similar.drop_similar(docs, max_bucket=4).collect()} == plain_kept(rows) == {0, 500}


def test_chains_in_large_buckets_are_linked(spark):
    """Copies of copies: most pairs of the group are below 0.8, and a task sees few of it at once."""
    rng = random.Random(11)
    texts = [[f"w{rng.randint(0, 9)}x{i}" for i in range(150)]]
    while len(texts) < 150:
        copy = list(rng.choice(texts[-40:]))
        for at in rng.sample(range(len(copy)), rng.choice((1, 2, 3, 5))):
            copy[at] = f"y{rng.randint(0, 10**6)}"
        texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = plain_kept(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert 1 < len(want) < 120
    assert {r.doc_id for r in similar.drop_similar(docs, max_bucket=2, block=8).collect()} == want
    assert {r.doc_id for r in similar.drop_similar(docs).collect()} == want


def test_blocks_find_what_hubs_miss(spark):
    """In one large bucket: 2 is near 1, 3 only near 2, 9 near none; the hub is 0, near none of them."""
    base = list(range(100))
    held = {0: range(1000, 1100), 1: base, 2: [*base[10:], *range(200, 210)], 3: [*base[20:], *range(200, 220)], 9: range(40, 140)}
    sets = spark.createDataFrame([(i, list(map(int, x))) for i, x in held.items()], "point long, held array<long>")
    held |= {20: range(5000, 5127), 21: range(5001, 5131), 22: range(5001, 5156)}  # alike on both sides of a power of two
    sets = spark.createDataFrame([(i, list(map(int, x))) for i, x in held.items()], "point long, held array<long>")
    met = spark.createDataFrame([(i, len(x), 0, 7, True) for i, x in held.items()], "point long, n long, band int, key long, large boolean")
    none = spark.createDataFrame([], "node long, root long")
    for block, hashes in ((1, 1000), (2, 1 << 20), (256, 130), (256, 1 << 20)):
        found = similar.settle(met, none, sets, block=block, hashes=hashes)
        links = {(r.a, r.b) for r in found.collect()}
        assert {(1, 2), (2, 3), (20, 21), (21, 22)} <= links <= {(1, 2), (2, 3), (20, 21), (21, 22), (20, 22)}
    whole = spark.createDataFrame([(i, 0) for i in held], "node long, root long")
    assert similar.settle(met, whole, sets) is None


def test_one_row_of_a_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(None, text), (None, text), (3, text), (3, text), (3, text.upper()), (4, text), (4, "something else"), (None, "alone"), (None, "alone")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, _key string, point int")
    for drop in (similar.drop_similar, lambda d: simhash.drop_near_duplicates(d, words=5)):
        kept = [(r.doc_id, r.text) for r in drop(docs).collect()]
        assert len(kept) == 3 and (4, "something else") in kept and (None, "alone") in kept and sum(i == 3 for i, _ in kept) == 1
        assert drop(docs).columns == docs.columns and drop(docs.limit(0)).count() == 0


def test_other_texts_of_a_dropped_id_stay(spark):
    """One doc_id on two texts, one of them a copy of a smaller id's."""
    a, b = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (5, a), (5, b)], "doc_id long, text string")
    for drop in (similar.drop_similar, simhash.drop_near_duplicates):
        assert sorted((r.doc_id, r.text) for r in drop(docs).collect()) == [(1, a), (5, b)]


@pytest.mark.parametrize(("words", "radius"), [(5, 2), (3, 4)])
def test_simhash_of_other_words_and_radius(spark, words, radius):
    rng = random.Random(3)
    rows = near_rows()[:60] + [(1000 + i, " ".join(rng.choice("abcde") for _ in range(12))) for i in range(60)]
    prints = {i: simhash.simhash(t, words) for i, t in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(prints):
        for j in sorted(prints):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bucket in (64, 2):
        found = simhash.near_duplicates(docs, bucket, words, radius).collect()
        assert {r.doc_id: r.component_id for r in found} == {i: find(i) for i in root}

def test_stage_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()
    assert {r.doc_id for r in kept} == plain_kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
