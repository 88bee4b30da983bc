"""Postings in blocks, pruned search, kept vectors, evaluation of several rankings with its history."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalume.config import Settings
from catalume.functions import text
from catalume.operators import embedding, lexical, postings, ranking

COLUMNS = ["nome", "tags", "resumo"]


def table(spark, rows=3000):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    data = [(i, rng.choice(words), rng.choice(["t1", "t2", None]), " ".join(["the", *(rng.choice(words) for _ in range(rng.randrange(6)))])) for i in range(rows)]
    return data, spark.createDataFrame(data, "doc long, nome string, tags string, resumo string")


def test_blocks(spark):
    """Every occurrence stands in one block; a frequent term has many, none too large, and each says what it holds."""
    data, index = table(spark)
    blocks = postings.postings(index, COLUMNS, parts=3)
    want = collections.Counter()
    for doc, *cols in data:
        for c, body in enumerate(cols):
            for pos, term in enumerate((body or "").split()):
                want[term, doc, c, pos] += 1
    assert collections.Counter((r.term, r.doc, r.col, r.pos) for r in postings.unpacked(blocks).collect()) == want
    counts = collections.Counter()
    for term, doc, c, _ in want:
        counts[term, doc, c] += 1
    assert {(r.term, r.doc, r.col): r.n for r in postings.counted(blocks).collect()} == dict(counts)
    lengths = collections.Counter(doc for _, doc, _, _ in want.elements())
    seen = blocks.collect()
    assert sum(r.term == "the" for r in seen) >= 3 and max(r.n for r in seen) <= postings.BLOCK
    for r in seen:
        assert r.docs == sorted(set(r.docs)) and (r.low, r.high, r.n) == (r.docs[0], r.docs[-1], len(r.docs))
        assert r.lengths == [lengths[d] for d in r.docs] and r.least == min(r.lengths)
        assert r.most == [max(counts[r.term, d, c] for d in r.docs) for c in range(3)]
        assert r.n_text == sum(any(counts[r.term, d, c] for c in (0, 2)) for d in r.docs)


def test_tokens_cut_like_columns(spark):
    """Texts cut in tasks give what the column expression gives, for every letter and mark there is; the first ones too."""
    points = [chr(p) for p in [*range(0x34000), *range(0xE0000, 0xE0200)] if not 0xD800 <= p < 0xE000]
    texts = ["".join(f"x{c}Y {c} " for c in points[at : at + 500]) for at in range(0, len(points), 500)]
    texts += [None, "", "\n", "ΟΔΟΣ ΣΑΣ. Σ ΑΣ'Α İΣ", "e\u0301a \u0301b c\u0301", "Ação_b-2", "a b c d e f g Σ'Α ΣΑΣ'Α j", "A\u0301" * 20 + " ç"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    want = rows.select(text.tokens(F.col("t")).alias("t"), text.first_tokens(F.col("t"), 8).alias("first")).collect()
    terms, sizes = postings.cut(pa.array(texts, pa.string()), text.fold_table(spark))
    ends = np.cumsum(sizes)
    got = [terms[int(high - n) : int(high)].to_pylist() for n, high in zip(sizes, ends, strict=True)]
    assert got == [r.t for r in want]
    assert [r.first for r in want] == [r.t[:8] for r in want]


def test_slices_become_blocks(spark, monkeypatch):
    """Whatever the slices are, documents of a block rise, and every document has its length, an empty one too."""
    monkeypatch.setattr(postings, "CUT", 300)
    monkeypatch.setattr(postings, "MERGED", 50)
    data = [(9 * k % 1000, f"a b{k % 7} a", None if k % 5 else "a") for k in range(1000)] + [(1000, "", None)]
    index = spark.createDataFrame(data, "doc long, nome string, tags string").coalesce(2)
    slices = postings.by_slice(index, ["nome", "tags"])
    assert slices.where("term = 'a'").count() > 20
    assert {(r.doc, r.length) for r in postings.lengths(slices).collect()} == {(d, len(f"{n} {t or ''}".split())) for d, n, t in data}
    blocks = postings.in_blocks(slices, ["nome", "tags"], parts=2).collect()
    assert all(r.docs == sorted(set(r.docs)) and r.n == len(r.docs) and len(r.pos) == len(r.cols) == sum(r.times) for r in blocks)
    assert sorted(d for r in blocks if r.term == "a" for d in r.docs) == list(range(1000))
    assert sum(r.n_text for r in blocks if r.term == "a") == 1000 and {r.term for r in blocks} == {"a", *(f"b{k}" for k in range(7))}


def test_phrases_of_shared_terms(spark):
    """Phrases of several lengths that share their terms, over columns that meet; no occurrence is repeated for each phrase of its term."""
    rows = [(1, "a b a b c", "c a"), (2, "b", "a b"), (3, "a x b c", "a a a")]
    index = lexical.build(spark.createDataFrame(rows, "doc long, nome string, tags string"), ["nome", "tags"])
    words = "a_b b_a a_a b_c c_c a_b_c a_b_a_b b_c_a x_b_c"
    asked = spark.createDataFrame([(1, words), (2, "a b c")], "qid long, question string")
    found = lexical.occurrences(index, lexical.question_phrases(asked))
    want = collections.Counter()
    for doc, *bodies in rows:
        for col, body in zip(["nome", "tags"], bodies, strict=True):
            t = body.split()
            for raw in [*words.split(), "a", "b", "c"]:
                p = raw.split("_")
                want[raw, doc, col] += sum(t[i : i + len(p)] == p for i in range(len(t)))
    assert {(r.raw, r.doc, r.col): r.n for r in found.collect()} == {k: n for k, n in want.items() if n}
    many = spark.createDataFrame([(1, " ".join(f"a_{c}" for c in "abcdefgh"))], "qid long, question string")
    plan = lexical.occurrences(index, lexical.question_phrases(many)).where("raw like '%\\\\_%'")._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan and "Window" in plan


def test_no_documents(spark):
    _, index = table(spark, 1)
    empty = postings.postings(index.limit(0), COLUMNS)
    assert empty.count() == 0 and postings.counted(empty).count() == 0
    assert postings.postings(index.select("doc", *(F.lit("").alias(c) for c in COLUMNS)), COLUMNS).count() == 0


@pytest.mark.parametrize("limit", [1, 10, 5000])
def test_pruned_search_like_all_scores(spark, tmp_path, limit):
    """The best documents are those that scoring every document gives, whatever the bounds leave out."""
    _, index = table(spark)
    settings = Settings(weights={"nome": 3.0, "tags": 1.5, "resumo": 1.0}, confidence={"alta": 1.0, "baixa": 0.55})
    cards = index.select("doc", F.when(F.col("doc") % 3 == 0, "baixa").otherwise("alta").alias("confianca"))
    asked = spark.createDataFrame([(1, "the w1 w2 w3"), (2, "w5"), (3, "w1_w2 w9 the"), (4, "nothing"), (5, "w7 w8 t1 w9 w10 w11 w12")], "qid long, question string")
    lexical.write(index, COLUMNS, str(tmp_path / "i"), files=4)
    made = lexical.read(spark, str(tmp_path / "i"))
    phrases = lexical.question_phrases(asked)
    found = lexical.occurrences(made, phrases)
    freq = lexical.term_frequencies(found)
    ones = phrases.where("size(phrase) = 1").select("raw").distinct()
    assert sorted(map(tuple, lexical.block_frequencies(made, phrases).collect())) == sorted(map(tuple, freq.join(ones, "raw", "left_semi").select("raw", "in_text", "anywhere").collect()))
    useful = lexical.keep_useful(phrases, freq, made.stats, settings)
    scores = lexical.penalized(lexical.bm25(useful, found, freq, made.lengths, made.stats, settings), cards, settings)
    want = lexical.top(scores, limit).select("qid", "doc", "posicao", "score")
    assert sorted(map(tuple, lexical.search_index(made, cards, asked, settings, limit).collect())) == sorted(map(tuple, want.collect()))
    bounded = lexical.bounds(made, useful, freq, settings).groupBy("qid", "raw").agg(F.max("bound").alias("bound"))
    alone = lexical.bm25(useful.where("qid = 5"), found, freq, made.lengths, made.stats, settings).agg(F.max("score")).first()[0]
    assert alone <= bounded.where("qid = 5").agg(F.sum("bound")).first()[0]


def test_essential_terms(spark):
    bounded = spark.createDataFrame([(1, "a", 9.0), (1, "b", 2.0), (1, "c", 1.0), (1, "c", 0.5), (2, "d", 1.0)], "qid long, raw string, bound double")
    floor = spark.createDataFrame([(1, 4.0)], "qid long, floor double")
    assert {(r.qid, r.raw) for r in lexical.essential(bounded, floor).collect()} == {(1, "a"), (2, "d")}
    assert {(r.qid, r.raw) for r in lexical.telling(bounded).collect()} == {(1, "a"), (2, "d")}


def test_model_is_loaded_once_a_worker(spark, tmp_path):
    """Its vectors carry the prefix; what another model or catalog made is refused."""
    marks = tmp_path / "loads"
    marks.mkdir()

    def load():
        import os
        import uuid

        (marks / f"{os.getpid()}-{uuid.uuid4().hex}").touch()
        return lambda texts: np.array([[len(t), t.count("a"), 1.0 if t.startswith("passage: ") else 0.0] for t in texts])

    model = embedding.Model(f"count-{tmp_path.name}", 3, load)
    rows = spark.range(0, 500, 1, 6).select("id", F.concat(F.lit("a"), "id").alias("text"))
    embedding.keep_vectors(rows, "text", model, str(tmp_path / "v"), "one")
    kept = embedding.kept_vectors(spark, str(tmp_path / "v"), model, "one")
    pids = [p.name.split("-")[0] for p in marks.iterdir()]
    assert len(pids) == len(set(pids)) and kept.count() == 500
    one = kept.where("id = 7").first().vetor
    assert one == pytest.approx(list(np.array([11, 3, 1]) / np.sqrt(121 + 9 + 1)))
    for other, version in ((model, "two"), (embedding.hashed(3), "one")):
        with pytest.raises(ValueError, match="vectors were made for"):
            embedding.kept_vectors(spark, str(tmp_path / "v"), other, version)


def test_texts_without_vector(spark):
    rows = spark.createDataFrame([(1, "b"), (2, None), (3, "aa")], "id long, text string")
    model = embedding.Model("as", 1, lambda: lambda texts: [[t.count("a") - 2] for t in texts])
    assert {r.id: r.vetor for r in embedding.embed(rows, "id", "text", model, embedding.PASSAGE).collect()} == {3: [1.0]}


def test_several_rankings(spark, tmp_path):
    asked = spark.createDataFrame([(1, "t", "f", ["a", "b"]), (2, "t", "g", []), (3, None, "f", ["c"])], "qid long, tema string, dificuldade string, aceitaveis array<string>")
    found = spark.createDataFrame([("x", 1, "z", 1), ("x", 1, "b", 2), ("x", 3, "d", 1), ("y", 2, "a", 1), ("y", 3, "c", 7)], "ranking string, qid long, name string, posicao long")
    hits = ranking.ranked_hits(asked, found, ["x", "y"])
    assert {(r.ranking, r.qid): r.posicao for r in hits.collect()} == {("x", 1): 2, ("x", 2): 1, ("x", 3): None, ("y", 1): None, ("y", 2): None, ("y", 3): 7}
    assert {tuple(map(str, r)) for r in ranking.failures(hits).where("qid = 3").collect()} == {("x", "3", "['c']", "['d']"), ("y", "3", "['c']", "[]")}
    by = {(r.ranking, r.segmento, r.valor): (r.total, r.recall_5, r.recall_10) for r in ranking.metrics_by_ranking(hits).collect()}
    assert by["x", "geral", ""] == (3, 0.6667, 0.6667) and by["y", "dificuldade", "f"] == (2, 0.0, 0.5) and by["y", "tema", None][0] == 1
    cards = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    path = str(tmp_path / "runs")
    assert ranking.history(spark, path).count() == 0
    assert ranking.record(ranking.metrics_by_ranking(hits), asked, cards, path) == 1
    worse = ranking.ranked_hits(asked, found.where("qid = 2"), ["x", "y"])
    assert ranking.record(ranking.metrics_by_ranking(worse), asked, cards, path) == 2
    (tmp_path / "runs" / "part-broken.json").write_text("{nonsense\n")
    last = {r.kind: (r.run_no, r.recall_5, r.before, r.regressed) for r in ranking.last_runs(spark, path).collect()}
    assert last == {"x": (2, 0.3333, 0.6667, True), "y": (2, 0.0, 0.0, False)}
    with pytest.raises(ValueError, match="without a card: b, c"):
        ranking.record(ranking.metrics_by_ranking(hits), asked, cards.where("name = 'a'"), path)
    assert ranking.history(spark, path).agg(F.max("run_no")).first()[0] == 2


def test_frequencies_without_postings(spark, monkeypatch):
    """How frequent tokens are is read from what blocks say; no posting is unpacked for it."""
    from catalume.plans import queries

    def refuse(blocks):
        raise AssertionError("postings are unpacked")

    wanted = {q: queries.REGISTRY[q](spark, "/root/testdata/sf0.001").count() for q in ("stop_terms", "term_frequency")}
    monkeypatch.setattr(postings, "counted", refuse)
    assert min(wanted.values()) > 0
    assert wanted == {q: queries.REGISTRY[q](spark, "/root/testdata/sf0.001").count() for q in wanted}


def test_packed_blocks(spark):
    """Lists travel as bytes; a frequent term's rows are dealt out, a rare term's come together, all documents stand apart."""
    rows = spark.range(0, 6000, 1, 12).select(F.col("id").alias("doc"), F.concat_ws(" ", F.lit("the"), F.expr("if(id % 1500 = 0, 'rare', 'x')")).alias("nome"))
    blocks = postings.packed(postings.by_slice(rows, ["nome"]), ["nome"], parts=4)
    assert {d for n, d in blocks.dtypes if n in postings.LISTS} == {"binary"}
    seen = blocks.select("term", "n", F.spark_partition_id().alias("part")).collect()
    assert len({r.part for r in seen if r.term == "the"}) > 1
    assert [r.n for r in seen if r.term == "rare"] == [4]
    assert sum(r.n for r in seen if r.term is None) == 6000 and sum(r.n for r in seen if r.term == "the") == 6000


def test_scores_from_blocks(spark, tmp_path, monkeypatch):
    """What tasks compute from blocks are the scores that joins give, for words said in two ways, phrases, and questions in several batches."""
    monkeypatch.setattr(postings, "PASSED", 100)
    _, index = table(spark)
    settings = Settings(weights={"nome": 3.0, "tags": 1.5, "resumo": 1.0})
    asked = spark.createDataFrame([("a", "The the w1 W1 w2 w3"), ("b", "w5"), ("c", "w1_w2 w9"), ("d", "nothing"), ("e", "w5 w6 w7")], "qid string, question string")
    lexical.write(index, COLUMNS, str(tmp_path / "i"), files=4)
    made = lexical.read(spark, str(tmp_path / "i"))
    useful, freq, rare = lexical.judge(made, asked, settings)
    assert rare.count() > 0
    found = lexical.occurrences(made, lexical.question_phrases(asked))
    want = {(r.qid, r.doc): r.score for r in lexical.bm25(useful, found, freq, made.lengths, made.stats, settings).collect()}
    scores = lexical.scores(made, useful, freq, rare, settings)
    assert {(r.qid, r.doc): r.score for r in scores.collect()} == pytest.approx(want) and len(want) > 500
    single = lexical.scores(made, useful.where("size(phrase) = 1"), freq, None, settings)
    plan = single._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and plan.count("Join") == 1


def test_hashed_vectors_like_md5(spark):
    """A word's place is the first 16 bits of its MD5, however it was said; texts are cut in the workers, not by column expressions."""
    import hashlib

    texts = ["Ação ação b_2 the the", "", None, "x\n\nY " * 40]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    model = embedding.hashed(16)
    made = embedding.embed(rows, "id", "text", model, embedding.PASSAGE)
    for r in made.collect():
        want = np.zeros(16)
        for w in ["passage", *"acao acao b 2 the the".split()] if r.id == 0 else ["passage", *["x", "y"] * (40 if r.id == 3 else 0)]:
            want[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 16] += 1
        assert r.vetor == pytest.approx(list(want / np.linalg.norm(want)))
    assert made.count() == 4 and "regexp" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_acceptable_without_shuffled_texts(spark, tmp_path):
    """The few documents that may hold a question's text are counted before texts are read, so no text is shuffled."""
    docs = spark.range(2000).select(F.col("id").alias("doc"), F.concat_ws(" ", F.lit("w"), F.expr("repeat(sha2(string(id), 512), 20)"), F.col("id")).alias("text"))
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    lexical.write(docs, ["text"], str(tmp_path / "i"), files=2)
    asked = spark.createDataFrame([(1, " 77"), (2, "absent")], "qid long, whole string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50k")
    try:
        found = ranking.acceptable(asked, docs, lexical.read(spark, str(tmp_path / "i")))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert {tuple(r) for r in found.collect()} == {(1, 77)}
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_explained_documents_alone_are_cut(spark):
    """Columns of the index are made of documents that are results, not of all."""
    from catalume.plans import catalog

    some = spark.createDataFrame([(3,), (3,), (5,)], "doc long")
    assert sorted(r.doc for r in catalog.index(spark, "/root/testdata/sf0.001", some).collect()) == [3, 5]


def test_single_ranking_makes_no_vectors(spark, monkeypatch):
    """One ranking is fused without the other, whose vectors would be made and written for nothing."""
    from catalume.plans import catalog, queries

    def refuse(*_):
        raise AssertionError("vectors are made")

    monkeypatch.setattr(catalog, "document_vectors", refuse)
    rows = queries.REGISTRY["rrf_single_ranking"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.rrf == round(1 / (60 + r.posicao), 9) for r in rows)


def test_index_of_asked_terms(spark, tmp_path):
    """An index made for some terms says of them, of lengths and of statistics what the whole one says; it holds few others, and refuses them."""
    long = ["ação" * 9 + "x", "ação" * 9 + "y", "b" * 8, "日本語", "w1"]
    docs = spark.createDataFrame([(i, f"w{i} {long[i % 5]} {long[i * 7 % 5]}.", "t") for i in range(3000)], "doc long, nome string, tags string")
    questions = spark.createDataFrame([(1, f"{long[0]} b_w1 nothing"), (2, "éa " + long[3]), (3, ""), (4, "w77 w1 w78")], "qid long, question string")
    terms = lexical.asked_terms(questions)
    assert {r.term for r in terms.collect()} == {("acao" * 9) + "x", "b", "w1", "nothing", "e", "a", "ea", long[3], "w77", "w78"}
    made = []
    for name, asked in (("all", None), ("asked", terms)):
        lexical.write(docs, ["nome", "tags"], str(tmp_path / name), files=3, asked=asked)
        made.append(lexical.read(spark, str(tmp_path / name)))
    whole, some = made
    for part in ("lengths", "stats"):
        assert sorted(map(tuple, getattr(whole, part).collect())) == sorted(map(tuple, getattr(some, part).collect()))
    found = [{tuple(r) for r in postings.unpacked(i.posted.join(terms, "term", "left_semi")).collect()} for i in made]
    assert found[0] == found[1] and len(found[0]) > 2000
    assert whole.posted.select("term").distinct().count() > 3000 and some.posted.select("term").distinct().count() < 50
    judged = [lexical.judge(i, questions, Settings()) for i in made]
    scores = [{tuple(r) for r in lexical.scores(i, *j, Settings()).collect()} for i, j in zip(made, judged, strict=True)]
    assert scores[0] == scores[1] and scores[0]
    for other in (spark.createDataFrame([(1, "w2")], "qid long, question string"), spark.createDataFrame([(1, "w1 w1_w2")], "qid long, question string")):
        with pytest.raises(ValueError, match="w2"):
            lexical.judge(some, other, Settings())
        with pytest.raises(ValueError, match="w2"):
            lexical.occurrences(some, lexical.question_phrases(other))
    with pytest.raises(ValueError, match="w2"):
        ranking.acceptable(spark.createDataFrame([(1, "w2")], "qid long, whole string"), docs.withColumnRenamed("nome", "text"), some)
    nothing = postings.by_slice(docs, ["nome"], spark.createDataFrame([], "term string"))
    assert nothing.where("term is not null").isEmpty() and postings.lengths(nothing).count() == 3000


def test_catalog_index_has_the_questions_terms(spark):
    """The registered queries' index has each token of the questions that a document has, and hardly any other of the corpus."""
    from catalume.plans import catalog

    kept = {r.term for r in catalog.lexical_index(spark, "/root/testdata/sf0.001").posted.select("term").distinct().collect()}
    index = catalog.index(spark, "/root/testdata/sf0.001")
    there = {r.t for c in index.columns[1:] for r in index.select(F.explode(text.tokens(F.col(c))).alias("t")).distinct().collect()}
    asked = {r.term for r in lexical.asked_terms(catalog.questions(spark, "/root/testdata/sf0.001")).collect()}
    assert kept & asked == there & asked and len(kept - asked) < 0.05 * len(there) and len(there) > 3 * len(kept)


def test_cutting_is_bounded(spark):
    """What a worker needs besides a batch of texts is little, however large the batch."""
    import tracemalloc

    folds = spark.sparkContext.broadcast(text.fold_table(spark))
    words = " ".join(f"w{i % 5000}" for i in range(20_000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([words] * 100)], ["doc", "text"])
    seen, run = 0, postings._sliced(folds, None)
    assert folds.value is not None
    tracemalloc.start()
    for made in run(iter([batch])):
        seen += sum(made.column(0).is_null().to_pylist()) and len(made.column(2)[made.num_rows - 1].as_py()) // 8
        del made
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 100 and peak < 48 << 20


def test_texts_reach_a_model_by_size(spark):
    """A model gets few long texts at once, many short ones, each text once and whole."""
    texts = ["x" * n for n in [10] * 150 + [700_000] * 5 + [0] + [3_000_000] + [10] * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)

    def load():
        def encode(given):
            return np.array([[1.0, len(given), sum(map(len, given)), len(t)] for t in given])

        return encode

    model = embedding.Model("sizes", 4, load)
    made = {r.id: r.vetor for r in embedding.embed(rows, "id", "text", model, "").collect()}
    assert len(made) == len(texts)
    for i, (one, count, size, own) in made.items():
        assert round(own / one) == len(texts[i])
        assert round(count / one) == 1 or (round(count / one) <= embedding.AT_ONCE and round(size / one) <= embedding.BYTES)
    assert round(made[0][1] / made[0][0]) == embedding.AT_ONCE


def test_words_are_digested_side_by_side(spark, monkeypatch):
    """Places are those of MD5 for words of any length; only words beyond 55 bytes go to the library, one by one."""
    import hashlib

    words = ["a", "ß", "日本", "w" * 55, "w" * 56, "ß" * 40, "x" * 63, "x" * 64, "y" * 300, *(f"w{i}" * (1 + i % 27) for i in range(9000))]
    want = [int(hashlib.md5(w.encode()).hexdigest()[:4], 16) for w in words]
    asked, whole = [], hashlib.md5
    monkeypatch.setattr(embedding.hashlib, "md5", lambda word: asked.append(word) or whole(word))
    made = embedding.hashed(1 << 16).load(text.fold_table(spark))(words[:9])
    assert [int(row.argmax()) for row in made] == want[:9] and (made.sum(axis=1) == 1).all()
    assert sorted(asked) == sorted(w.encode() for w in words[:9] if len(w.encode()) > 55)
    assert embedding._md5_heads(pa.array(words)).tolist() == want and embedding._md5_heads(pa.array(words).slice(3, 8500)).tolist() == want[3:8503]
    assert embedding._md5_heads(pa.array([], pa.string())).tolist() == []


def test_texts_cut_as_bytes(spark):
    """Texts whose folded letters are all below 256 are cut as bytes, dashes and quotes among them; others as they were. Both give Spark's tokens."""
    folds = text.fold_table(spark)
    plain = ["Ação – “naïve” Œ… ŐŁ ß µ ª", "", "x", " ÿÀ¼ ", "€"]
    wide = ["Σας ΑΣ", "日本 語a", "e\u0301te\u0301", "\U0001d49c b", "İi"]
    for texts, narrow in ((["Ação – “naïve” ß"], True), (plain[1:], True), (wide, False), ([*plain, *wide], False)):
        assert (postings._points("\n".join(texts) + "\n", folds).dtype == np.uint8) == narrow
        terms, sizes = postings.cut(pa.array([*texts, None], pa.string()), folds)
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").select(text.tokens(F.col("t")).alias("w")).collect()
        assert terms.to_pylist() == [w for r in rows for w in r.w] and sizes.tolist() == [*(len(r.w) for r in rows), 0]


def test_index_of_few_terms_is_not_shuffled(spark, tmp_path, monkeypatch):
    """Blocks of few asked terms are made where texts are cut, and a document's score comes from there as one row; those of many come together by term."""
    docs = spark.createDataFrame([(i, f"w{i % 50} w{i % 7} the", "t") for i in range(4000)], "doc long, nome string, tags string").repartition(3)
    asked = spark.createDataFrame([(f"w{i}",) for i in range(50)] + [("the",)], "term string")
    made = postings.packed_in_place(docs, ["nome", "tags"], asked)
    assert "hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()
    lexical.write(docs, ["nome", "tags"], str(tmp_path / "few"), asked=asked)
    monkeypatch.setattr(lexical, "FEW", 50)
    lexical.write(docs, ["nome", "tags"], str(tmp_path / "many"), asked=asked, files=2)
    few, many = (lexical.read(spark, str(tmp_path / n)) for n in ("few", "many"))
    found = [sorted(map(tuple, postings.unpacked(i.posted.join(asked, "term", "left_semi")).collect())) for i in (few, many)]
    assert found[0] == found[1] and len(found[0]) == 12000
    for part in ("lengths", "stats"):
        assert sorted(map(tuple, getattr(few, part).collect())) == sorted(map(tuple, getattr(many, part).collect()))
    known = asked.select("term", F.expr("if(term = 'the', array('a', 'b'), array('a'))").alias("qids"), F.lit(1.0).alias("idf"), F.lit(3.0).alias("mean_length"))
    rows = postings.scored(few.posted.join(F.broadcast(known), "term"), [1.0, 1.0], 1.2, 0.75).collect()
    assert len(rows) == len({(r.qid, r.doc) for r in rows}) == 8000
    want = postings.scored(many.posted.join(known, "term"), [1.0, 1.0], 1.2, 0.75).groupBy("qid", "doc").agg(F.sum("part")).collect()
    assert {(r.qid, r.doc): r.part for r in rows} == pytest.approx({(r.qid, r.doc): r[2] for r in want})


def test_far_documents_are_added_up():
    """Numbers of documents that are too far apart to be told with the question in one number are added up all the same."""
    docs = np.array([-(2**63), 2**63 - 1, 5, -(2**63), 5, 5])
    asked, parts = np.array([1, 0, 2, 1, 2, 0]), np.arange(6.0)
    made = postings._added(asked, docs, parts, 3)
    assert sorted(zip(*(x.tolist() for x in made), strict=True)) == [(0, 5, 5.0), (0, 2**63 - 1, 1.0), (1, -(2**63), 3.0), (2, 5, 6.0)]


def test_tasks_pass_on_their_best_scores(spark):
    """A task sorts and passes on few rows; ties, nulls and scores that are no number stand where they stood."""
    from pyspark.sql import Window

    rows = [(q, f"d{i * 37 % 500:03d}", float(i % 9)) for q in ("a", "b", None) for i in range(500)]
    rows += [("a", "nan", float("nan")), ("b", None, 8.0), ("a", "null", None), ("c", "x", 1.0000004), ("c", "a", 1.0), ("d", None, None)]
    scores = spark.createDataFrame(rows, "qid string, doc string, score double").repartition(3)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc"))).cast("long")
    for limit in (1, 4, 600):
        want = scores.withColumn("score", F.round("score", 6)).withColumn("posicao", place).where(F.col("posicao") <= limit)
        found = lexical.top(scores, limit)
        assert found.columns == want.columns and sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    numbers = spark.range(0, 20000, 1, 2).select((F.col("id") % 2).alias("qid"), F.col("id").alias("doc"), (F.col("id") % 100).cast("double").alias("score"))
    assert numbers.mapInArrow(lexical._best(5, "doc", "score"), numbers.schema).count() == 2 * 2 * 5
    assert [(r.qid, r.doc, r.posicao) for r in lexical.top(numbers, 2).orderBy("qid", "posicao").collect()] == [(0, 98, 1), (0, 198, 2), (1, 99, 1), (1, 199, 2)]


def test_few_names_do_not_have_cards_shuffled(spark, tmp_path):
    """Cards are met by the names that questions cite, once for each run recorded; a history that is not there yet is no task in Python."""
    spark.range(50_000).select(F.concat(F.lit("n"), F.col("id")).alias("name")).write.parquet(str(tmp_path / "c"))
    cards = spark.read.parquet(str(tmp_path / "c"))
    asked = spark.createDataFrame([(["n1", "n49999", "lost"],), (["gone", "n1"],), ([],)], "aceitaveis array<string>")
    asked.write.parquet(str(tmp_path / "q"))
    broken = ranking.broken_annotations(spark.read.parquet(str(tmp_path / "q")), cards)
    assert sorted(r.name for r in broken.collect()) == ["gone", "lost"]
    assert "LeftSemi" in broken._jdf.queryExecution().optimizedPlan().toString()
    empty = ranking.history(spark, str(tmp_path / "nothing"))
    assert empty.count() == 0 and empty.dtypes == spark.createDataFrame([], ranking.RUN).dtypes
    assert "Scan ExistingRDD" not in empty._jdf.queryExecution().executedPlan().toString()


def test_blocks_stay_where_they_are(spark, tmp_path):
    """Questions' words are handed to the tasks that read blocks, whatever Spark would broadcast; blocks are not dealt out by term for them."""
    _, index = table(spark)
    lexical.write(index, COLUMNS, str(tmp_path / "i"), files=4)
    made = lexical.read(spark, str(tmp_path / "i"))
    useful, freq, _ = lexical.judge(made, spark.createDataFrame([(1, "the w1 w2 w3")], "qid long, question string"), Settings())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = lexical.scores(made, useful, freq, None, Settings())
        plan = scores._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(term" not in plan
