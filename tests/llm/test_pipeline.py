"""The pipeline's stages against the plain versions of their decisions."""

import public_tokenizers
import pytest

import corpus_pipeline
from catalume.llm import quality
from tests.llm.test_similar import plain_kept

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, out[-1], DATA).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stage_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_filter", "exact_dedup", "near_dedup", "pack"]


def test_filters_keep_columns_and_rows(stages):
    docs = stages[0]
    for kept in stages[1:4]:
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        assert kept.exceptAll(docs).count() == 0


def test_quality_stage(spark, stages):
    docs = stages[0]
    judged = quality.classify(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    want = {r.doc_id for r in judged.where("predicted = 1").collect()}
    assert {r.doc_id for r in stages[1].select("doc_id").collect()} == want


def test_exact_stage(stages):
    best = {}
    for r in stages[1].collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in stages[2].select("doc_id").collect()} == set(best.values())


def test_near_stage(stages):
    """Five-word shingles, Jaccard similarity 0.8 or more, whatever SimHash at 3 bits says."""
    want = plain_kept([(r.doc_id, r.text) for r in stages[2].collect()])
    assert {r.doc_id for r in stages[3].select("doc_id").collect()} == want


def test_pack_stage(stages):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    want = {r.doc_id: len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in stages[3].collect()}
    got = {r["doc_id"]: r["n"] for r in stages[4].groupBy("doc_id").sum("length").withColumnRenamed("sum(length)", "n").collect()}
    assert got == want


def test_run_gives_the_same_rows(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, stages[4].collect()))
