"""The registered queries over whole tables."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from catalume.llm import queries

DATA = "/root/testdata/sf0.001"
FROM = {
    "op1_chat_format": None,
    "op2_bpe_roundtrip": "documents",
    "op3_simhash_dedup": "documents",
    "op4_url_filter": "pages",
    "op5_quality_classifier": "documents",
    "op6_html_main_text": "pages",
    "op7_packing": None,
    "op8_syncmer_fingerprints": "documents",
    "op9_hilbert_shards": "documents",
    "op10_exact_dedup": "documents",
    "op11_collocations": None,
    "op12_personal_data": "documents",
    "op13_prefix_trie": None,
}


@pytest.mark.parametrize("name", list(FROM))
def test_whole_table(spark, name):
    found = queries.queries()[name](spark, DATA)
    n = found.count()
    assert n and (FROM[name] is None or n == spark.read.parquet(f"{DATA}/{FROM[name]}.parquet").count())


def test_chat_digests(spark):
    talks = {}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        talks.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    talks[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for c, turns in talks.items():
        turns = sorted(turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    found = queries.op1_chat_format(spark, DATA).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == want


NATIVE = ("op1_chat_format", "op4_url_filter", "op8_syncmer_fingerprints", "op9_hilbert_shards", "op10_exact_dedup", "op12_personal_data")


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_have_no_python(spark, monkeypatch, name):
    """In no stage: everything that would start a Python worker is an error, and the last plan names none."""

    def refuse(*_, **__):
        raise AssertionError("Python in a native query")

    kind = type(spark.range(1))
    for method in ("mapInArrow", "mapInPandas", "foreach", "foreachPartition"):
        monkeypatch.setattr(kind, method, refuse)
    for method in ("applyInPandas", "applyInArrow"):
        monkeypatch.setattr(type(spark.range(1).groupBy("id")), method, refuse)
    for method in ("udf", "pandas_udf", "arrow_udf"):
        if hasattr(F, method):
            monkeypatch.setattr(F, method, refuse)
    monkeypatch.setattr(kind, "rdd", property(refuse))
    found = queries.queries()[name](spark, DATA)
    assert found.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_sql(spark):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        found = queries.queries()[name](spark, DATA)
        names = sorted(found.columns)
        have = duck.execute(sql)
        order = [d[0] for d in have.description]
        want = sorted(tuple(r[order.index(n)] for n in names) for r in have.fetchall())
        assert sorted(tuple(r) for r in found.select(*names).collect()) == want


def test_main_text_of_articles(spark):
    import html as entities
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in queries.op6_html_main_text(spark, DATA).select("page_id", "text", F.length("text").alias("n")).collect():
        inside = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        bare = entities.unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", inside).replace("<b>", "").replace("</b>", ""))
        assert r.text == " ".join(bare.split()) and r.n == len(r.text)
