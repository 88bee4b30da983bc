"""Tables that are replaced as a whole: one winner, nothing lost, old states gone."""

import threading

import pytest
from pyspark.sql import functions as F

from catalume.operators import ingest, sinks


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def test_one_writer_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.current(spark, path) is None and sinks.versions(spark, path) == {}
    sinks.commit(rows(spark, 1), path, 0)
    with pytest.raises(sinks.Conflict):
        sinks.commit(rows(spark, 2), path, 0)
    assert [r.v for r in sinks.current(spark, path).collect()] == [1]
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "t").iterdir()) == ["current", "v1"]


def test_two_writers_lose_nothing(spark, tmp_path):
    """Each adds its values to the state that it finds; both had begun from the same one."""
    path, both = str(tmp_path / "t"), threading.Barrier(2)
    sinks.replace(rows(spark, 0), path)

    def add(first):
        waited = []

        def change(old):
            if not waited:
                waited.append(both.wait(60))
            return old.unionByName(rows(spark, *range(first, first + 3)))

        sinks.update(spark, path, change)
        sinks.update(spark, path, lambda old: old.unionByName(rows(spark, first + 3)))

    writers = [threading.Thread(target=add, args=(k,)) for k in (10, 20)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(r.v for r in sinks.current(spark, path).collect()) == [0, 10, 11, 12, 13, 20, 21, 22, 23]
    assert len(sinks.versions(spark, path)) == 3


def test_dead_writers_are_passed_over(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sinks.replace(rows(spark, 1), path)
    (tmp_path / "t" / "current" / "2").touch()
    assert [r.v for r in sinks.current(spark, path).collect()] == [1]
    monkeypatch.setattr(sinks, "CLAIM_SECONDS", 0.5)
    sinks.update(spark, path, lambda old: old.withColumn("v", F.col("v") + 1))
    assert list(sinks.versions(spark, path)) == [1, 3] and sinks.current(spark, path).first().v == 2
    with pytest.raises(sinks.Conflict):
        sinks.commit(rows(spark, 9), path, 1)


def test_old_states_go(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(5):
        sinks.update(spark, path, lambda old: rows(spark, k), keep=2)  # noqa: B023
    assert list(sinks.versions(spark, path)) == [4, 5] and sinks.current(spark, path).first().v == 4
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v")]) == 2


def test_buckets_join_without_a_shuffle(spark, tmp_path):
    left = sinks.write_bucketed(spark.range(500).selectExpr("id % 50 as k", "id as v"), f"file://{tmp_path}/a", "k", 4)
    right = sinks.write_bucketed(spark.range(50).selectExpr("id as k", "id * 2 as w"), f"file://{tmp_path}/b", "k", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = left.join(right, "k").groupBy("k", "w").agg(F.sum("v").alias("v"))
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert {r.k: (r.w, r.v) for r in found.collect()} == {k: (2 * k, sum(range(k, 500, 50))) for k in range(50)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ingestion_is_counted_while_it_is_written(spark, tmp_path):
    """One pass over the lines; too many rejected lines raise behind the commit."""
    raw = ['{"id": 1, "recursos": [{"id": "a"}, {"id": "b"}, 3]}', "", '{"id": 2}', "[]", "{broken", '{"nome": "x"}', '{"id": 3, "recursos": [{"id": 5}]}']
    lines = spark.createDataFrame(list(enumerate(raw, 1)), "linha long, raw string")
    counts = ingest.ingest(lines, str(tmp_path / "fine"), 0.9)
    assert counts == {"lidos": 6, "conjuntos": 2, "recursos": 2, "rejeitados": 4, "taxa": 0.666667, "acima": False}
    assert counts == ingest.report(lines, 0.9).first().asDict()
    with pytest.raises(ingest.TooManyRejected):
        ingest.ingest(lines, str(tmp_path / "bad"), 0.05)
    good, bad = ingest.ingested(spark, str(tmp_path / "bad"))
    assert sorted(r.id for r in ingest.datasets(good).collect()) == ["1", "2"]
    assert sorted(map(tuple, bad.collect())) == sorted(map(tuple, ingest.split_quarantine(lines)[1].collect()))
    assert ingest.ingest(lines.limit(0), str(tmp_path / "none"), 0.05)["taxa"] == 0.0
