"""Streams that are stopped, fail, are run twice, or give up state."""

import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from catalume.operators import limiter
from catalume.plans import streams
from catalume.sources import portal
from catalume.streaming import cache, ingestion, whole
from catalume.streaming import limiter as stream


def write_pages(folder, pages):
    folder.mkdir(exist_ok=True)
    for n, records in pages.items():
        (folder / f"{n}.json").write_text(records if isinstance(records, str) else json.dumps({"dados": records}))
    return {"url": f"file://{folder}/{{page}}.json", "pause": "0", "asks": "2", "step": "2"}


def test_stream_reader_offsets(tmp_path):
    options = write_pages(tmp_path / "p", {1: [{"id": 1}], 2: [], 3: [{"id": 3}], 4: [{"id": 4}]})
    reader = portal.PortalStreamReader(options)
    assert reader.initialOffset() == {"pagina": 0}
    assert reader.latestOffset() == {"pagina": 2} == reader.latestOffset()
    assert [p.number for p in reader.partitions({"pagina": 0}, {"pagina": 2})] == [1, 2]
    assert reader.latestOffset() == {"pagina": 4}  # page 2 is empty, page 3 is not
    assert list(reader.read(portal.Page(3))) == [(3, 1, None), (3, None, '{"id": 3}')]
    assert reader.partitions({"pagina": 4}, {"pagina": 4}) == []
    reader.partitions({"pagina": 2}, {"pagina": 4})
    assert reader.latestOffset() == {"pagina": 6}  # the two empty ones, once
    reader.partitions({"pagina": 4}, {"pagina": 6})
    assert reader.latestOffset() == {"pagina": 6}
    assert portal.PortalStreamReader({**options, "after": "4"}).latestOffset() == {"pagina": 6}


def test_batches_grow_where_they_may(spark, tmp_path):
    """With ``most`` a listing of 150 pages takes few batches and partitions; its pages and end are the same, also past a gap."""
    pages = {n: [{"id": 3 * n + k} for k in range(3)] for n in range(1, 151) if n != 70}
    options = write_pages(tmp_path / "p", pages) | {"most": "128"}
    reader, at, sizes = portal.PortalStreamReader(options), 0, []
    while (end := reader.latestOffset()["pagina"]) > at:
        parts = reader.partitions({"pagina": at}, {"pagina": end})
        assert [n for p in parts for n in range(p.number, p.number + p.count)] == list(range(at + 1, end + 1)) and len(parts) <= portal.PARTS
        sizes.append(end - at)
        at = end
    assert at == 152 and len(sizes) < 15 and max(sizes) <= 128 and sizes[:4] == [2, 4, 8, 16]
    done = ingestion.collect(spark, options, str(tmp_path / "t"), str(tmp_path / "c"))
    assert done["concluida"] and done["ultima_pagina"] == 152
    assert ingestion.taken(spark, f"{tmp_path}/t/pages", ingestion.PAGES).where("n > 0").count() == 149


def test_collect_goes_on_after_a_page_that_failed(spark, tmp_path):
    """The pages before the failing one's batch stay; the next run takes its batch, each record stands once, the end is believed."""
    pages = {1: [{"id": 1}, {"id": 2}], 2: [{"id": 2}, {"id": 3}], 3: [{"id": 4}, {"nome": "x"}], 4: "{broken"}
    options = write_pages(tmp_path / "p", pages)
    target, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    with pytest.raises(StreamingQueryException):
        ingestion.collect(spark, options, target, checkpoint)
    assert ingestion.progress(spark, target).first().ultima_pagina == 2
    write_pages(tmp_path / "p", {4: [{"id": 5}]})
    done = ingestion.collect(spark, options, target, checkpoint)
    assert done == {"ultima_pagina": 6, "concluida": True, "motivo": "incompleta", "fim": 4}
    found = ingestion.records(spark, target).collect()
    assert sorted((r.id, json.loads(r.raw)["id"]) for r in found) == [(str(k), k) for k in (1, 2, 3, 4, 5)]
    assert [r.motivo for r in ingestion.taken(spark, f"{target}/failures", ingestion.FAILURES).collect()] == ["registro sem campo de id"]
    batch = spark.read.format("portal").options(**options, pages="4").load()
    assert {r.raw for r in batch.collect()} >= {r.raw for r in found}
    write_pages(tmp_path / "p", {5: [{"id": 9}]})
    assert ingestion.collect(spark, options, target, checkpoint) == done


def test_batches_run_twice_change_nothing(spark, tmp_path):
    """A batch that failed behind its writes is run again; the last probe by time counts, whatever the batch."""
    given = str(tmp_path / "g")
    rows = [[(1, 200, "disponivel", "", 5, 10), (1, 404, "indisponivel", "x", 6, 20), (2, 503, "instavel", "", 7, 30)], [(1, 200, "disponivel", "", 8, 15), (3, 403, "indisponivel", None, None, 1)]]
    for part in rows:
        spark.createDataFrame(part, "id long, status_http int, classe_saude string, motivo_saude string, latencia_ms int, t long").selectExpr(
            "id", "status_http", "classe_saude", "motivo_saude", "latencia_ms", "timestamp_seconds(t) as checado_em"
        ).coalesce(1).write.mode("append").parquet(given)
    target, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    came = spark.readStream.schema(ingestion.PROBES).option("maxFilesPerTrigger", 1).parquet(given)
    runs = []

    def fail(batch_rows, batch):
        runs.append(batch)
        if len(runs) == 2:
            raise RuntimeError("stopped")

    with pytest.raises(StreamingQueryException):
        ingestion.probe_batches(came, target, checkpoint, fail)
    ingestion.probe_batches(came, target, checkpoint, fail)
    assert runs == [0, 1, 1]
    stored = spark.range(1, 5).selectExpr("id", "cast(null as int) status_http", "'antes' classe_saude", "'m' motivo_saude", "cast(1 as int) latencia_ms", "cast(null as timestamp) checado_em")
    found = {r.id: (r.status_http, r.classe_saude, r.motivo_saude, r.latencia_ms) for r in ingestion.health_state(stored, target).collect()}
    assert found == {1: (404, "indisponivel", "x", 6), 2: (503, "instavel", None, 7), 3: (403, "indisponivel", None, None), 4: (None, "antes", "m", 1)}
    ingestion.probe_batches(came, target, checkpoint, fail)
    assert runs == [0, 1, 1]


def test_no_batches(spark, tmp_path):
    stored = spark.range(1).selectExpr("id", "1 status_http", "'a' classe_saude", "'m' motivo_saude", "1 latencia_ms", "current_timestamp() checado_em")
    assert ingestion.health_state(stored, str(tmp_path / "none")).first().classe_saude == "a"
    assert ingestion.progress(spark, str(tmp_path / "none")).first().asDict() == {"ultima_pagina": 0, "concluida": False, "motivo": None, "fim": None}


def test_idle_origins_are_given_up(spark, tmp_path):
    """State of origins whose instants no longer count goes; decisions are those of the batch."""
    hour = 3_600_000_000
    start = 1000 * hour
    asked = [(i, i % 3, start + hour * i // 2) for i in range(12)] + [(100 + i, 7, start + hour * (9 + i) // 2) for i in range(6)] + [(200, 9, start + 20 * hour)]
    table = spark.createDataFrame(asked, "event_id long, origem long, quando long")
    for k in range(0, 21, 4):
        table.where(F.floor((F.col("quando") - start) / (4 * hour)) == k // 4).coalesce(1).write.mode("append").parquet(str(tmp_path / "g"))
    came = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "g"))
    kept = {}
    for name, late in (("all", None), ("some", 60)):
        run = stream.admit(came, 2, 3600, late).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c"))
        run.trigger(availableNow=True).start().awaitTermination(300)
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).collect())) == sorted(map(tuple, limiter.sliding_window(table, 2, 3600).collect()))
        kept[name] = {r.origem for r in stream.origins_kept(spark, str(tmp_path / f"{name}-c")).collect()}
    assert kept == {"all": {0, 1, 2, 7, 9}, "some": {9}}


def test_origins_that_share_a_place(spark, tmp_path):
    """One place for all: an origin is given up when its own instants no longer count, by a timer that others move."""
    hour = 3_600_000_000
    asked = [(1, 1, 0), (2, 2, 0), (3, None, 1), (4, 1, 2), (5, 1, 2), (6, 2, 3), (7, 3, 3), (8, 1, 4), (9, None, 5)]
    table = spark.createDataFrame([(e, o, 1000 * hour + t * hour // 2) for e, o, t in asked], "event_id long, origem long, quando long")
    kept = {}
    for last in (3, 4, 5):
        folder = tmp_path / str(last)
        for t in range(last + 1):
            table.where(F.col("quando") == 1000 * hour + t * hour // 2).coalesce(1).write.mode("append").parquet(str(folder / "g"))
        came = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "g"))
        out = whole.written(stream.admit(came, 2, 3600, 60, places=1), str(folder / "g"), str(folder / "o"), str(folder / "c"))
        given = table.where(F.col("quando") <= 1000 * hour + last * hour // 2)
        assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == sorted(map(tuple, limiter.sliding_window(given.fillna(-1), 2, 3600).withColumn("origem", F.nullif("origem", F.lit(-1))).collect()), key=lambda r: r[0])
        kept[last] = {r.origem for r in stream.origins_kept(spark, str(folder / "c")).collect()}
    assert kept == {3: {1, 2, 3, None}, 4: {1, 2, 3}, 5: {1, 2, 3, None}}


@pytest.mark.parametrize(("name", "rows"), [("limiter_evicting", 1000), ("limiter_state", 14)])
def test_a_stream_is_waited_for(spark, monkeypatch, name, rows):
    """A stream that takes longer than any time it is waited for is no result yet, nor is one that ended in the middle."""
    wait, ended = StreamingQuery.awaitTermination, []

    def impatient(query, timeout=None):
        return wait(query, timeout and 0.01)

    def stopped(query, timeout=None):
        while not query.lastProgress:
            wait(query, 0.05)
        query.stop()
        ended.append(query.lastProgress["batchId"])

    monkeypatch.setattr(StreamingQuery, "awaitTermination", impatient)
    assert getattr(streams, name)(spark, "/root/testdata/sf0.001").count() == rows
    monkeypatch.setattr(StreamingQuery, "awaitTermination", stopped)
    with pytest.raises(RuntimeError, match="of 1000 rows"):
        getattr(streams, name)(spark, "/root/testdata/sf0.001")
    assert ended[0] < 5


def test_answer_cache(spark, tmp_path):
    """Hits call no model and store nothing; the oldest entry goes; versions and answers that are never reused stay apart."""
    asked = [
        (1, 1, 1, [1.0, 0.0], "modelo"),
        (1, 2, 2, [0.9, 0.1], "modelo"),  # like 1
        (1, 3, 3, [0.0, 1.0], "nao_encontrado"),
        (1, 4, 4, [0.0, 1.0], "modelo"),  # 3 was not stored
        (2, 5, 5, [1.0, 0.0], "modelo"),  # another version
        (1, 6, 6, [-1.0, 0.0], "modelo"),  # the third entry: 1 goes
        (1, 7, 7, [1.0, 0.0], "modelo"),
        (1, 8, 8, [0.0, -1.0], "modo_reduzido"),
        (1, 9, 9, [-1.0, 0.0], "modelo"),
    ]
    table = spark.createDataFrame(asked, "versao long, qid long, quando long, vetor array<double>, origem string")
    for part in (F.col("qid") <= 4, F.col("qid") > 4):
        table.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "g"))
    came = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "g"))
    run = cache.answer(came, 2, 0.5).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c"))
    run.trigger(availableNow=True).start().awaitTermination(300)
    found = {r.qid: (r.answer_id, r.chamada) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    new = (None, True)
    assert found == {1: new, 2: (1, False), 3: new, 4: new, 5: new, 6: new, 7: new, 8: new, 9: (6, False)}
