"""Registered queries over streams of the given tables: each is stopped in the middle and started again, or gives up state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.operators import health
from catalume.plans import catalog
from catalume.plans.catalog import table
from catalume.plans.queries import _LIMITER, SETTINGS, query
from catalume.sources import kept
from catalume.streaming import ingestion
from catalume.streaming import limiter as stream
from catalume.streaming.whole import written

PAGE = 40


def interrupted(run: Callable[[ingestion.Batch | None], object], at: int) -> object:
    """``run`` with a failure behind the writes of batch ``at``, before Spark knows of them; then again, as after a crash."""

    def fail(rows: DataFrame, batch: int) -> None:
        if batch == at:
            raise RuntimeError("stopped")

    try:
        run(fail)
    except StreamingQueryException:
        pass
    return run(None)


def _listing(spark: SparkSession, sf_dir: str) -> str:
    """The documents as recorded pages of 40 records; a page's first record stands on the next one too, some have no id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 97 > 0, F.col("doc_id")).alias("id"), F.col("n_chars").alias("tamanho"))
    pages = docs.withColumn("pagina", (F.col("doc_id") / PAGE).cast("int") + 1)
    again = pages.where((F.col("doc_id") % PAGE == 0) & (F.col("doc_id") + PAGE <= F.lit(docs.agg(F.max("doc_id")).first()[0]))).withColumn("pagina", F.col("pagina") + 1)
    listed = pages.unionByName(again).groupBy("pagina").agg(F.sort_array(F.collect_list(F.struct("doc_id", "id", "tamanho"))).alias("r"))
    said = F.to_json(F.struct(F.transform("r", lambda r: F.struct(r["id"].alias("id"), r["tamanho"].alias("tamanho"))).alias("dados")))
    folder = kept.new_path(spark, "listing")
    listed.select("pagina", said.alias("value")).repartition("pagina").write.partitionBy("pagina").text(folder)
    return folder


def _collected(spark: SparkSession, sf_dir: str) -> str:
    """Where the listing's records were put by a run that failed in its second batch and one that went on."""
    options = {"url": _listing(spark, sf_dir) + "/pagina={page}", "pause": "0", "asks": "2", "step": "4", "most": "4096"}
    target, checkpoint = kept.new_path(spark, "collected"), kept.new_path(spark, "collecting")
    interrupted(lambda then: ingestion.collect(spark, options, target, checkpoint, then), 1)
    return target


@query("SELECT CAST(doc_id AS VARCHAR) AS id, n_chars AS tamanho, 1 AS vezes FROM documents WHERE doc_id % 97 > 0", model=False)
def ingestion_stream(spark, sf_dir):
    """A portal's pages as a stream, stopped between a batch's writes and its commit, and taken up again: each record once."""
    found = ingestion.records(spark, _collected(spark, sf_dir))
    rows = found.select("id", F.get_json_object("raw", "$.tamanho").cast("bigint").alias("tamanho"))
    return rows.groupBy("id", "tamanho").agg(F.count("*").alias("vezes"))


@query(
    f"""WITH p AS (SELECT doc_id // {PAGE} + 1 AS pagina, count(*) + CASE WHEN min(doc_id) > 0 THEN 1 ELSE 0 END AS n FROM documents GROUP BY 1),
    s AS (SELECT max(pagina) AS last, max(n) AS most, arg_max(n, pagina) AS final FROM p)
    SELECT CASE WHEN final < most THEN last ELSE last + 1 END AS fim, CASE WHEN final < most THEN 'incompleta' ELSE 'vazia' END AS motivo, true AS concluida,
    (SELECT count(*) + count(*) FILTER (WHERE doc_id % {PAGE} = 0 AND doc_id + {PAGE} <= (SELECT max(doc_id) FROM documents)) FROM documents WHERE doc_id % 97 = 0) AS falhas FROM s""",
    model=False,
)
def ingestion_progress(spark, sf_dir):
    """How far the stopped and resumed run came, and the records that it could not store."""
    target = _collected(spark, sf_dir)
    lost = ingestion.taken(spark, f"{target}/failures", ingestion.FAILURES).agg(F.count("*").alias("falhas"))
    return ingestion.progress(spark, target).join(lost).select(F.col("fim").cast("bigint").alias("fim"), "motivo", "concluida", "falhas")


_PROBED = """sondas AS (SELECT event_id % 40 AS id, CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 404 WHEN 'error' THEN 503 ELSE 403 END AS status_http, ts AS checado_em,
    CASE event_type WHEN 'view' THEN 'disponivel' WHEN 'error' THEN 'instavel' ELSE 'indisponivel' END AS classe_saude, CAST(event_id % 1000 AS INT) AS latencia_ms FROM events),
final AS (SELECT id, max(struct_pack(checado_em := checado_em, status_http := status_http, classe_saude := classe_saude, motivo := '', latencia_ms := latencia_ms)) AS h FROM sondas GROUP BY id),
agora AS (SELECT r.id, r.link, r.host, coalesce(h.status_http, r.status_http) AS status_http, CASE WHEN h IS NULL THEN r.classe_saude ELSE h.classe_saude END AS classe_saude,
    CASE WHEN h IS NULL THEN r.latencia_ms ELSE h.latencia_ms END AS latencia_ms, h.checado_em FROM classificado r LEFT JOIN final f ON f.id = r.id)"""


def _probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links after their probes came in four files, a batch each; the run failed behind the writes of the second."""
    e = F.col("event_type")
    status = F.when(e == "view", 200).when(e == "click", 404).when(e == "error", 503).otherwise(403)
    kind = F.when(e == "view", "disponivel").when(e == "error", "instavel").otherwise("indisponivel")
    probes = table(spark, sf_dir, "events").select(
        (F.col("event_id") % 40).cast("bigint").alias("id"), status.alias("status_http"), kind.alias("classe_saude"), F.lit("").alias("motivo_saude"), (F.col("event_id") % 1000).cast("int").alias("latencia_ms"), F.col("ts").cast("timestamp").alias("checado_em")
    )
    given, target, checkpoint = (kept.new_path(spark, name) for name in ("probes", "health", "probing"))
    probes.repartition(4).write.parquet(given)
    came = spark.readStream.schema(ingestion.PROBES).option("maxFilesPerTrigger", 1).parquet(given)
    interrupted(lambda then: ingestion.probe_batches(came, target, checkpoint, then), 1)
    stored = catalog.links(spark, sf_dir).withColumn("motivo_saude", F.lit(None).cast("string")).withColumn("checado_em", F.lit(None).cast("timestamp"))
    return ingestion.health_state(stored, target)


@query(f"WITH {_PROBED} SELECT id, status_http, classe_saude, CAST(latencia_ms AS BIGINT) AS latencia_ms, strftime(checado_em, '%Y-%m-%d %H:%M:%S') AS checado FROM agora")
def health_batches(spark, sf_dir):
    """Probes stored in batches with commit, of which one is run twice."""
    rows = _probed(spark, sf_dir)
    return rows.select("id", "status_http", "classe_saude", F.col("latencia_ms").cast("bigint").alias("latencia_ms"), F.date_format("checado_em", "yyyy-MM-dd HH:mm:ss").alias("checado"))


@query(
    f"""WITH {_PROBED}, b AS (SELECT host FROM agora WHERE status_http IS NOT NULL AND host <> '' GROUP BY host HAVING count(*) >= {SETTINGS.blocker_minimum}
        AND count(*) FILTER (WHERE status_http BETWEEN 200 AND 399) = 0 AND count(*) FILTER (WHERE status_http = 403) > {SETTINGS.blocker_share} * count(*))
    SELECT classe, count(*) AS n FROM (SELECT CASE WHEN host IN (FROM b) AND status_http IS NOT NULL THEN 'bloqueado' ELSE classe_saude END AS classe FROM agora) WHERE classe IS NOT NULL GROUP BY classe"""
)
def health_second_pass(spark, sf_dir):
    """Classes behind the last batch, when hosts that block can be told."""
    seen = health.class_report(health.reclassified(_probed(spark, sf_dir), SETTINGS))
    return seen.where("n > 0").select("classe", "n")


def _admitted(spark: SparkSession, sf_dir: str, late: int | None) -> tuple[DataFrame, str]:
    """The limiter's decisions, and where its state is, after requests that came in six files by time."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    given, out, state = (kept.new_path(spark, name) for name in ("requests", "admitted", "state"))
    asked = catalog.requests(spark, sf_dir)
    low, high = asked.agg(F.min("quando"), F.max("quando")).first()
    part = F.least(F.floor((F.col("quando") - low) * 6 / (high - low + 1)), F.lit(5))
    for k in range(6):
        asked.where(part == k).coalesce(1).write.mode("append").parquet(given)
    came = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(given)
    return written(stream.admit(came, 3, 86_400, late), given, out, state), state


@query(f"{_LIMITER} SELECT event_id, user_id AS origem, wait_s = 0 AS allowed, wait_s FROM s", model=False)
def limiter_evicting(spark, sf_dir):
    """The limiter over requests by time, state given up behind the window: decisions as if all were kept."""
    return _admitted(spark, sf_dir, 3600)[0]


@query(
    f"""{_LIMITER}, w AS (SELECT max(quando) - 3600000000 AS mark FROM (SELECT epoch_us(ts) AS quando FROM events)),
    k AS (SELECT s.user_id, max(epoch_us(ts)) AS last FROM s JOIN events e ON e.event_id = s.event_id WHERE wait_s = 0 GROUP BY 1)
    SELECT user_id AS origem FROM k, w WHERE (last + 86400000000) // 1000 + 1 > mark // 1000""",
    model=False,
)
def limiter_state(spark, sf_dir):
    """The origins that state is still kept for when the stream has ended; without eviction it would be all."""
    return stream.origins_kept(spark, _admitted(spark, sf_dir, 3600)[1])


_CACHE = """WITH RECURSIVE q AS (SELECT vec_id, label % 3 AS v, label % 5 = 0 AS odd, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label % 3 ORDER BY vec_id) AS rn FROM embeddings),
s AS (SELECT v, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(id BIGINT, e DOUBLE[])[]) AS held, CAST(NULL AS BIGINT) AS qid, CAST(NULL AS STRUCT(l DOUBLE, id BIGINT)) AS best FROM (SELECT DISTINCT v FROM q)
UNION ALL SELECT v, rn, CASE WHEN best IS NOT NULL OR odd THEN held ELSE list_append(held, struct_pack(id := vec_id, e := e))[-20:] END, vec_id, best FROM (
    SELECT q.v, q.rn, q.vec_id, q.odd, q.e, s.held, list_max(list_filter(list_transform(s.held, lambda x: struct_pack(l := round(list_inner_product(x.e, q.e), 6), id := -x.id)), lambda x: x.l > 0.3)) AS best
    FROM s JOIN q ON q.v = s.v AND q.rn = s.rn + 1))"""


@query(f"{_CACHE} SELECT CAST(v AS BIGINT) AS versao, qid, -best.id AS answer_id, best.l AS likeness, best IS NULL AS chamada FROM s WHERE qid IS NOT NULL", model=False)
def answer_cache_stream(spark, sf_dir):
    """Questions answered from a cache of 20 entries a catalog version; the oldest go, hits call no model."""
    from catalume.streaming import cache

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    given, out, state = (kept.new_path(spark, name) for name in ("asked", "answered", "cache"))
    rows = table(spark, sf_dir, "embeddings").select(
        (F.col("label") % 3).cast("bigint").alias("versao"), F.col("vec_id").cast("bigint").alias("qid"), F.col("vec_id").cast("bigint").alias("quando"), F.col("embedding").cast("array<double>").alias("vetor"),
        F.when(F.col("label") % 5 == 0, "modo_reduzido").otherwise("modelo").alias("origem"),
    )
    half = rows.agg(F.max("qid")).first()[0] // 2
    for part in (F.col("qid") <= half, F.col("qid") > half):
        rows.where(part).coalesce(1).write.mode("append").parquet(given)
    came = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(given)
    return written(cache.answer(came, 20, 0.3), given, out, state)
