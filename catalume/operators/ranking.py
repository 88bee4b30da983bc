"""Fusion of rankings, routing of answers, evaluation of retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalume.config import Settings
from catalume.functions import text
from catalume.operators import postings, sinks
from catalume.sources.kept import keep


def fuse(rankings: DataFrame, k: int, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of rows (qid, ranking, id, posicao, score).

    Returns qid, id, rrf = sum of 1 / (k + posicao), posicao (ties by id),
    origens (array of ranking, posicao, score by ranking).
    """
    entry = F.struct("ranking", "posicao", "score")
    fused = rankings.groupBy("qid", "id").agg(
        F.round(F.sum(1.0 / (F.lit(k) + F.col("posicao"))), 9).alias("rrf"), F.array_sort(F.collect_list(entry)).alias("origens")
    )
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rrf"), "id")).cast("long")
    fused = fused.withColumn("posicao", place)
    return fused.where(F.col("posicao") <= limit) if limit else fused


def hybrid(rankings: dict[str, Callable[[], DataFrame]], settings: Settings, on_error: Callable[[str, Exception], None], limit: int | None = None) -> DataFrame | None:
    """Fuse what can be ranked: each ranking is computed and kept on its own, one that fails is reported and left out.

    Each gives max(depth, limit) candidates; the cut to ``limit`` comes after the fusion.
    """
    kept, limit = [], limit or settings.limit
    for name, make in rankings.items():
        try:
            ranked = make().where(F.col("posicao") <= max(settings.depth, limit)).select("qid", F.lit(name).alias("ranking"), "id", "posicao", "score")
            kept.append(keep(ranked, f"ranking-{name}"))
        except Exception as error:  # noqa: BLE001  a ranking may fail in any way; the others still answer
            on_error(name, error)
    if not kept:
        return None
    union = kept[0]
    for other in kept[1:]:
        union = union.unionByName(other)
    return fuse(union, settings.rrf_k, limit)


def score_of(origins: Column, ranking: str) -> Column:
    """The score that a ranking gave, null if it did not name the row."""
    return F.get(F.transform(F.filter(origins, lambda o: o["ranking"] == ranking), lambda o: o["score"]), F.lit(0))


def is_relevant(origins: Column, settings: Settings, plain: Column | None = None) -> Column:
    """Named by two rankings, or by the lexical one with a sufficient score; similarity alone does not count.

    Where no ranking is recorded the row's ``plain`` score is the lexical one.
    """
    lexical = F.coalesce(score_of(origins, "lexica"), F.lit(0.0))
    if plain is not None:
        lexical = F.when(F.size(origins) == 0, F.coalesce(plain, F.lit(0.0))).otherwise(lexical)
    return (F.size(origins) >= 2) | (lexical >= settings.relevant_score)


def route(questions: DataFrame, fused: DataFrame, settings: Settings) -> DataFrame:
    """(qid, rota, relevant): how each question is answered.

    AUSENCIA without a relevant row; MODELO if the first one is not relevant,
    its lexical score is low or its lead over the second relevant one is
    small (0 without a second); else TEMPLATE.
    """
    rows = fused.select(
        "qid",
        "posicao",
        is_relevant(F.col("origens"), settings).alias("relevant"),
        F.coalesce(score_of(F.col("origens"), "lexica"), F.lit(0.0)).alias("lexical"),
    )
    seen = rows.groupBy("qid").agg(
        F.count_if("relevant").alias("relevant"),
        F.max(F.when(F.col("posicao") == 1, F.col("relevant"))).alias("first_fits"),
        F.max(F.when(F.col("posicao") == 1, F.col("lexical"))).alias("first"),
        F.array_sort(F.collect_list(F.when(F.col("relevant"), F.struct("posicao", "lexical")))).alias("fit"),
    ).withColumn("second", F.get("fit", F.lit(1))["lexical"])
    joined = questions.select("qid").distinct().join(seen, "qid", "left")
    rota = (
        F.when(F.coalesce("relevant", F.lit(0)) == 0, "AUSENCIA")
        .when(~F.col("first_fits") | (F.col("first") < settings.template_score), "MODELO")
        .when(F.col("first") - F.coalesce("second", F.lit(0.0)) < settings.template_margin, "MODELO")
        .otherwise("TEMPLATE")
    )
    return joined.select("qid", rota.alias("rota"), F.coalesce("relevant", F.lit(0)).cast("long").alias("relevant"))


def first_hits(questions: DataFrame, results: DataFrame) -> DataFrame:
    """(qid, tema, dificuldade, posicao): the place of the first acceptable result, null for none; see ``ranked_hits``."""
    return ranked_hits(questions, results.withColumn("ranking", F.lit("")), [""]).select("qid", "tema", "dificuldade", "posicao")


def ranked_hits(questions: DataFrame, rankings: DataFrame, names: list[str]) -> DataFrame:
    """(ranking, qid, tema, dificuldade, posicao, esperado, primeiros) of each question in each ranking of ``names``.

    ``questions`` (qid, tema, dificuldade, aceitaveis), ``rankings`` (ranking, qid, name, posicao). ``posicao`` is the place
    of the first acceptable result, null for none. A question without acceptable rows asks for absence: place 1 if nothing
    came back. ``esperado`` are the acceptable names, ``primeiros`` the first five results.
    """
    rankings = rankings.select("ranking", "qid", "name", "posicao")
    wanted = questions.select("qid", F.explode("aceitaveis").alias("name"), F.lit(True).alias("fits"))
    came = rankings.join(wanted, ["qid", "name"], "left").groupBy("ranking", "qid").agg(
        F.min(F.when(F.col("fits"), F.col("posicao"))).alias("hit"),
        F.count("*").alias("came"),
        F.array_sort(F.collect_list(F.when(F.col("posicao") <= 5, F.struct("posicao", "name")))).alias("first"),
    )
    asked = questions.select("qid", "tema", "dificuldade", "aceitaveis", F.explode(F.array(*map(F.lit, names))).alias("ranking"))
    rows = asked.join(came, ["ranking", "qid"], "left")
    absent = F.when(F.coalesce("came", F.lit(0)) == 0, 1)
    return rows.select(
        "ranking",
        "qid",
        "tema",
        "dificuldade",
        F.when(F.size("aceitaveis") == 0, absent).otherwise(F.col("hit")).cast("long").alias("posicao"),
        F.array_sort("aceitaveis").alias("esperado"),
        F.coalesce(F.transform("first", lambda r: r["name"]), F.array().cast("array<string>")).alias("primeiros"),
    )


def failures(hits: DataFrame, within: int = 5) -> DataFrame:
    """(ranking, qid, esperado, primeiros): questions without an acceptable result among the first ``within``."""
    return hits.where(F.col("posicao").isNull() | (F.col("posicao") > within)).select("ranking", "qid", "esperado", "primeiros")


def acceptable(questions: DataFrame, documents: DataFrame, index=None) -> DataFrame:
    """(qid, doc): the documents (doc, text) that hold a question's (qid, whole) text.

    A document that holds the text holds its words, so it is looked up by the
    text's rarest inner word (or, of one or two words, any of them, which then
    must stand whole) and only such documents are searched. With an ``index``
    of the documents, which has the text as one of its columns, frequencies
    and documents of words are read from it; else texts are cut anew.
    """
    words = questions.select("qid", "whole", text.tokens(F.col("whole")).alias("t"))
    inner = words.select("qid", "whole", F.explode(F.array_distinct(F.when(F.size("t") > 2, F.slice("t", 2, F.size("t") - 2)).otherwise(F.col("t")))).alias("term"))
    asked = inner.select("term").distinct()
    if index is None:
        held = documents.select("doc", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term")).join(asked, "term")
        counts = held.groupBy("term").agg(F.count("*").alias("n"))
    else:
        index.require(asked)
        counts = index.posted.select("term", "n").join(asked, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    known = inner.join(counts, "term", "left").groupBy("qid").agg(F.first("whole").alias("whole"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("key"))
    known = known.where("key.n > 0").select("qid", "whole", F.col("key.term").alias("term"))
    if index is not None:
        known = keep(known, "keys")
        held = postings.counted(index.posted.join(known.select("term").distinct(), "term", "left_semi")).select("term", "doc").distinct()
    near = held.join(known, "term").select("qid", "doc")
    if index is not None:
        near = keep(near, "near")  # few rows, which are counted so: no text is shuffled for them
    return near.join(documents.select("doc", "text"), "doc").join(known.select("qid", "whole"), "qid").where(F.contains("text", F.col("whole"))).select("qid", "doc")


def _metrics() -> list[Column]:
    within = lambda k: F.round(F.avg((F.coalesce("posicao", F.lit(k + 1)) <= k).cast("double")), 4)
    return [
        F.count("*").alias("total"),
        within(5).alias("recall_5"),
        within(10).alias("recall_10"),
        F.round(F.avg(F.coalesce(1.0 / F.col("posicao"), F.lit(0.0))), 4).alias("mrr"),
    ]


def metrics(hits: DataFrame) -> DataFrame:
    """Recall at 5 and 10 and mean reciprocal rank over all questions; zeros for none."""
    return hits.agg(*_metrics()).na.fill(0.0)


def metrics_by_segment(hits: DataFrame) -> DataFrame:
    """The same over all, by theme and by difficulty in one pass (grouping sets)."""
    sides = hits.select("posicao", F.explode(F.array(*(F.struct(F.lit(s).alias("segmento"), F.col(c).alias("valor")) for s, c in (("tema", "tema"), ("dificuldade", "dificuldade"))), F.struct(F.lit("geral").alias("segmento"), F.lit("").alias("valor")))).alias("s"))
    return sides.groupBy(F.col("s.segmento").alias("segmento"), F.col("s.valor").alias("valor")).agg(*_metrics())


def metrics_by_ranking(hits: DataFrame) -> DataFrame:
    """(ranking, segmento, valor, total, recall_5, recall_10, mrr) of each ranking over all, by theme and by difficulty: one pass over grouping sets."""
    sets = hits.groupingSets([["ranking"], ["ranking", "tema"], ["ranking", "dificuldade"]], "ranking", "tema", "dificuldade")
    by = lambda name: F.grouping(name) == 0
    named = sets.agg(F.when(by("tema"), "tema").when(by("dificuldade"), "dificuldade").otherwise("geral").alias("segmento"), *_metrics())
    return named.select("ranking", "segmento", F.when(F.col("segmento") == "tema", F.col("tema")).when(F.col("segmento") == "dificuldade", F.col("dificuldade")).otherwise("").alias("valor"), "total", "recall_5", "recall_10", "mrr")


RUN = "run_no bigint, recuperacao string, recall_5 double, recall_10 double, mrr double, total bigint"


def history(spark: SparkSession, path: str) -> DataFrame:
    """The recorded runs; lines that are none are passed over, runs without kind are lexical."""
    try:
        rows = spark.read.schema(RUN).option("mode", "PERMISSIVE").json(path)
    except AnalysisException:
        rows = spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in map(str.split, RUN.split(", "))))  # no task in Python
    return rows.where("recall_5 is not null").withColumn("recuperacao", F.coalesce("recuperacao", F.lit("lexica")))


def record(measured: DataFrame, questions: DataFrame, cards: DataFrame, path: str) -> int:
    """Append a run's metrics over all (see ``metrics_by_ranking``), a line a ranking, behind what is recorded; returns its number.

    Refused while questions (aceitaveis) name cards (name) that are not there: what is measured then is the annotation.
    """
    broken = [r.name for r in broken_annotations(questions, cards).orderBy("name").limit(20).collect()]
    if broken:
        raise ValueError(f"acceptable names without a card: {', '.join(broken)}")
    number = (history(measured.sparkSession, path).agg(F.max("run_no")).first()[0] or 0) + 1
    rows = measured.where("segmento = 'geral'").select(F.lit(number).cast("bigint").alias("run_no"), F.col("ranking").alias("recuperacao"), "recall_5", "recall_10", "mrr", "total")
    sinks.append_json(rows, path)
    return number


def last_runs(spark: SparkSession, path: str) -> DataFrame:
    """Each kind's last recorded run against the one before it; see ``regression``."""
    seen = regression(history(spark, path))
    last = seen.groupBy("kind").agg(F.max("run_no").alias("run_no"))
    return seen.join(last, ["kind", "run_no"])


def regression(history: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Each run (run_no, recuperacao, recall_5) against the one before of its kind; a run without kind is lexical."""
    kind = F.coalesce("recuperacao", F.lit("lexica"))
    before = F.lag("recall_5").over(Window.partitionBy("kind").orderBy("run_no"))
    rows = history.withColumn("kind", kind).withColumn("before", before)
    return rows.select("run_no", "kind", "recall_5", "before", F.coalesce(F.round(F.col("before") - F.col("recall_5"), 6) > tolerance, F.lit(False)).alias("regressed"))


def broken_annotations(questions: DataFrame, cards: DataFrame) -> DataFrame:
    """Acceptable names that no card has, sorted."""
    cited = questions.select(F.explode("aceitaveis").alias("name")).distinct()
    there = cards.select("name").join(cited, "name", "left_semi").distinct()  # so that few names do not have all cards dealt out
    return cited.join(there, "name", "left_anti")
