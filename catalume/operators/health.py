"""Link health: classes of responses, hosts that block, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.config import Settings
from catalume.functions import text

#: The classes, in the order of the published distribution, and what may be said of a link of each.
CLASSES = ("disponivel", "cadeia_incompleta", "indisponivel", "instavel", "bloqueado", "dominio_inexistente", "nao_verificado")
SITUATIONS = {
    "disponivel": "acessivel",
    "cadeia_incompleta": "acessivel",
    "indisponivel": "inacessivel",
    "dominio_inexistente": "inacessivel",
    "bloqueado": "nao_verificado",
    "instavel": "nao_verificado",
    "nao_verificado": "nao_verificado",
}
SITUATION_ORDER = ("acessivel", "nao_verificado", "inacessivel")
#: Certificate errors that mean an incomplete chain.
CHAIN_CODES = (2, 20, 21)


def status_class(status: Column) -> Column:
    return (
        F.when(status.between(200, 299), "disponivel")
        .when(status.isin(404, 410), "indisponivel")
        .when((status == 429) | (status >= 500), "instavel")
        .when(status.between(400, 499), "indisponivel")
        .when(status.isNotNull(), "instavel")
    )


def failure_class(error: Column, verify_code: Column) -> Column:
    """Class of a failed connection by the kind of its error."""
    return F.when(error == "gaierror", "dominio_inexistente").when(verify_code.isin(*CHAIN_CODES), "cadeia_incompleta").otherwise("instavel")


def situation(kind: Column) -> Column:
    """What an answer may say: accessible without a class, not verified for an unknown one."""
    known = F.create_map(*(F.lit(x) for pair in SITUATIONS.items() for x in pair))
    return F.when(F.coalesce(kind, F.lit("")) == "", "acessivel").otherwise(F.coalesce(F.try_element_at(known, kind), F.lit("nao_verificado")))


def blocking_hosts(resources: DataFrame, settings: Settings) -> DataFrame:
    """(host, n): hosts with enough checked links, none fine (200 to 399) and most forbidden (403)."""
    checked = resources.where("status_http is not null").select(text.host(F.col("link")).alias("host"), "status_http")
    seen = checked.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status_http").between(200, 399)).alias("ok"),
        F.count_if(F.col("status_http") == 403).alias("forbidden"),
    )
    return seen.where((F.col("n") >= settings.blocker_minimum) & (F.col("ok") == 0) & (F.col("forbidden") > settings.blocker_share * F.col("n"))).select("host", "n")


def reclassified(resources: DataFrame, settings: Settings) -> DataFrame:
    """``resources`` with every checked link of a blocking host classed ``bloqueado``."""
    hosts = blocking_hosts(resources, settings).select(F.col("host").alias("_host"), F.lit(True).alias("_blocks"))
    keyed = resources.withColumn("_of", text.host(F.col("link")))
    joined = keyed.join(hosts, keyed["_of"] == hosts["_host"], "left")
    blocked = F.coalesce("_blocks", F.lit(False)) & F.col("status_http").isNotNull()
    return joined.withColumn("classe_saude", F.when(blocked, "bloqueado").otherwise(F.col("classe_saude"))).select(*resources.columns)


def blocked_counts(resources: DataFrame, settings: Settings) -> DataFrame:
    """(host, n, place): links of each blocking host that are classed anew, most first."""
    seen = reclassified(resources, settings).where("classe_saude = 'bloqueado'").groupBy(text.host(F.col("link")).alias("host")).agg(F.count("*").alias("n"))
    return seen.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "host")).cast("long"))  # one row a blocking host


def blindness(resources: DataFrame) -> DataFrame:
    """One row: links confirmed absent, links about which nothing can be said, and the latter's share of those classed."""
    classed = resources.where("classe_saude is not null")
    seen = classed.agg(
        F.count("*").alias("verificados"),
        F.count_if(F.col("classe_saude") == "indisponivel").alias("ausentes"),
        F.count_if(F.col("classe_saude").isin("bloqueado", "nao_verificado")).alias("cegos"),
    )
    return seen.withColumn("cegueira", F.round(F.coalesce(F.try_divide(F.col("cegos").cast("double"), F.col("verificados")), F.lit(0.0)), 6))


def skipped(resources: DataFrame, selected: DataFrame, limit: int | None = None) -> DataFrame:
    """One row: how many links a selection passed over: the lesser of all and ``limit``, without those selected."""
    total = resources.agg(F.count("*").alias("total"))
    most = F.least(F.col("total"), F.lit(limit)) if limit else F.col("total")
    return total.join(selected.agg(F.count("*").alias("n"))).select((most - F.col("n")).alias("pulados"))


HEALTH = ("status_http", "classe_saude", "motivo_saude", "latencia_ms", "checado_em")


def updated(stored: DataFrame, probed: DataFrame) -> DataFrame:
    """``stored`` resources with the five health columns of ``probed`` (id, HEALTH) where they were probed; an empty reason is null."""
    new = probed.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_new_{c}") for c in HEALTH))
    new = new.withColumn("_new_motivo_saude", F.nullif("_new_motivo_saude", F.lit("")))
    there = F.col("_id").isNotNull()
    joined = stored.join(new, stored["id"] == new["_id"], "left")
    return joined.select(*(F.when(there, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in HEALTH else F.col(c) for c in stored.columns))


def unavailable(resources: DataFrame, owner: str) -> DataFrame:
    """(owner, n): links that answers call out of reach."""
    return resources.groupBy(owner).agg(F.count_if(situation(F.col("classe_saude")) == "inacessivel").alias("n"))


def class_report(resources: DataFrame, since: Column | None = None) -> DataFrame:
    """(classe, n, share) over the fixed classes, zeros filled in; links without a class, or checked before ``since``, do not count."""
    if since is not None:
        resources = resources.where(F.col("checado_em") >= since)
    seen = resources.where("classe_saude is not null").groupBy(F.col("classe_saude").alias("classe")).agg(F.count("*").alias("n"))
    every = resources.sparkSession.createDataFrame([(c,) for c in CLASSES], "classe string")
    rows = F.broadcast(every).join(seen, "classe", "right").unionByName(every.join(seen, "classe", "left_anti").withColumn("n", F.lit(0).cast("bigint")))
    total = F.sum("n").over(Window.partitionBy())
    return rows.select("classe", "n", F.round(F.coalesce(F.try_divide(F.col("n").cast("double"), total), F.lit(0.0)), 6).alias("share"))


def latency_percentiles(resources: DataFrame) -> DataFrame:
    """(n, median, p95): the upper median and the value at rank floor(0.95 n) of the known latencies.

    Latencies are whole milliseconds: they are counted by value, and ranks are
    read off the running counts, so no list of all is made.
    """
    counts = resources.where("latencia_ms is not null").groupBy("latencia_ms").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.orderBy("latencia_ms"))
    total = F.sum("k").over(Window.partitionBy())
    ranked = counts.select("latencia_ms", upto.alias("upto"), total.alias("n"))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("latencia_ms")))
    high = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))
    return ranked.agg(F.max("n").alias("n"), at(F.floor(F.col("n") / 2)).alias("median"), at(high).alias("p95"))


def select_links(resources: DataFrame, only_failures: bool = False, kind: str | None = None, unchecked_since: Column | None = None, limit: int | None = None) -> DataFrame:
    """Links to check: failures, one class, or not checked since a time, by id."""
    rows = resources
    if only_failures:
        rows = rows.where("classe_saude is not null and classe_saude <> 'disponivel'")
    if kind:
        rows = rows.where(F.col("classe_saude") == kind)
    if unchecked_since is not None:
        rows = rows.where(F.col("checado_em").isNull() | (F.col("checado_em") < unchecked_since))
    return rows.orderBy("id").limit(limit) if limit else rows


def shown_resources(resources: DataFrame, most: int = 6) -> DataFrame:
    """(conjunto_id, shown, hidden): ids by situation (accessible first) then id, and how many are left out.

    Only a dataset's first ``most`` links are ordered, by a limit that holds before rows are shuffled; the others are counted.
    """
    order = F.array_position(F.array(*map(F.lit, SITUATION_ORDER)), situation(F.col("classe_saude")))
    place = F.row_number().over(Window.partitionBy("conjunto_id").orderBy("ord", "id"))
    first = resources.select("conjunto_id", "id", order.alias("ord")).withColumn("place", place).where(F.col("place") <= most)
    shown = first.groupBy("conjunto_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda r: r["id"]).alias("shown"))
    count = resources.groupBy("conjunto_id").agg(F.count("*").alias("n"))
    joined = count.join(shown.withColumnRenamed("conjunto_id", "_of"), F.col("conjunto_id").eqNullSafe(F.col("_of")))
    return joined.select("conjunto_id", "shown", F.greatest(F.col("n") - most, F.lit(0)).alias("hidden"))


def dead_domains(resources: DataFrame, resolved: DataFrame) -> DataFrame:
    """``resources`` with failed connections to hosts that do not resolve classed ``dominio_inexistente``.

    ``resolved`` (host, exists) holds one recorded lookup per host.
    """
    gone = resolved.where("not exists").select(F.col("host").alias("_host")).distinct()
    keyed = resources.withColumn("_of", text.host(F.col("link")))
    joined = keyed.join(gone, keyed["_of"] == gone["_host"], "left")
    failed = (F.col("classe_saude") == "instavel") & (F.col("motivo_saude") == "ConnectError") & F.col("_host").isNotNull()
    kind = F.when(F.coalesce(failed, F.lit(False)), "dominio_inexistente").otherwise(F.col("classe_saude"))
    return joined.withColumn("classe_saude", kind).select(*resources.columns)
