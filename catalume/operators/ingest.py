"""Raw catalog records: typed rows, quarantine, upserts and removals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from catalume.functions import text

#: Characters of a rejected line that are kept.
KEPT = 2000


def parsed(lines: DataFrame) -> DataFrame:
    """(linha, raw, v): each non-blank line with its JSON value, null where it is none."""
    return lines.where(text.strip(F.col("raw")) != "").withColumn("v", F.try_parse_json("raw"))


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def field(record: Column, name: str) -> Column:
    """A field of a record; what its ``detalhe`` object holds wins, even a null."""
    return F.coalesce(F.try_variant_get(record, f"$.detalhe.{name}", "variant"), F.try_variant_get(record, f"$.{name}", "variant"))


def _text(value: Column) -> Column:
    """A value's text if it is a JSON string with some, else null."""
    return F.when(_kind(value) == "STRING", text.blank_to_null(F.try_variant_get(value, "$", "string")))


def _whole(value: Column) -> Column:
    return F.when(_kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))


def text_field(record: Column, name: str) -> Column:
    return _text(field(record, name))


def id_field(record: Column) -> Column:
    """The identifier as text; numbers but zero count."""
    value = field(record, "id")
    number = _kind(value).startswith("DECIMAL") | _kind(value).isin("BIGINT", "DOUBLE")
    said = text.blank_to_null(F.try_variant_get(value, "$", "string"))
    return F.when(_kind(value) == "STRING", said).when(number & (F.try_variant_get(value, "$", "double") != 0), said)


#: Keys under which a listed record may name itself, in order.
ID_KEYS = ("id", "_id", "identificador", "idConjuntoDados", "name")


def extract_id(record: Column) -> Column:
    """The first text or whole number that is not blank under ID_KEYS, as text."""
    values = (F.try_variant_get(record, f"$.{key}", "variant") for key in ID_KEYS)
    return F.coalesce(*(F.when(_kind(v).isin("STRING", "BIGINT"), text.blank_to_null(F.try_variant_get(v, "$", "string"))) for v in values))


def whole_number(record: Column, name: str) -> Column:
    return _whole(field(record, name))


def list_field(record: Column, name: str) -> Column:
    """A field's list as JSON text, ``[]`` where it is none."""
    value = field(record, name)
    return F.when(_kind(value).startswith("ARRAY"), F.to_json(value)).otherwise("[]")


def truth(record: Column, name: str) -> Column:
    """Whether a field is set to anything but null, false, zero or an empty text, list or object."""
    value = field(record, name)
    shown = F.to_json(value)
    return ~(value.isNull() | F.coalesce(shown.isin("null", "false", "0", "0.0", '""', "[]", "{}"), F.lit(True)))


def _resources(record: Column) -> Column:
    """The objects among a record's ``recursos``."""
    listed = F.try_variant_get(field(record, "recursos"), "$", "array<variant>")
    return F.filter(listed, lambda r: _kind(r).startswith("OBJECT"))


def bad_resource(record: Column) -> Column:
    """Whether some resource of the record has no text with something in it as its identifier; a number is none."""
    return F.coalesce(F.exists(_resources(record), lambda r: _text(F.try_variant_get(r, "$.id", "variant")).isNull()), F.lit(False))


def rejection(value: Column) -> Column:
    """Why a record is rejected, null if it is not."""
    return (
        F.when(value.isNull(), "JSON inválido")
        .when(~_kind(value).startswith("OBJECT"), "registro não é um objeto")
        .when(id_field(value).isNull(), "identificador ausente")
        .when(bad_resource(value), "recurso sem identificador")
    )


def split_quarantine(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted lines (linha, v) and rejected ones (linha, motivo, registro)."""
    judged = parsed(lines).withColumn("motivo", rejection(F.col("v")))
    good = judged.where("motivo is null").select("linha", "v")
    return good, judged.where("motivo is not null").select("linha", "motivo", F.substring("raw", 1, KEPT).alias("registro"))


def rejection_rate(lines: DataFrame, limit: float) -> DataFrame:
    """One row: lines read and rejected, their share (0 when none is read), whether it is above ``limit``."""
    return _rate(parsed(lines).agg(F.count("*").alias("lidos"), F.count_if(rejection(F.col("v")).isNotNull()).alias("rejeitados")), limit)


def _rate(seen: DataFrame, limit: float) -> DataFrame:
    share = F.round(F.coalesce(F.try_divide(F.col("rejeitados").cast("double"), F.col("lidos")), F.lit(0.0)), 6)
    return seen.withColumn("taxa", share).withColumn("acima", F.col("taxa") > limit)


def report(lines: DataFrame, limit: float) -> DataFrame:
    """One row of an ingestion's counts, by line and not by identifier: lidos, conjuntos, recursos, rejeitados, taxa, acima."""
    judged = parsed(lines).select((rejection(F.col("v")).isNull()).alias("fine"), F.coalesce(F.size(_resources(F.col("v"))), F.lit(0)).alias("n"))
    seen = judged.agg(
        F.count("*").alias("lidos"),
        F.count_if("fine").alias("conjuntos"),
        F.coalesce(F.sum(F.when(F.col("fine") & (F.col("n") > 0), F.col("n"))), F.lit(0)).alias("recursos"),
        F.count_if(~F.col("fine")).alias("rejeitados"),
    )
    return _rate(seen, limit)


#: The text fields of a raw record.
_TEXTS = (
    "nome titulo title descricao organizacao nomeOrganizacao periodicidade granularidadeEspacial valorCoberturaEspacial coberturaEspacial "
    "coberturaTemporalInicio coberturaTemporalFim dataCatalogacao catalogacao dataUltimaAtualizacaoMetadados ultimaAlteracaoMetadados "
    "dataUltimaAtualizacaoArquivo ultimaAtualizacaoDados"
).split()


def datasets(accepted: DataFrame) -> DataFrame:
    """Typed dataset rows of accepted lines; of two names of a field the second counts where the first gives nothing."""
    first = lambda *names: F.coalesce(*(F.col(n) for n in names))
    moment = lambda *names: F.coalesce(*(text.utc_timestamp(F.col(n)) for n in names))
    # one projection finds the values, the next reads them, so that each is looked for once
    found = accepted.select("linha", "v", *(field(F.col("v"), n).alias(n) for n in _TEXTS), F.try_variant_get("v", "$.coletado_em", "variant").alias("coletado_em"))
    read = found.select(
        "linha",
        id_field(F.col("v")).alias("id"),
        truth(F.col("v"), "descontinuado").alias("descontinuado"),
        list_field(F.col("v"), "temas").alias("temas"),
        list_field(F.col("v"), "tags").alias("tags"),
        *(_text(F.col(n)).alias(n) for n in (*_TEXTS, "coletado_em")),
    )
    return read.select(
        "linha",
        "id",
        "nome",
        first("titulo", "title").alias("titulo"),
        "descricao",
        first("organizacao", "nomeOrganizacao").alias("organizacao"),
        "periodicidade",
        F.col("granularidadeEspacial").alias("granularidade_espacial"),
        first("valorCoberturaEspacial", "coberturaEspacial").alias("cobertura_espacial"),
        moment("coberturaTemporalInicio").alias("cobertura_temporal_inicio"),
        moment("coberturaTemporalFim").alias("cobertura_temporal_fim"),
        "temas",
        "tags",
        "descontinuado",
        moment("dataCatalogacao", "catalogacao").alias("catalogado_em"),
        moment("dataUltimaAtualizacaoMetadados", "ultimaAlteracaoMetadados").alias("metadados_atualizados_em"),
        moment("dataUltimaAtualizacaoArquivo", "ultimaAtualizacaoDados").alias("dados_atualizados_em"),
        "coletado_em",
        text.dataset_page(F.col("nome"), F.col("id")).alias("url_portal"),
    )


def resources(accepted: DataFrame) -> DataFrame:
    """Typed resource rows of accepted lines; a value of another type than its column's is null."""
    flat = accepted.select("linha", id_field(F.col("v")).alias("conjunto_id"), F.explode(_resources(F.col("v"))).alias("r"))
    value = lambda name: F.try_variant_get("r", f"$.{name}", "variant")
    return flat.select(
        "linha",
        _text(value("id")).alias("id"),
        "conjunto_id",
        _text(value("titulo")).alias("titulo"),
        _text(value("descricao")).alias("descricao"),
        text.file_format(_text(value("formato"))).alias("formato"),
        _text(value("link")).alias("link"),
        _whole(value("tamanho")).alias("tamanho"),
        text.utc_timestamp(_text(value("dataCatalogacao"))).alias("catalogado_em"),
        text.utc_timestamp(_text(value("dataUltimaAtualizacaoArquivo"))).alias("arquivo_atualizado_em"),
    )


def upsert(target: DataFrame, source: DataFrame, key: str, order: str) -> DataFrame:
    """``target`` with the rows of ``source``: the last row by ``order`` of each key wins, source rows over target's.

    Columns of the target that the source lacks (such as health) survive.
    """
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))) == 1
    new = source.withColumn("_last", last).where("_last").drop("_last", order)
    kept = [c for c in target.columns if c not in new.columns]
    old = target.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_old_{c}") for c in target.columns if c != key))
    joined = new.join(old, new[key] == old["_key"], "full_outer")
    there = F.col(key).isNotNull()
    columns = [
        F.coalesce(key, "_key").alias(c) if c == key else F.col(f"_old_{c}").alias(c) if c in kept else F.when(there, F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c)
        for c in target.columns
    ]
    return joined.select(*columns)


def remove_vanished(stored: DataFrame, latest: DataFrame, seen: DataFrame) -> DataFrame:
    """``stored`` resources without those that their dataset's latest record (ids in ``seen``) no longer has."""
    checked = stored.join(seen.select("conjunto_id").distinct(), "conjunto_id", "left_semi")
    gone = checked.join(latest.select("conjunto_id", "id"), ["conjunto_id", "id"], "left_anti")
    return stored.join(gone.select("conjunto_id", "id"), ["conjunto_id", "id"], "left_anti")


def unseen(page: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``page`` whose key is not stored yet, each once."""
    return page.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def store(lines: DataFrame, stored_datasets: DataFrame, stored_resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Datasets and resources after an ingestion of ``lines``.

    Accepted records are upserted, the last line of an identifier wins;
    resources that the latest record of their dataset lacks go, those of
    datasets that do not occur stay.
    """
    good, _ = split_quarantine(lines)
    made = datasets(good)
    last = made.withColumn("_last", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("linha")))).where("_last = 1")
    found = resources(good).join(last.select("linha"), "linha", "left_semi")
    after = upsert(stored_resources, found, "id", "linha")
    return upsert(stored_datasets, made, "id", "linha"), remove_vanished(after, found, last.select(F.col("id").alias("conjunto_id")))


def stored_ids(lines: DataFrame) -> DataFrame:
    """The identifiers of stored records (raw), each once; lines that cannot be read are passed over."""
    return parsed(lines).select(extract_id(F.col("v")).alias("id")).where("id is not null").distinct()


def listing_end(pages: DataFrame) -> DataFrame:
    """One row: where a listing (pagina, n; n null for a page that failed) ended and why.

    It ends complete behind two confirmed empty pages or with a page shorter
    than the longest before it; a failed page stops it without being its end;
    one empty page among others is passed over. Pages are few; rows a page.
    """
    by = Window.orderBy("pagina")
    rows = pages.withColumn("longest", F.max("n").over(by)).withColumn("after", F.lead("n").over(by))
    why = (
        F.when(F.col("n").isNull(), "falha")
        .when((F.col("n") == 0) & (F.col("after") == 0), "vazia")
        .when((F.col("n") > 0) & (F.col("n") < F.col("longest")), "incompleta")
    )
    ended = rows.withColumn("motivo", why).where("motivo is not null").agg(F.min(F.struct("pagina", "motivo")).alias("fim"), F.max("longest").alias("_"))
    longest = pages.agg(F.max("n").alias("maior_pagina"))
    return ended.join(longest).select("fim.pagina", "fim.motivo", (F.col("fim.motivo") != "falha").alias("concluida"), "maior_pagina")


#: Statuses that pass, and those that do not.
AGAIN, NEVER = (403, 405, 408, 425, 429), (400, 404, 410)


def retry_kind(status: Column, is_json: Column) -> Column:
    """``ok``, ``repetir`` or ``desistir``: unknown errors and answers that are not JSON are asked for again."""
    return (
        F.when(status.isNull(), "repetir")
        .when(status.isin(*AGAIN) | (status >= 500), "repetir")
        .when(status.isin(*NEVER), "desistir")
        .when(status >= 400, "repetir")
        .when(~F.coalesce(is_json, F.lit(False)), "repetir")
        .otherwise("ok")
    )


class TooManyRejected(ValueError):
    """More of an ingestion's lines were rejected than is allowed; what it stored stays."""


def ingest(lines: DataFrame, target: str, limit: float, strict: bool = True) -> dict:
    """Store ``lines`` (linha, raw) under ``target``, good records and quarantine apart, and report on them: one pass over the lines.

    The counts of ``report`` are observed on the rows as they are written, so nothing is read or judged twice. Records go to
    ``registros`` (linha, v as JSON text), rejected lines to ``quarentena`` (linha, motivo, registro), both in one table by
    ``destino``. With ``strict`` a share of rejected lines above ``limit`` raises ``TooManyRejected``, behind the commit:
    good records count even then.
    """
    seen = Observation("ingestion")
    judged = parsed(lines).withColumn("motivo", rejection(F.col("v"))).withColumn("n", F.coalesce(F.size(_resources(F.col("v"))), F.lit(0)))
    fine = F.col("motivo").isNull()
    told = judged.observe(
        seen,
        F.count(F.lit(1)).alias("lidos"),
        F.count_if(fine).alias("conjuntos"),
        F.coalesce(F.sum(F.when(fine & (F.col("n") > 0), F.col("n"))), F.lit(0)).alias("recursos"),
        F.count_if(~fine).alias("rejeitados"),
    )
    rows = told.select(
        "linha", "motivo", F.when(fine, F.to_json("v")).otherwise(F.substring("raw", 1, KEPT)).alias("registro"), F.when(fine, "registros").otherwise("quarentena").alias("destino")
    )
    rows.write.mode("overwrite").partitionBy("destino").parquet(target)
    counts = seen.get
    counts["taxa"] = round(counts["rejeitados"] / counts["lidos"], 6) if counts["lidos"] else 0.0
    counts["acima"] = counts["taxa"] > limit
    if strict and counts["acima"]:
        raise TooManyRejected(f"{counts['rejeitados']} of {counts['lidos']} lines rejected, more than {limit:.1%}")
    return counts


def ingested(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """Accepted records (linha, v) and rejected lines (linha, motivo, registro) that ``ingest`` stored."""
    stored = spark.read.schema("linha bigint, motivo string, registro string, destino string").parquet(target)
    good = stored.where("destino = 'registros'").select("linha", F.try_parse_json("registro").alias("v"))
    return good, stored.where("destino = 'quarentena'").select("linha", "motivo", "registro")
