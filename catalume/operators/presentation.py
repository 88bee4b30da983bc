"""What a reader sees: safe HTML, dates with what they are dates of, final payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalume.functions import text

#: What stands for each character that HTML would read.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def answer_html(answer: Column) -> Column:
    """Paragraphs, line breaks, bold and italic of a text, everything else escaped; blank: empty."""
    safe = text.strip(F.coalesce(answer, F.lit("")))
    for plain, written in ESCAPES:
        safe = F.replace(safe, F.lit(plain), F.lit(written))

    def line(one: Column) -> Column:
        bold = F.regexp_replace(one, r"\*\*(\S(?:[^*]*\S)?)\*\*", "<strong>$1</strong>")
        return F.regexp_replace(bold, r"\*(\S(?:[^*]*\S)?)\*", "<em>$1</em>")

    blocks = F.transform(F.split(safe, r"\n\s*\n"), lambda b: F.array_join(F.transform(F.split(b, "\n"), line), "<br>"))
    shown = F.transform(F.filter(blocks, lambda b: b != ""), lambda b: F.concat(F.lit("<p>"), b, F.lit("</p>")))
    return F.array_join(shown, "")


def update_label(data: Column, metadata: Column) -> Column:
    """(quando, rotulo, incerta): the data's date, else the record's, marked uncertain, else none."""
    said = lambda when, label, unsure: F.struct(when.alias("quando"), F.lit(label).alias("rotulo"), F.lit(unsure).alias("incerta"))
    data, metadata = text.utc_timestamp(data), text.utc_timestamp(metadata)
    return (
        F.when(data.isNotNull(), said(data, "dados atualizados em", False))
        .when(metadata.isNotNull(), said(metadata, "registro editado em", True))
        .otherwise(said(F.lit(None).cast("timestamp"), "data de atualização", True))
    )


def final_payload(cards: DataFrame) -> DataFrame:
    """(qid, payload): the answer's cards as JSON by place; absent dates stay as keys.

    Rows: qid, posicao, nome, titulo, orgao, url_portal, pontuacao, dados_atualizados_em, metadados_atualizados_em.
    """
    fields = ("nome", "titulo", "orgao", "url_portal", "pontuacao", "dados_atualizados_em", "metadados_atualizados_em")
    shown = cards.withColumn("pontuacao", F.round("pontuacao", 3))
    listed = shown.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("posicao", F.struct(*fields).alias("card")))).alias("cards"))
    return listed.select("qid", F.to_json(F.transform("cards", lambda c: c["card"]), {"ignoreNullFields": "false"}).alias("payload"))


def wait_minutes(seconds: Column) -> Column:
    """Whole minutes to wait, one at least."""
    return F.greatest(F.lit(1), F.ceil(seconds / 60)).cast("long")


def origin_address(header: Column, socket: Column) -> Column:
    """Whom a request counts for: the trusted header, else the socket, else unknown."""
    return F.coalesce(text.blank_to_null(header), socket, F.lit("desconhecido"))
