"""Answers as text: templates, absence, context, and the check that nothing is made up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalume.functions import text

SHOWN, IN_CONTEXT = 6, 8

#: What the answers say.
DOWN = " — link fora do ar quando verificamos"
UNVERIFIED = " — não conseguimos verificar este link"
POOR = "O órgão publicou pouca descrição sobre este conjunto, então o resumo acima pode não cobrir tudo que ele contém."
ABSENCE = (
    "Não encontrei nenhum conjunto de dados que responda a essa pergunta.\n\n"
    "Isso pode significar que o dado não está publicado no Portal Brasileiro de Dados Abertos, ou que ele está lá com outro nome."
)
SUGGESTIONS = (
    "tente o nome do órgão que publica o dado, como “ANAC” ou “Ministério da Saúde”",
    "troque termos técnicos por palavras do dia a dia, como “hospital” em vez de “estabelecimento de saúde”",
    "use uma palavra a menos: buscas curtas costumam achar mais",
)
ABSENCE += "\n\nO que costuma ajudar:\n" + "\n".join(f"- {s}" for s in SUGGESTIONS)
CAPPED = (
    "Encontrei estes conjuntos para a sua pergunta. O texto explicando cada um volta amanhã — "
    "hoje o serviço já atendeu o limite de perguntas detalhadas que consegue responder por dia."
)
DISCARDED = "Não consegui montar uma resposta confiável para essa pergunta agora. Tente de novo em instantes."
NO_CATALOG = "O catálogo não está disponível agora."
CONTEXT_MARKS = {"inacessivel": "  [INDISPONÍVEL na última verificação]", "nao_verificado": "  [NÃO FOI POSSÍVEL VERIFICAR este link]"}
REDUCED = "Não consegui redigir uma resposta agora, mas encontrei estes conjuntos que podem servir:"
ORIGINS = {
    "correspondencia_direta": "encontrado direto no catálogo",
    "redigida_pelo_modelo": "resposta escrita a partir das fichas encontradas",
    "nao_encontrado": "nada encontrado no catálogo",
    "modo_reduzido": "não consegui redigir; veja os conjuntos encontrados",
}


def formats(resources: Column) -> Column:
    """Distinct upper-case formats in order of first sight."""
    known = F.filter(resources, lambda r: F.coalesce(r["formato"], F.lit("")) != "")
    return F.array_distinct(F.transform(known, lambda r: F.upper(r["formato"])))


def resource_line(r: Column) -> Column:
    name = F.coalesce(F.nullif(r["titulo"], F.lit("")), F.lit("(sem título)"))
    label = F.concat(name, F.when(F.coalesce(r["formato"], F.lit("")) != "", F.concat(F.lit(" ["), F.upper(r["formato"]), F.lit("]"))).otherwise(""))
    has_link = F.coalesce(r["link"], F.lit("")) != ""
    tail = (
        F.when(r["situacao"] == "inacessivel", F.lit(DOWN))
        .when(r["situacao"] == "nao_verificado", F.concat(F.lit(UNVERIFIED), F.when(has_link, F.concat(F.lit(": "), r["link"])).otherwise("")))
        .otherwise(F.when(has_link, F.concat(F.lit(" — "), r["link"])).otherwise(""))
    )
    return F.concat(F.lit("- "), label, tail)


def template_answer(title: Column, name: Column, summary: Column, publisher: Column, confidence: Column, resources: Column, page: Column) -> Column:
    """The answer of a direct match, from its card alone."""
    none = F.array().cast("array<string>")
    one = lambda condition, *lines: F.when(F.coalesce(condition, F.lit(False)), F.array(*lines)).otherwise(none)
    blank, given = F.lit(""), lambda c: F.coalesce(c, F.lit("")) != ""
    more = F.size(resources) - SHOWN
    files = F.transform(F.slice(resources, 1, SHOWN), resource_line)
    lines = F.concat(
        F.array(F.concat(F.lit("**"), F.coalesce(F.nullif(title, F.lit("")), name), F.lit("**")), blank),
        one(given(summary), summary, blank),
        one(given(publisher), F.concat(F.lit("Quem publica: "), F.translate(publisher, "-", " "), F.lit("."))),
        one(F.size(formats(resources)) > 0, F.concat(F.lit("Formatos disponíveis: "), F.array_join(formats(resources), ", "), F.lit("."))),
        one(confidence == "baixa", F.lit(POOR)),
        F.when(F.size(resources) > 0, F.concat(F.array(blank, F.lit("Arquivos:")), files)).otherwise(none),
        one(more > 0, F.concat(F.lit("- e mais "), more.cast("string"), F.lit(" na página do conjunto"))),
        F.array(blank, F.concat(F.lit("Página no portal: "), page)),
    )
    return F.array_join(lines, "\n")


def reduced_answers(results: DataFrame) -> DataFrame:
    """(qid, answer): what was found, listed, for when no model can write; rows: qid, posicao, titulo, page."""
    line = F.concat(F.lit("- **"), F.col("titulo"), F.lit("** — "), F.col("page"))
    listed = results.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("posicao", line.alias("line")))).alias("lines"))
    return listed.select("qid", F.concat(F.lit(REDUCED + "\n\n"), F.array_join(F.transform("lines", lambda r: r["line"]), "\n")).alias("answer"))


def capped_answers(questions: DataFrame, results: DataFrame) -> DataFrame:
    """(qid, answer): what was found, card by card, for when the day's cap is used up; nothing found: the absence.

    Rows: qid, posicao, titulo, nome, organizacao, resumo, formatos (array), page.
    """
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    parts = F.concat_ws(
        "\n",
        F.concat(F.lit("**"), F.coalesce(F.nullif("titulo", F.lit("")), "nome"), F.lit("**")),
        F.when(given(F.col("organizacao")), F.concat(F.lit("Publicado por "), F.translate("organizacao", "-", " "), F.lit("."))),
        F.when(given(F.col("resumo")), F.col("resumo")),
        F.when(F.size("formatos") > 0, F.concat(F.lit("Formatos: "), F.array_join("formatos", ", "), F.lit("."))),
        F.col("page"),
    )
    listed = results.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("posicao", parts.alias("part")))).alias("cards"))
    said = F.concat(F.lit(CAPPED + "\n\n"), F.array_join(F.transform("cards", lambda c: F.concat(c["part"], F.lit("\n"))), "\n"))
    return questions.select("qid").distinct().join(listed, "qid", "left").select("qid", F.coalesce(said, F.lit(ABSENCE)).alias("answer"))


def assemble(routed: DataFrame, ready: DataFrame, generated: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(qid, origem, answer, called): what each question is answered with.

    ``routed`` (qid, rota, reduzido): absence and template answers come first
    and ignore the cap; a question under the cap gets the capped answer;
    else the model's answer if there is one and ``verdicts`` (qid, approved)
    lets it pass, the listing if the model gave none, and a fixed text if it
    was discarded. ``ready`` (qid, template, capped, reduced) are the answers
    without a model, ``generated`` (qid, answer) the model's. ``called`` says
    whether the question consumed the model.
    """
    said = generated.select("qid", F.col("answer").alias("_said"))
    rows = routed.join(ready, "qid", "left").join(said, "qid", "left").join(verdicts.select("qid", "approved"), "qid", "left")
    rows = rows.withColumn("_model", (F.col("rota") == "MODELO") & ~F.coalesce("reduzido", F.lit(False)))
    fine = F.coalesce("approved", F.lit(False))
    origin = (
        F.when(F.col("rota") == "AUSENCIA", "nao_encontrado")
        .when(F.col("rota") == "TEMPLATE", "correspondencia_direta")
        .when(F.col("_model") & F.col("_said").isNotNull() & fine, "redigida_pelo_modelo")
        .otherwise("modo_reduzido")
    )
    answer = (
        F.when(F.col("rota") == "AUSENCIA", ABSENCE)
        .when(F.col("rota") == "TEMPLATE", F.col("template"))
        .when(~F.col("_model"), F.col("capped"))
        .when(F.col("_said").isNull(), F.col("reduced"))
        .when(fine, F.col("_said"))
        .otherwise(DISCARDED)
    )
    return rows.select("qid", origin.alias("origem"), answer.alias("answer"), (F.col("_model") & F.col("_said").isNotNull()).alias("called"))


def log_lines(answers: DataFrame) -> DataFrame:
    """(value): a JSON line for each answer (pergunta, origem, fichas, latencia_ms, motivo); discarded ones (texto) in full."""
    whole = F.to_json(F.struct(F.lit("resposta").alias("evento"), "pergunta", "origem", "fichas", "latencia_ms", "motivo"), {"ignoreNullFields": "false"})
    gone = F.to_json(F.struct(F.lit("resposta_descartada").alias("evento"), "pergunta", "motivo", "texto"), {"ignoreNullFields": "false"})
    return answers.select(F.when(F.col("texto").isNotNull(), gone).otherwise(whole).alias("value"))


def guard(answers: DataFrame, allowed: DataFrame, names: DataFrame) -> DataFrame:
    """(aid, approved, made_up_urls, made_up_names) of answers (aid, answer).

    ``allowed`` (aid, url) are the links an answer's cards hold, ``names``
    (aid, name) their names; any other link or cited dataset is made up.
    """
    slug = r"(?i)dados\.gov\.br/dados/conjuntos-dados/([A-Za-z0-9_\-]+)"
    cited = answers.select(
        "aid", text.urls_in(F.col("answer")).alias("urls"), F.array_distinct(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(slug), F.lit(1))).alias("slugs")
    )
    fine = allowed.groupBy("aid").agg(F.collect_set(text.same_url(F.col("url"))).alias("fine"))
    known = names.groupBy("aid").agg(F.collect_set(F.lower("name")).alias("known"))
    none = F.array().cast("array<string>")
    rows = cited.join(fine, "aid", "left").join(known, "aid", "left")
    rows = rows.withColumn("fine", F.coalesce("fine", none)).withColumn("known", F.coalesce("known", none))
    rows = rows.withColumn("made_up_urls", F.filter("urls", lambda u: ~F.array_contains("fine", text.same_url(u))))
    rows = rows.withColumn("made_up_names", F.filter("slugs", lambda s: ~F.array_contains("known", F.lower(s))))
    return rows.select("aid", ((F.size("made_up_urls") == 0) & (F.size("made_up_names") == 0)).alias("approved"), "made_up_urls", "made_up_names")


def context_resource(r: Column) -> Column:
    marks = F.create_map(*(F.lit(x) for pair in CONTEXT_MARKS.items() for x in pair))
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.concat(
        F.lit("    - "),
        F.coalesce(F.nullif(r["titulo"], F.lit("")), F.lit("(sem título)")),
        F.when(given(r["formato"]), F.concat(F.lit(" ("), F.upper(r["formato"]), F.lit(")"))).otherwise(""),
        F.when(given(r["link"]), F.concat(F.lit(" — "), r["link"])).otherwise(""),
        F.coalesce(F.try_element_at(marks, F.coalesce(r["situacao"], F.lit(""))), F.lit("")),
    )


def model_entry(question: Column, blocks: Column) -> Column:
    """What a model gets: the question and the context blocks (array) of its cards."""
    many = F.size(blocks).cast("string")
    return F.concat(F.lit("Pergunta da pessoa:\n"), question, F.lit("\n\nFichas recuperadas ("), many, F.lit("):\n\n"), F.array_join(blocks, "\n\n"))


def context_block(
    title: Column, name: Column, publisher: Column, confidence: Column, page: Column, summary: Column, questions: Column | None = None, resources: Column | None = None
) -> Column:
    """What a model may know of one dataset; of its resources IN_CONTEXT are named, with marks on those not known to be in reach."""
    none = F.array().cast("array<string>")
    asked = F.coalesce(questions, none) if questions is not None else none
    lines = F.transform(F.slice(resources, 1, IN_CONTEXT), context_resource) if resources is not None else none
    count = F.size(resources) if resources is not None else F.lit(0)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("### "), F.coalesce(F.nullif(title, F.lit("")), name)),
        F.concat(F.lit("identificador: "), name),
        F.concat(F.lit("órgão: "), F.translate(F.coalesce(publisher, F.lit("")), "-", " ")),
        F.concat(F.lit("confiança da ficha: "), confidence),
        F.concat(F.lit("página no portal: "), page),
        F.concat(F.lit("resumo: "), summary),
        F.when(confidence == "baixa", "ATENÇÃO: metadados pobres. Não afirme conteúdo além do resumo."),
        F.when(F.size(asked) > 0, F.concat(F.lit("perguntas que este conjunto ajuda a responder:\n"), F.array_join(F.transform(asked, lambda q: F.concat(F.lit("    - "), q)), "\n"))),
        F.when(count > 0, F.concat(F.lit("arquivos ("), count.cast("string"), F.lit("):\n"), F.array_join(lines, "\n"))),
    )


def origin_label(origin: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for pair in ORIGINS.items() for x in pair))
    return F.coalesce(F.try_element_at(labels, F.coalesce(origin, F.lit(""))), F.lit(""))


def answer_events(answers: DataFrame) -> DataFrame:
    """(aid, seq, evento, dados): an answer's event stream: start, pieces of 24 characters, end; a null answer: an error alone."""
    pieces = F.transform(text.fragments(F.col("answer")), lambda p: F.struct(F.lit("fragmento").alias("evento"), p.alias("dados")))
    event = lambda name: F.array(F.struct(F.lit(name).alias("evento"), F.lit("").alias("dados")))
    failed = F.array(F.struct(F.lit("erro").alias("evento"), F.lit(NO_CATALOG).alias("dados")))
    whole = F.when(F.col("answer").isNull(), failed).otherwise(F.concat(event("inicio"), pieces, event("fim")))
    flat = answers.select("aid", F.posexplode(whole).alias("seq", "e"))
    return flat.select("aid", F.col("seq").cast("long").alias("seq"), "e.evento", "e.dados")


def parse_chunks(chunks: DataFrame) -> DataFrame:
    """``parse_events`` of streams that come in byte chunks (sid, seq, chunk binary), cut anywhere, even inside a character."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.hex("chunk").alias("h")))), lambda c: c["h"])
    whole = chunks.groupBy("sid").agg(F.array_join(ordered, "").alias("h"))
    return parse_events(whole.select("sid", F.decode(F.unhex("h"), "utf-8").alias("body")))


def parse_events(streams: DataFrame) -> DataFrame:
    """(sid, seq, evento, dados) of byte streams put together as text (sid, body); frames without valid JSON data go."""
    frames = streams.select("sid", F.posexplode(F.split("body", r"\r?\n\r?\n")).alias("at", "frame"))
    lines = F.split("frame", r"\r?\n")
    named = F.transform(F.filter(lines, lambda x: x.startswith("event:")), lambda x: text.strip(F.substring(x, F.lit(7), F.length(x))))
    data = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: text.strip(F.substring(x, F.lit(6), F.length(x))))
    read = frames.select("sid", "at", F.coalesce(F.get(named, F.size(named) - 1), F.lit("message")).alias("evento"), F.array_join(data, "\n").alias("dados"))
    return read.where(F.try_parse_json("dados").isNotNull() & (F.col("dados") != "")).select("sid", F.col("at").cast("long").alias("seq"), "evento", "dados")
