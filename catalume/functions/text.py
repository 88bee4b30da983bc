"""Text functions of the catalog, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _fold_tables() -> tuple[str, str]:
    source, target = [], []
    for point in range(0xC0, 0x250):
        letter = chr(point)
        bare = "".join(c for c in unicodedata.normalize("NFD", letter.lower()) if not unicodedata.combining(c))
        if bare != letter and len(bare) == 1:
            source.append(letter)
            target.append(bare)
    return "".join(source), "".join(target)


_ACCENTED, _BARE = _fold_tables()

#: Theme keys and their labels.
THEMES = {
    "saude": "Saúde",
    "educacao": "Educação",
    "seguranca": "Segurança pública",
    "justica": "Justiça e direitos",
    "assistencia-social": "Assistência social",
    "trabalho": "Trabalho e emprego",
    "economia": "Economia e finanças públicas",
    "agricultura": "Agricultura e pecuária",
    "meio-ambiente": "Meio ambiente e clima",
    "energia": "Energia",
    "transporte": "Transporte e mobilidade",
    "habitacao": "Habitação e saneamento",
    "cultura": "Cultura, esporte e lazer",
    "ciencia-tecnologia": "Ciência, tecnologia e inovação",
    "governo": "Governo e administração pública",
    "demografia": "População e território",
}

#: Fixed value: the portal's page of a dataset.
PORTAL_PAGE = "https://dados.gov.br/dados/conjuntos-dados/"


def strip(text: Column) -> Column:
    """Without white space (Unicode's) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def fold(text: Column) -> Column:
    """Lower case without accents: composed Latin letters by table, combining marks dropped."""
    return F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _BARE), r"\p{M}", "")


def question_terms(question: Column) -> Column:
    """The distinct words of a question as written, in order; case and accents still tell words apart."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))


def tokens(text: Column) -> Column:
    """The index's tokens: folded runs of letters and digits."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def first_tokens(text: Column, most: int) -> Column:
    """The first ``most`` of ``tokens``; of a long text only its beginning is folded, a token further than needed."""
    begun = F.regexp_extract(F.coalesce(text, F.lit("")), r"^(?:[^\p{L}\p{N}]*[\p{L}\p{N}][\p{L}\p{N}\p{M}]*){0,%d}" % (most + 1), 0)
    return F.slice(tokens(begun), 1, most)


@cache
def fold_table(spark: SparkSession) -> np.ndarray:
    """What ``fold`` makes of each code point, as Spark says: the code point of a letter or digit, -1 if nothing, else 0.

    Each by itself; by its neighbours only the lower case of one letter changes, the Greek capital sigma.
    """
    named = "id < 55296 or id between 57344 and 212991 or id between 917504 and 921599"  # beyond these no letters, digits or marks
    named = f"({named}) and id <> 65279"  # no letter either; a decoder takes it for a mark of byte order
    points = spark.range(0x110000, numPartitions=8).where(named).select(F.col("id").cast("int").alias("id"), F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("own"))
    folded = points.select("id", fold(F.col("own")).alias("f")).where(r"f rlike '^[\\p{L}\\p{N}]?\\z'")
    found = folded.select("id", F.when(F.col("f") == "", -1).otherwise(F.conv(F.hex(F.encode("f", "UTF-32")), 16, 10).cast("int")).alias("code")).toArrow()
    table = np.zeros(0x110000, np.int32)
    table[found.column("id").to_numpy()] = found.column("code").to_numpy()
    return table


def utc_timestamp(value: Column) -> Column:
    """Day/month/year with or without time, else ISO 8601; naive times are UTC, anything else is null."""
    text = blank_to_null(value)
    day = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"), text)
    forms = [F.try_to_timestamp(day, F.lit(f)) for f in ("d/M/yyyy H:m:s", "d/M/yyyy H:m", "d/M/yyyy")]
    return F.coalesce(*forms, F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text)))


def file_format(value: Column) -> Column:
    """Upper case, without white space and dots at the ends; blank: null."""
    return F.nullif(F.upper(strip(F.regexp_replace(strip(value), r"^\.+|\.+$", ""))), F.lit(""))


def dataset_page(name: Column, dataset_id: Column) -> Column:
    return F.concat(F.lit(PORTAL_PAGE), F.coalesce(blank_to_null(name), dataset_id))


def title_text(name: Column, title: Column) -> Column:
    """Title and the name's words, blanks skipped."""
    return F.concat_ws(" ", blank_to_null(title), blank_to_null(F.translate(name, "-", " ")))


def publisher_text(publisher: Column) -> Column:
    return strip(F.translate(F.coalesce(publisher, F.lit("")), "-", " "))


def known_themes(keys: Column) -> Column:
    """The vocabulary's keys among ``keys``, lower-cased, once each, in order."""
    vocabulary = F.array(*map(F.lit, THEMES))
    clean = F.transform(keys, lambda k: F.lower(strip(k)))
    return F.array_distinct(F.filter(clean, lambda k: F.array_contains(vocabulary, k)))


def theme_labels(keys: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for pair in THEMES.items() for x in pair))
    return F.filter(F.transform(keys, lambda k: F.try_element_at(labels, k)), lambda label: label.isNotNull())


def tag_names(tags: Column) -> Column:
    """Names of tags given as an array of structs (name, nome), blanks dropped."""
    names = F.transform(tags, lambda t: strip(F.coalesce(t["name"], t["nome"])))
    return F.filter(names, lambda n: n.isNotNull() & (n != ""))


def host(link: Column) -> Column:
    """The lower-cased authority of a link, port and user included; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(strip(link), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def url_usable(link: Column) -> Column:
    """http or https with an authority free of blanks, tabs and backslashes."""
    return F.coalesce(link, F.lit("")).rlike(r"^(?i:https?)://[^/?#\s\\]+(?:[/?#]|$)")


def file_name(link: Column) -> Column:
    """The last part of the link's path, percent-decoded, if it has a dot; else empty."""
    path = F.regexp_extract(F.coalesce(link, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    raw = F.substring_index(path, "/", -1)
    base = strip(F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw))
    base = F.substring_index(base, "/", -1)
    return F.when(base.contains("."), base).otherwise(F.lit(""))


def comparable(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def describe_resource(title: Column, link: Column) -> Column:
    """The title, with the file's name behind it unless the title says it already; either one alone if the other lacks."""
    name, file = strip(F.coalesce(title, F.lit(""))), file_name(link)
    root = comparable(F.regexp_replace(file, r"\.[^.]*$", ""))
    said = (root != "") & F.contains(comparable(name), root)
    return F.when(file == "", name).when(name == "", file).when(said, name).otherwise(F.concat(name, F.lit(" ("), file, F.lit(")")))


def sample_ends(items: Column, most: int = 20) -> Column:
    """Sorted; of more than ``most`` the first and last halves with a line that counts the rest."""
    ordered, half = F.array_sort(items), most // 2
    hidden = F.concat(F.lit("[…] e mais "), (F.size(items) - 2 * half).cast("string"), F.lit(" entre estes e os seguintes"))
    ends = F.concat(F.slice(ordered, 1, half), F.array(hidden), F.slice(ordered, F.greatest(F.size(items) - half + 1, F.lit(1)), half))
    return F.when(F.size(items) <= most, ordered).otherwise(ends)


def identifiers(cell: Column) -> Column:
    """Identifiers listed in a cell by comma or semicolon, quotes stripped, blanks and ``nenhum`` dropped."""
    parts = F.split(F.translate(F.coalesce(cell, F.lit("")), ",", ";"), ";")
    clean = F.transform(parts, lambda p: strip(F.regexp_replace(strip(p), "^[\"']+|[\"']+$", "")))
    return F.filter(clean, lambda p: (p != "") & (F.lower(p) != "nenhum"))


def urls_in(text: Column) -> Column:
    """The distinct http links of a text, closing punctuation cut off."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"((?i:https?)://[^\s<>)\]\"']+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))


def same_url(url: Column) -> Column:
    """A link without what does not change its target."""
    return F.lower(F.regexp_replace(strip(url), "/+$", ""))


def fragments(text: Column, size: int = 24) -> Column:
    """A text's consecutive pieces of ``size`` characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    pieces = F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))
    return F.filter(pieces, lambda p: p != "")


def json_texts(cell: Column) -> Column:
    """The items of a JSON list as texts, stripped, blanks dropped; anything else: none."""
    items = F.try_variant_get(F.try_parse_json(cell), "$", "array<variant>")
    said = F.transform(items, lambda v: strip(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))))
    return F.coalesce(F.filter(said, lambda x: x != ""), F.array().cast("array<string>"))


def json_tag_names(cell: Column) -> Column:
    """Names of a JSON list of tags, each a text or an object with ``name`` or ``nome``; blanks and anything else go."""
    items = F.try_variant_get(F.try_parse_json(cell), "$", "array<variant>")

    def text_of(v: Column) -> Column:
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))

    def named(v: Column) -> Column:
        first, second = (F.try_variant_get(v, f"$.{key}", "variant") for key in ("name", "nome"))
        return F.coalesce(text_of(v), F.nullif(text_of(first), F.lit("")), text_of(second))

    names = F.transform(items, lambda v: strip(named(v)))
    return F.coalesce(F.filter(names, lambda n: n.isNotNull() & (n != "")), F.array().cast("array<string>"))


def theme_list() -> str:
    """The vocabulary as a list for a prompt, a theme a line."""
    return "\n".join(f"- {key}: {label}" for key, label in THEMES.items())


def masked(text: Column, secrets: list[str]) -> Column:
    """A text with every known secret replaced."""
    for secret in sorted(filter(None, secrets), key=len, reverse=True):
        text = F.replace(text, F.lit(secret), F.lit("***"))
    return text


def askable(question: Column, most: int = 500) -> Column:
    """Whether a question has something in it and at most ``most`` characters."""
    return F.coalesce(blank_to_null(question).isNotNull() & (F.length(question) <= most), F.lit(False))


def publisher_name(publisher: Column, default: str = "órgão não informado") -> Column:
    return F.coalesce(F.nullif(publisher_text(publisher), F.lit("")), F.lit(default))
