"""Personal data by form, and the words that give it away by the company they keep (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalume.llm.storage import materialize, small_or_not

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_LETTERS = r"\p{L}+"
#: Numbers whose running sums are made together.
_BLOCK = 256


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check digit fits: from the right, every second digit doubled (less 9 if over 9)."""
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + digit - F.when(digit > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


@dataclass(frozen=True)
class Kind:
    """A form of personal data: its pattern, which matches hold, a sign that a text may have one, and a match's plain form."""

    name: str
    pattern: str
    holds: Callable[[Column], Column]
    sign: str
    plain: Callable[[Column], Column]


#: Patterns match what the contract's do, in linear time: a run is entered at its start only, or where the match before ends, and is not given back.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), "@", F.lower),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), r"[0-9]\.[0-9]", lambda m: m),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda m: F.length(_digits(m)).between(16, 19) & _luhn(_digits(m)), "[0-9]", _digits),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(8, 15), r"\+[0-9]", _digits),
)


def _sums(sizes: Column) -> Column:
    """Running sums of an array of numbers, in blocks, so that no list is copied once for each of its items."""
    number = "array<bigint>"
    blocks = F.transform(
        F.when(F.size(sizes) > 0, F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda b: F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK)),
    )
    more = lambda sums, x: F.array_append(sums, F.element_at(sums, -1) + x)
    before = F.aggregate(
        F.transform(blocks, lambda s: F.aggregate(s, F.lit(0).cast("bigint"), lambda a, x: a + x)), F.array(F.lit(0)).cast(number), more
    )
    inside = F.zip_with(
        blocks, F.slice(before, 1, F.greatest(F.size(before) - 1, F.lit(0))), lambda s, at: F.slice(F.aggregate(s, F.array(at).cast(number), more), 2, F.lit(_BLOCK))
    )
    return F.flatten(inside)


def _cut(df: DataFrame, text: str, pattern: str, name: str, sign: str | None = None) -> DataFrame:
    """``df`` with the matches of ``pattern`` in ``text`` (``name_m``) and what stands before, between and behind them (``name_g``)."""
    none = F.array().cast("array<string>")
    there = F.col(text).rlike(sign) if sign else F.lit(True)
    return df.withColumns(
        {
            f"{name}_m": F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
            f"{name}_g": F.when(there, F.split(text, pattern, -1)).otherwise(F.array(text)),
        }
    )


def _located(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name_s``: (match, start, end) of each match of ``_cut``, in code points, end exclusive."""
    gaps = F.slice(f"{name}_g", F.lit(1), F.size(f"{name}_m"))
    df = df.withColumn(f"{name}_n", F.zip_with(gaps, f"{name}_m", lambda g, m: (F.length(g) + F.length(m)).cast("bigint")))
    df = df.withColumn(f"{name}_e", _sums(F.col(f"{name}_n")))
    spans = F.zip_with(f"{name}_m", f"{name}_e", lambda m, e: F.struct(m.alias("match"), (e - F.length(m)).alias("start"), e.alias("end")))
    return df.withColumn(f"{name}_s", spans).drop(f"{name}_n", f"{name}_e")


def _joined(name: str, put: Callable[[Column], Column]) -> Column:
    """The text of ``_cut`` again, with ``put(match)`` in each match's place."""
    count = F.size(f"{name}_m")
    front = F.zip_with(F.slice(f"{name}_g", F.lit(1), count), f"{name}_m", lambda g, m: F.concat(g, put(m)))
    return F.concat(F.array_join(front, ""), F.element_at(f"{name}_g", -1))


def _mentions(docs: DataFrame, reach: int) -> DataFrame:
    """(entity, around, terms) for each place where personal data stands: its plain form, a hash of the words around it, and those words.

    Around it are the ``reach`` words on either side, up to the next match of the same kind; e-mail addresses are no words.
    """
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.where(F.col("text").rlike(r"@|\+[0-9]|[0-9]\.[0-9]|[0-9](?:[\x20-]?[0-9]){15}"))
    words = lambda part: F.regexp_extract_all(part, F.lit(_LETTERS), F.lit(0))
    found = None
    for kind in KINDS:
        cut = _cut(rows, "text", kind.pattern, "k", kind.sign)
        whole = F.slice("k_g", F.lit(2), F.size("k_m"))
        each = F.arrays_zip(F.slice("k_g", F.lit(1), F.size("k_m")).alias("before"), F.col("k_m").alias("match"), whole.alias("after"))
        one = cut.select(F.explode(each).alias("at")).select("at.*").where(kind.holds(F.col("match")))
        before, after = words(F.col("before")), words(F.col("after"))
        one = one.select(F.concat(F.lit(f"{kind.name}:"), kind.plain(F.col("match"))).alias("entity"), before.alias("before"), after.alias("after"))
        last = F.slice("before", F.greatest(F.size("before") - reach + 1, F.lit(1)), F.lit(reach))
        one = one.select("entity", last.alias("before"), F.slice("after", F.lit(1), F.lit(reach)).alias("after"))
        around = F.xxhash64(F.lower(F.array_join("before", " ")), F.lower(F.array_join("after", " ")))
        one = one.select("entity", around.alias("around"), F.array_distinct(F.transform(F.concat("before", "after"), F.lower)).alias("terms"))
        found = one if found is None else found.unionByName(one)
        if kind.name == "email":
            rows = cut.select(_joined("k", lambda m: F.lit("\n")).alias("text"))
    return found


def _hidden_emails(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_rest``: the text with blanks in the place of its e-mail addresses, as long as before."""
    email = KINDS[0]
    return _cut(docs, "text", email.pattern, "_h", email.sign).withColumn("_rest", _joined("_h", lambda m: F.repeat(F.lit(" "), F.length(m)))).drop("_h_m", "_h_g")


def revealing_terms(docs: DataFrame, reach: int = 5, support: int = 3, least: float = 0.7) -> DataFrame:
    """(term, disclosure) of words that give personal data away: what the corpus lets one infer from a word about an entity near it.

    Of N words, let c(t) be a term t, C(e) stand around mentions of e, and c(e, t) be both. A term tells
    PMI = log(c(e,t) N / (c(t) C(e))) of the entity's whole information IC = log(N / C(e)); its disclosure is the largest
    share PMI / IC over the entities that it stands near in ``support`` different surroundings at least (copies of a passage are
    one). Terms at ``least`` or more are returned. All mentions and all words count.
    """
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    near = materialize(_mentions(docs, reach).select("entity", "around", F.explode("terms").alias("term")), "pii-mentions")
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("both"), F.countDistinct("around").alias("ways")).where(F.col("ways") >= support)
    about = near.groupBy("entity").agg(F.count("*").alias("about"))
    words = _hidden_emails(docs).select(F.explode(F.regexp_extract_all("_rest", F.lit(_LETTERS), F.lit(0))).alias("word"))
    counts = materialize(words.groupBy(F.lower("word").alias("term")).agg(F.count("*").alias("met")), "pii-words")
    total = counts.agg(F.sum("met").alias("total"))
    told = pairs.join(about, "entity").join(counts, "term").crossJoin(F.broadcast(total))  # one row
    known = F.log(F.greatest(F.col("met") / F.col("both"), F.lit(1.0)))
    share = F.when(F.col("total") > F.col("about"), 1 - known / F.log(F.col("total") / F.col("about"))).otherwise(0.0)
    return told.groupBy("term").agg(F.max(share).alias("disclosure")).where(F.col("disclosure") >= least)


def find_personal_data(docs: DataFrame, reach: int = 5, support: int = 3, generalise: float = 0.7, remove: float = 0.9) -> DataFrame:
    """All rows of ``docs`` with their personal data, what gives it away, and the text without either.

    Reads doc_id and text (null: empty); other columns are ignored. Returns doc_id; ``email``, ``ip``, ``card``, ``phone``
    (arrays of match, start, end: leftmost, not overlapping, in code points; matches that do not hold are left out, not
    tried again); ``term`` (the same for words, outside of e-mail addresses, whose disclosure reaches ``generalise``, see
    ``revealing_terms``); and ``clean``, in which, kind after kind, data is replaced by [EMAIL], [IP], [CARD], [PHONE], a
    term by [NAME] where it begins with a capital and [WORD] else, or by nothing where its disclosure reaches ``remove``.
    Repeated rows stay, each with its own result; null ids are ids; no documents: no rows.

    Patterns take linear time on texts of any length. Terms travel as hashes of the texts that hold them; texts move only
    if over 100,000 texts hold some.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    terms = materialize(revealing_terms(docs, reach, support, generalise), "pii-terms")
    key = [F.xxhash64(F.lit(k), "text").alias(f"_k{k}") for k in range(2)]
    words = F.array_distinct(F.regexp_extract_all("_rest", F.lit(_LETTERS), F.lit(0)))
    met = _hidden_emails(rows.select("text")).select(*key, F.explode(words).alias("word")).select("_k0", "_k1", F.lower("word").alias("term"))
    held = met.join(small_or_not(terms), "term").groupBy("_k0", "_k1").agg(
        F.collect_set("term").alias("_terms"), F.collect_set(F.when(F.col("disclosure") >= remove, F.col("term"))).alias("_gone")
    )
    held = small_or_not(materialize(held, "pii-texts-with-terms"))
    rows = rows.select("doc_id", "text", *key).join(held, ["_k0", "_k1"], "left")
    for kind in KINDS:
        rows = _located(_cut(rows, "text", kind.pattern, kind.name, kind.sign), kind.name)
        rows = rows.withColumn(kind.name, F.filter(f"{kind.name}_s", lambda s: kind.holds(s["match"])))  # noqa: B023
    rows = _hidden_emails(rows).withColumn("_rest", F.when(F.col("_terms").isNotNull(), F.col("_rest")).otherwise(""))
    rows = _located(_cut(rows, "_rest", _LETTERS, "_w"), "_w")
    rows = rows.withColumn("term", F.filter("_w_s", lambda s: F.array_contains("_terms", F.lower(s["match"]))))
    clean = rows.withColumn("clean", F.col("text"))
    for kind in KINDS:
        put = lambda m: F.when(kind.holds(m), f"[{kind.name.upper()}]").otherwise(m)  # noqa: E731, B023
        clean = _cut(clean, "clean", kind.pattern, "_c", kind.sign).withColumn("clean", _joined("_c", put))
    known = F.coalesce("_terms", F.array().cast("array<string>"))
    blank = F.when(F.col("_terms").isNull(), F.lit("^(?!)")).otherwise(rf"\[(?:EMAIL|IP|CARD|PHONE)\]|{_LETTERS}")
    clean = clean.withColumns({"_c_m": F.regexp_extract_all("clean", blank, F.lit(0)), "_c_g": F.when(F.col("_terms").isNull(), F.array("clean")).otherwise(F.split("clean", rf"\[(?:EMAIL|IP|CARD|PHONE)\]|{_LETTERS}", -1))})

    def hide(m: Column) -> Column:
        word = F.lower(m)
        shape = F.when(m.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
        return F.when(F.array_contains(known, word), F.when(F.array_contains("_gone", word), "").otherwise(shape)).otherwise(m)

    return clean.select("doc_id", *(k.name for k in KINDS), "term", _joined("_c", hide).alias("clean"))


def listed(kinds: list[str]) -> Column:
    """``kind:start:end`` of all spans of ``kinds``, by kind and start, comma-joined."""
    said = [F.transform(k, lambda s: F.concat(F.lit(f"{k}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))) for k in kinds]
    return F.array_join(F.concat(*said), ",")
