"""Document fingerprints from closed syncmers of words (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.llm.storage import materialize

#: Characters of a word at most; a longer run without blanks counts as its single characters.
WORD = 24
#: A text of fewer words has its word pairs as a second kind of codes.
SHORT = 128


def _with_shifted(values: Column, shift: int, join: Callable[[Column, Column], Column]) -> Column:
    """Each value joined with the one ``shift`` places on; the last ones, which have none, go."""
    left = F.greatest(F.size(values) - shift, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), left), F.slice(values, F.lit(1 + shift), left), join)


def with_anchors(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``name``: ``runs``, an array of (pos, code) of the closed syncmers of column ``text`` in order, and ``pairs``.

    The text is read as words (runs without white space; of a run over WORD
    characters, as in scripts without blanks, each character is one); a run of
    8 words is an anchor if the smallest hash of its 7 inner word pairs is
    that of its first or its last pair. The choice looks at nothing outside
    the run, so a passage has the same anchors in any document. Runs of 8
    words say little of a text of few words: a text of fewer than SHORT has,
    besides, the codes of all its pairs of neighbouring words (``pairs``; of a
    single word its own; null in longer texts). Only a text without words has
    neither.

    Minima and codes of runs are built by doubling: two runs side by side
    make a longer one. Every step is its own projection, as its array is read
    more than once.
    """
    kept = df.columns
    col = {x: f"_{name}_{x}" for x in ("word", "pair", "four", "min2", "min4", "least", "code", "runs")}
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"(?<!\S)\S{{1,{WORD}}}(?!\S)|\S"), F.lit(0))
    hashed = lambda a, b: F.xxhash64(a, b)
    smaller = lambda a, b: F.least(a, b)
    df = df.withColumn(col["word"], F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn(col["pair"], _with_shifted(F.col(col["word"]), 1, hashed))
    df = df.withColumn(col["four"], _with_shifted(F.col(col["pair"]), 2, hashed))
    df = df.withColumn(col["code"], _with_shifted(F.col(col["four"]), 4, hashed))
    df = df.withColumn(col["min2"], _with_shifted(F.col(col["pair"]), 1, smaller))
    df = df.withColumn(col["min4"], _with_shifted(F.col(col["min2"]), 2, smaller))
    df = df.withColumn(col["least"], _with_shifted(F.col(col["min4"]), 3, smaller))
    least, pair, code, word = (F.col(col[x]) for x in ("least", "pair", "code", "word"))
    edge = lambda i: (F.get(least, i) == F.get(pair, i)) | (F.get(least, i) == F.get(pair, i + 6))
    places = F.filter(F.sequence(F.lit(0), F.size(code) - 1), edge)
    anchor = lambda pos, code: F.struct(pos.alias("pos"), code.alias("code"))
    runs = F.transform(places, lambda i: anchor(i + 1, F.get(code, i)))
    none = F.array().cast("array<struct<pos:int,code:bigint>>")
    df = df.withColumn(col["runs"], F.when(F.size(code) > 0, runs).otherwise(none))
    pairs = F.when(F.size(word) < SHORT, F.when(F.size(word) == 1, word).otherwise(pair))
    return df.withColumn(name, F.struct(F.col(col["runs"]).alias("runs"), pairs.alias("pairs"))).select(*kept, name)


def codes(anchors: Column) -> Column:
    """(runs, pairs) in 32-bit codes: a run's is the upper half of its own, mixed with its distance from the one before; a pair's is its upper half."""
    runs = anchors["runs"]
    gap = lambda a, i: F.when(i > 0, a["pos"] - F.get(runs, i - 1)["pos"]).otherwise(0).cast("bigint")
    own = F.transform(runs, lambda a, i: F.shiftright(a["code"].bitwiseXOR(F.shiftleft(gap(a, i), 32)), 32).cast("int"))
    return F.struct(own.alias("runs"), F.transform(anchors["pairs"], lambda c: F.shiftright(c, 32).cast("int")).alias("pairs"))


def fingerprint(codes: Column) -> Column:
    """The codes in order, eight hex digits each: which anchors a text has and how far they stand apart; a short text's pairs behind a dot."""
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.lpad(F.lower(F.hex(x.cast("bigint").bitwiseAND(0xFFFFFFFF))), 8, "0")), "")
    return F.concat(shown(codes["runs"]), F.when(F.size(codes["pairs"]) > 0, F.concat(F.lit("."), shown(codes["pairs"]))).otherwise(""))


def likeness(a: Column, b: Column) -> Column:
    """Shared codes over the mean number of codes of both (Dice): 1 for equal sets, 1 for two empty ones.

    Two short texts are held against each other by their pairs, else both by their runs, which every text has in the same
    way: a text that an edit makes short, or long, keeps the codes by which it is compared. As codes of runs hold
    distances, a run counts only if it stands at the same distance from the one before it.
    """

    def dice(x: Column, y: Column) -> Column:
        both = F.size(F.array_distinct(x)) + F.size(F.array_distinct(y))
        return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / both)

    short = a["pairs"].isNotNull() & b["pairs"].isNotNull()
    return F.when(short, dice(a["pairs"], b["pairs"])).otherwise(dice(a["runs"], b["runs"]))


def followers(ids: DataFrame) -> DataFrame:
    """For each row of ``ids`` (doc_id, key, mark, n_chars): the row whose next document, by descending doc_id, it is.

    Returns key, mark, prev_key, prev_mark, prev_chars; the largest doc_id
    follows the smallest, a null one is smaller than all, rows of one doc_id
    stand in the order of their keys. Ids are dealt out by range and written;
    neighbours are found inside the ranges and, at their edges, between one
    row per range.
    """
    ranged = ids.repartitionByRange("doc_id", "key", "mark").select("*", F.spark_partition_id().alias("range_no"))
    ranged = materialize(ranged, "doc-ranges")
    order = ["doc_id", "key", "mark"]
    row = F.struct("key", "mark", "n_chars")
    edge = ranged.groupBy("range_no").agg(F.min(F.struct(*order, "n_chars")).alias("first"))
    over = Window.orderBy("range_no")  # one row per range
    edge = edge.select(
        "range_no",
        F.coalesce(F.lead("first").over(over), F.first("first").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("first"),
    ).select("range_no", F.struct("first.key", "first.mark", "first.n_chars").alias("beyond"))
    above = F.lead(row).over(Window.partitionBy("range_no").orderBy(*order))
    found = ranged.withColumn("above", above).join(F.broadcast(edge), "range_no")
    found = found.withColumn("above", F.coalesce("above", "beyond"))
    return found.select("key", "mark", F.col("above.key").alias("prev_key"), F.col("above.mark").alias("prev_mark"), F.col("above.n_chars").alias("prev_chars"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, a row per row of ``docs`` (doc_id, text).

    The edited text has its last floor(n/2) code points replaced by as many
    first ones (or all) of the next document, by descending doc_id, after the
    last the first. A null text is empty. Rows with the same doc_id and text
    are one document, which has a row for each; of one doc_id on several
    texts each text is a document, in the order of their hashes; null ids
    come last. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, next_id. An empty table gives an empty
    result; other columns are ignored.

    Anchors of the whole texts are made once, where the texts are read. Texts
    and their codes are shuffled once by key; of the next document only as
    many characters as the edit takes and its codes follow.
    """
    key = ["key", "mark"]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("key", F.xxhash64("doc_id", "text")).withColumn("mark", F.hash("doc_id", "text"))
    ids = texts.groupBy(*key).agg(F.min("doc_id").alias("doc_id"), F.min(F.length("text").cast("long")).alias("n_chars"), F.count("*").alias("rows"))
    ids = materialize(ids, "documents")
    repeated = not ids.where("rows > 1").isEmpty()
    ahead = materialize(followers(ids.drop("rows")), "followers")
    # read twice with the same columns, so that its shuffle, with the anchors in front of it, is made once
    whole = with_anchors(texts, "text", "anchors").select("doc_id", "text", *key, codes(F.col("anchors")).alias("codes"))
    lent = whole.join(ahead, key).select(
        F.col("prev_key").alias("key"),
        F.col("prev_mark").alias("mark"),
        F.expr("left(text, cast(prev_chars div 2 as int))").alias("lent"),
        F.col("codes").alias("next_codes"),
        F.col("doc_id").alias("next_id"),
    )
    edited = whole.join(lent.dropDuplicates(key) if repeated else lent, key).withColumn(
        "edited", F.expr("concat(left(text, char_length(text) - char_length(text) div 2), lent)")
    )
    both = with_anchors(edited, "edited", "edited_anchors")
    full = both.withColumn("edited_codes", codes(F.col("edited_anchors")))
    return full.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("codes")).alias("fingerprint"),
        fingerprint(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
        likeness(F.col("codes"), F.col("next_codes")).alias("near_next"),
        "next_id",
    )
