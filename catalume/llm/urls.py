"""URL filters: fixed host and path rules, then mined association rules (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalume.llm.storage import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD, GOOD = "label:bad", "label:good"
#: Frequent tokens of a url up to which FP-growth makes few sets.
WIDE = 12
#: (verdict, rule): the rule's host up to its first slash, then the start of the path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits the host or one of its domains and starts the path, else null."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, start = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a url: scheme, host labels, path words, file ending, query keys; numbers are left out."""
    whole = F.coalesce(url, F.lit(""))
    scheme = F.regexp_extract(whole, r"(?s)^(.*?)://", 1)
    names = F.split(host_of(url), r"\.")
    path = path_of(url)
    words = F.filter(F.split(F.lower(F.regexp_replace(path, r"\.[A-Za-z0-9]{1,5}$", "")), r"[/_.\-]+"), lambda w: ~w.rlike(r"^\d*$"))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    keys = F.regexp_extract_all(F.regexp_extract(whole, r"(?s)\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))

    def marked(mark: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(mark + ":"), v))

    return F.array_distinct(
        F.concat(marked("host", names), marked("path", words), marked("query", keys), marked("ending", F.array(ending)), marked("scheme", F.array(scheme)))
    )


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of pages whose path ends in the number of a labelled document; bad: low quality or toxic."""
    number = F.regexp_extract(path_of(F.col("url")), r"/(\d{1,18})(?:\.[A-Za-z0-9]+)?/?$", 1)
    numbered = pages.select("url", F.when(number != "", number.cast("bigint")).alias("_doc")).where("_doc is not null")
    marks = (
        labels.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    )
    return numbered.join(marks, numbered["_doc"] == marks["doc_id"]).select("url", "bad")


def _sets(tokens: str, most: int) -> Column:
    """All sets of up to ``most`` of an array's distinct values, each in the array's order."""
    rest = lambda s: F.slice(tokens, s["last"] + 1, F.greatest(F.size(tokens) - s["last"], F.lit(0)))
    one = lambda s: F.transform(rest(s), lambda y, j: F.struct((s["last"] + j + 1).alias("last"), F.concat(s["items"], F.array(y)).alias("items")))
    sets = [F.transform(tokens, lambda x, i: F.struct((i + 1).alias("last"), F.array(x).alias("items")))]
    for _ in range(most - 1):
        sets.append(F.flatten(F.transform(sets[-1], one)))
    return F.transform(F.concat(*sets), lambda s: s["items"])


def _rules(items: DataFrame, support: float, size: int, max_tokens: int, min_confidence: float) -> DataFrame:
    """(tokens, confidence, support): sets of up to ``max_tokens`` tokens that foretell the bad label; ``items`` (tokens, label).

    By FP-growth. It finds sets of any size, 2^n of n frequent tokens that stand together often, so where some url has
    more than WIDE such tokens the sets of the wanted sizes are counted one by one instead, with the same rules.
    """
    if (items.agg(F.max(F.size("tokens"))).first()[0] or 0) > WIDE:
        sets = items.select(F.explode(_sets("tokens", max_tokens)).alias("tokens"), (F.col("label") == BAD).cast("int").alias("bad"))
        seen = sets.groupBy(F.array_sort("tokens").alias("tokens")).agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
        share = F.col("bad") / F.col("n")
        return seen.where((F.col("bad") >= math.ceil(support * size)) & (share >= min_confidence)).select("tokens", share.alias("confidence"), (F.col("bad") / size).alias("support"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(items.select(F.concat("tokens", F.array("label")).alias("items")))
    rules = model.associationRules.where((F.element_at("consequent", 1) == BAD) & ~F.array_contains("antecedent", GOOD) & (F.size("antecedent") <= max_tokens))
    return rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")


def mine_rules(
    labelled: DataFrame, min_support: float = 0.005, min_pages: int = 20, min_confidence: float = 0.5, errors: float = 4.0, max_tokens: int = 3
) -> DataFrame:
    """(rule_no, tokens, confidence, support, lift): token combinations that foretell a bad label.

    FP-growth over the labelled urls' tokens with their label as one more
    item. Kept are rules from tokens to the bad label with the given support
    (share of labelled urls, ``min_pages`` urls at least) whose confidence is
    ``min_confidence`` or more and ``errors`` standard errors above the share
    of bad urls among all, and that no shorter rule makes needless by being as
    confident. A rule has ``max_tokens`` tokens at most, whatever the urls. All
    tokens of all urls are counted; of frequent tokens that stand on just the
    same urls one is mined, and its rules are given for each of them. Long
    urls that are almost alike cost as many sets as that size allows, not 2^n,
    see ``_rules``. Lift is confidence over the share of bad urls. No labelled
    url: no rule.
    """
    spark = labelled.sparkSession
    label = F.when(F.col("bad"), F.lit(BAD)).otherwise(F.lit(GOOD))
    sample = labelled.select(url_tokens(F.col("url")).alias("tokens"), label.alias("label"), F.monotonically_increasing_id().alias("row_no"))
    empty = spark.createDataFrame([], "rule_no bigint, tokens array<string>, confidence double, support double, lift double")
    sample = materialize(sample, "url-sample")
    size, bad = sample.agg(F.count("*"), F.count_if(F.col("label") == BAD)).first()
    if size < min_pages or not bad:
        return empty
    support, base = max(min_support, min_pages / size), bad / size
    counted = sample.select(F.explode("tokens").alias("token"), "row_no").groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("row_no")).alias("rows"), F.bit_xor(F.xxhash64("row_no", F.lit(1))).alias("again")
    )
    # at most 1 / support times a url's tokens on average
    alike = counted.where(F.col("n") >= support * size).groupBy("n", "rows", "again").agg(F.sort_array(F.collect_list("token")).alias("alike"))
    alike = materialize(alike.select(F.element_at("alike", 1).alias("token"), "alike"), "url-tokens")
    mined = [r.token for r in alike.select("token").collect()]
    mined = F.array(*map(F.lit, mined)) if mined else F.array().cast("array<string>")
    items = materialize(sample.select(F.array_intersect("tokens", mined).alias("tokens"), "label"), "url-items")
    sure = F.col("confidence") - base >= errors * F.sqrt(base * (1 - base) / (F.col("support") / F.col("confidence") * size))
    found = _rules(items, support, size, max_tokens, min_confidence).where(sure).withColumn("rule_no", F.xxhash64("tokens"))
    found = materialize(found, "url-rules")
    parts = found.select("rule_no", "tokens", "confidence", F.explode("tokens").alias("_token"))
    smaller = found.select(F.col("tokens").alias("_few"), F.col("confidence").alias("_sure"), F.element_at("tokens", 1).alias("_token"))
    needless = parts.join(smaller, "_token").where(
        (F.size("_few") < F.size("tokens")) & (F.col("_sure") >= F.col("confidence")) & (F.size(F.array_except("_few", "tokens")) == 0)
    )
    kept = found.join(needless.select("rule_no"), "rule_no", "left_anti")
    named = kept.select("rule_no", "confidence", "support", F.explode("tokens").alias("token")).join(alike, "token")
    named = named.groupBy("rule_no", "confidence", "support").agg(F.collect_list("alike").alias("choices"))
    every = F.aggregate(
        "choices",
        F.array(F.array().cast("array<string>")),
        lambda done, choice: F.flatten(F.transform(done, lambda d: F.transform(choice, lambda c: F.concat(d, F.array(c))))),
    )
    named = named.select(F.explode(every).alias("tokens"), "confidence", "support").withColumn("tokens", F.array_sort("tokens"))
    return named.select(F.xxhash64("tokens").alias("rule_no"), "tokens", "confidence", "support", (F.col("confidence") / base).alias("lift"))


def match_mined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined): those of the distinct ``urls`` (url, tokens) that hold all tokens of some rule, and the surest such rule.

    An inverted index lists each rule under its rarest token among the rules'
    own; a url looks up its tokens there and checks the rest of the rule.
    """
    shares = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    evidence = F.struct("confidence", "support", "rule_no", "lift", F.col("tokens").alias("rule_tokens"))
    listed = rules.select("rule_no", "tokens", evidence.alias("evidence"), F.explode("tokens").alias("token")).join(shares, "token")
    index = listed.groupBy("rule_no").agg(F.min(F.struct("n", "token"))["token"].alias("token"), F.first("tokens").alias("needs"), F.first("evidence").alias("evidence"))
    looked = urls.select("url", "tokens", F.explode("tokens").alias("token"))
    fits = looked.join(index, "token").where(F.size(F.array_except("needs", "tokens")) == 0)
    return fits.groupBy("url").agg(F.max("evidence").alias("mined"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, **mining) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict and, of a mined rule that fits, its evidence.

    The longest fitting rule decides; else a url is blocked if a mined rule
    matches its tokens and allowed if none does. The surest such rule's
    mined_rule (number), mined_tokens, mined_confidence, mined_support and
    mined_lift stand beside the verdict, null where none fits. Null urls and urls without
    ``://`` have empty host and path and no rule. Repeated pages get a row
    each; an empty table gives an empty result; other columns are ignored.
    Verdicts are made once per distinct url; one url may hold any share of
    the pages, as its large partition can be split in the join back.
    """
    pages = pages.select("page_id", "url")
    mined = mine_rules(labelled_urls(pages, labels), **mining)
    urls = pages.select("url").distinct().select("url", url_tokens(F.col("url")).alias("tokens"))
    hits = match_mined(urls, mined).select(F.col("url").alias("_url"), F.hash("url").alias("_deal"), "mined")
    rows = pages.withColumn("_own", F.hash("url"))
    joined = rows.join(hits, (rows["_own"] == hits["_deal"]) & (rows["url"] == hits["_url"]), "left")
    judged = joined.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("_url").isNotNull().alias("hit"), "mined")
    judged = judged.withColumn("fit", match_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        verdict.alias("verdict"),
        F.col("mined.rule_no").alias("mined_rule"),
        F.col("mined.rule_tokens").alias("mined_tokens"),
        F.col("mined.confidence").alias("mined_confidence"),
        F.col("mined.support").alias("mined_support"),
        F.col("mined.lift").alias("mined_lift"),
    )
