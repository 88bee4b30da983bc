"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.llm import bpe, chat, exact, html, packing, phrases, pii, quality, sharding, simhash, syncmers, tries, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that speaks in control strings, formatted; the digests are read back from the output."""
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    talks = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    done = chat.format_chat(talks).select(
        "conv_id",
        "valid",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("segments")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(_table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op8_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, kinds = pii.find_personal_data(_table(spark, sf_dir, "documents")), [k.name for k in pii.KINDS]
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in kinds),
        F.sha2(pii.listed(kinds).cast("binary"), 256).alias("base_sha256"),
        pii.listed([*kinds, "term"]).alias("spans"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_chat_format,
        op2_bpe_roundtrip,
        op3_simhash_dedup,
        op4_url_filter,
        op5_quality_classifier,
        op6_html_main_text,
        op7_packing,
        op8_syncmer_fingerprints,
        op9_hilbert_shards,
        op10_exact_dedup,
        op11_collocations,
        op12_personal_data,
        op13_prefix_trie,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; tests hold the others against plain versions."""
    return {
        "op1_chat_format": r"""
            WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
                UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
            e AS (SELECT *, regexp_replace(regexp_replace(x, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?(?:SYS|INST|OUT|ROLE)\])', '[\\\1', 'g') AS y,
                CASE r WHEN 'system' THEN 21 WHEN 'user' THEN 23 WHEN 'assistant' THEN 21 ELSE 24 + length(url_encode(r)) END AS tags FROM t),
            g AS (SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x) AS said,
                coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (WHERE r = 'assistant'), '') AS loss,
                string_agg(r, ' ' ORDER BY turn NULLS FIRST, r, x) AS roles, CAST(sum(length(y) + tags) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
            SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
                regexp_full_match(roles, '(system )?user assistant( user assistant)*') AS valid FROM g""",
        "op10_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
        "op11_collocations": r"""
            WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents),
            w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
            i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
            g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM i, range(1, 6) r(m) WHERE i + m - 1 <= len(ws)),
            f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING m = 1 OR f >= 100),
            n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
            c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
            k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
            s AS (SELECT k.lang, k.m, k.phrase, k.a, h.f AS l, t.f AS r, k.k, n.n, CAST(1000 AS HUGEINT) * k.a * n.n // (CAST(h.f AS HUGEINT) * t.f) AS score
                FROM k JOIN f h ON h.lang = k.lang AND h.phrase = array_to_string(k.ws[1:k.k], ' ') JOIN f t ON t.lang = k.lang
                AND t.phrase = array_to_string(k.ws[k.k + 1:k.m], ' ') JOIN n ON n.lang = k.lang QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY score, k.k) = 1),
            o AS (SELECT s.* FROM s WHERE NOT EXISTS (FROM c WHERE c.lang = s.lang AND c.m > s.m AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' ')
                AND 100 * c.a >= 100 * s.a))
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n,
                CAST(score AS BIGINT) AS score FROM o QUALIFY rank <= 2000""",
        "op12_personal_data": r"""
            WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS x FROM documents),
            e AS (SELECT *, regexp_extract_all(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS m,
                string_split_regex(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS g FROM d),
            y AS (SELECT *, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(repeat(' ', length(m[i])), '')), '') AS z,
                array_to_string(g, chr(10)) AS b FROM e),
            p AS (SELECT u, x, b, k, kind, p FROM y, (VALUES (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'),
                (2, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'), (3, 'card', '[0-9](?:[\x20-]?[0-9])+'),
                (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')) v(k, kind, p)),
            q AS (SELECT u, k, kind, s, g, m, unnest(range(1, len(m) + 1)) AS i FROM (
                SELECT u, k, kind, 'text' AS s, CASE k WHEN 1 THEN string_split_regex(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') WHEN 2 THEN
                    string_split_regex(x, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') WHEN 3 THEN string_split_regex(x, '[0-9](?:[\x20-]?[0-9])+')
                    ELSE string_split_regex(x, '\+[0-9][\x20().0-9-]+[0-9]') END AS g, regexp_extract_all(x, p) AS m FROM p
                UNION ALL SELECT u, k, kind, 'rest', CASE k WHEN 1 THEN string_split_regex(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') WHEN 2 THEN
                    string_split_regex(b, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') WHEN 3 THEN string_split_regex(b, '[0-9](?:[\x20-]?[0-9])+')
                    ELSE string_split_regex(b, '\+[0-9][\x20().0-9-]+[0-9]') END, regexp_extract_all(CASE k WHEN 1 THEN x ELSE b END, p) FROM p)),
            h AS (SELECT *, m[i] AS t, regexp_replace(m[i], '[^0-9]', '', 'g') AS n FROM q),
            o AS (SELECT * FROM h WHERE CASE k WHEN 1 THEN true WHEN 2 THEN list_max(list_transform(string_split(t, '.'), lambda v: CAST(v AS HUGEINT))) <= 255
                WHEN 4 THEN length(n) BETWEEN 8 AND 15 ELSE length(n) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(n) + 1), lambda j:
                    CASE WHEN j % 2 = 1 THEN CAST(reverse(n)[j] AS INT) ELSE CAST('0246813579'[CAST(reverse(n)[j] AS INT) + 1] AS INT) END)) % 10 = 0 END),
            a AS (SELECT u, k, kind, len(string_agg(w, '')) AS stop, stop - length(any_value(t)) AS start FROM (
                SELECT u, k, kind, i, t, unnest(list_concat(g[1:i], m[1:i])) AS w FROM o WHERE s = 'text') GROUP BY u, k, kind, i),
            near AS (SELECT kind || ':' || CASE k WHEN 1 THEN lower(t) WHEN 2 THEN t ELSE n END AS entity,
                list_transform(regexp_extract_all(g[i], '\p{L}+')[-5:], lambda v: lower(v)) AS l, list_transform(regexp_extract_all(g[i + 1], '\p{L}+')[1:5], lambda v: lower(v)) AS r
                FROM o WHERE s = 'rest'),
            t AS (SELECT entity, array_to_string(l, ' ') || '|' || array_to_string(r, ' ') AS around, unnest(list_distinct(list_concat(l, r))) AS term FROM near),
            pairs AS (SELECT entity, term, count(*) AS joint, count(DISTINCT around) AS ways FROM t GROUP BY ALL HAVING ways >= 3),
            about AS (SELECT entity, count(*) AS about FROM t GROUP BY 1),
            words AS (SELECT lower(unnest(regexp_extract_all(z, '\p{L}+'))) AS term FROM y),
            met AS (SELECT term, count(*) AS met FROM words GROUP BY 1),
            told AS (SELECT term FROM pairs JOIN about USING (entity) JOIN met USING (term), (SELECT sum(met) AS total FROM met) GROUP BY term
                HAVING max(CASE WHEN total > about THEN 1 - ln(greatest(met / joint, 1.0)) / ln(total / about) ELSE 0 END) >= 0.7),
            z AS (SELECT u, string_split_regex(z, '\p{L}+') AS g, regexp_extract_all(z, '\p{L}+') AS m FROM y WHERE EXISTS (FROM told)),
            ends AS (SELECT u, m, list_transform(range(1, len(m) + 1), lambda i: CAST(list_sum(list_transform(list_concat(g[1:i], m[1:i]), lambda v: length(v))) AS BIGINT)) AS e FROM z
                WHERE list_has_any(list_transform(m, lambda v: lower(v)), (SELECT list(term) FROM told))),
            terms AS (SELECT u, 5 AS k, 'term' AS kind, stop, stop - length(w) AS start FROM (SELECT u, unnest(m) AS w, unnest(e) AS stop FROM ends)
                WHERE lower(w) IN (SELECT term FROM told)),
            every AS (SELECT u, k, kind, start, stop FROM a UNION ALL SELECT u, k, kind, start, stop FROM terms),
            said AS (SELECT u, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) AS spans,
                string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) FILTER (WHERE k < 5) AS base, count(*) FILTER (WHERE k = 1) AS n_email,
                count(*) FILTER (WHERE k = 2) AS n_ip, count(*) FILTER (WHERE k = 3) AS n_card, count(*) FILTER (WHERE k = 4) AS n_phone FROM every GROUP BY u)
            SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
                sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN said USING (u)""",
        "op13_prefix_trie": r"""
            WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS chars, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS s FROM conversations),
            c AS (SELECT conv_id, list(struct_pack(s := s, chars := chars) ORDER BY turn NULLS FIRST, s) AS own FROM t GROUP BY conv_id),
            h AS (SELECT *, conv_id - conv_id % 100 AS base, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda v: CAST(ascii(v) AS BIGINT))),
                lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 6 AS h FROM c),
            b AS (SELECT h.conv_id, list_concat(coalesce(p.own[1:h], []), h.own[h + 1:]) AS turns FROM h LEFT JOIN c p ON p.conv_id = h.base),
            m AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS d, turns FROM b),
            k AS (SELECT conv_id, d, array_to_string(list_transform(turns[1:d], lambda v: v.s), '') AS path, coalesce(turns[d].chars, 0) AS chars, len(turns) = d AS whole FROM m),
            n AS (SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(CASE WHEN d > 0 THEN chars ELSE 0 END) AS own,
                coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE whole), '') AS ends FROM k GROUP BY path, d),
            kids AS (SELECT path[1:64 * (depth - 1)] AS path, depth - 1 AS depth, count(*) AS n FROM n WHERE depth > 0 GROUP BY ALL),
            w AS (SELECT n.*, coalesce(kids.n, 0) AS n_children, path[1:64 * (depth - 1)] AS up FROM n LEFT JOIN kids USING (path, depth)),
            s AS (SELECT path[1:64 * j] AS path, sum(own) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM (SELECT *, unnest(range(depth + 1)) AS j FROM w) GROUP BY 1),
            o AS (SELECT w.*, s.saved, s.leaves, p.conv_id AS parent_conv_id FROM w JOIN s USING (path) LEFT JOIN n p ON p.path = w.up AND p.depth = w.depth - 1),
            r AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS preorder FROM o)
            SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256,
                preorder, (SELECT max(q.preorder) FROM r q WHERE q.path[1:length(r.path)] = r.path) AS subtree_end FROM r"""
    }
