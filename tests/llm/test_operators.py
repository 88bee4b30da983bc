"""The numbered operators: hard rows, empty tables, and plain versions of each."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from catalume.llm import bpe, chat, exact, html, packing, quality, sharding, simhash, syncmers, urls
from catalume.llm.storage import rank_in_cells

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp string, deal string"
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PLAIN = public_tokenizers.path("byte_bpe_50k.json")


def rows():
    """Null, empty, blank, long, unbroken, repeated and accented texts, one id twice, clashing columns."""
    random.seed(7)
    words = ["casa", "rio", "água", "the", "of", "漢字", "x1", "don't", "\n", "  ", "end."]
    long = " ".join(random.choice(words) + str(random.randint(0, 99)) for _ in range(6000))
    texts = [None, "", "   ", "a", "same text here", "same text here", "Same text here", "z" * 9000, long, long, long + " tail", "é" * 400, "\t\n", "🙂🙂 ok"]
    texts += [" ".join(random.choice(words) for _ in range(random.randint(1, 60))) for _ in range(30)]
    out = [(i, t, None if i % 5 == 0 else "pt", f"s{i % 3}", len(t or ""), "k", "f", "d") for i, t in enumerate(texts)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# -- exact -------------------------------------------------------------------


def plain_groups(given):
    groups = {}
    for i, t, *_ in given:
        groups.setdefault(t or "", []).append(i)
    return {i: (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}


@pytest.mark.parametrize("bits", [64, 4])
def test_exact_groups(docs, bits):
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_duplicates(docs, key_bits=bits).collect()}
    assert found == plain_groups(rows())


def test_exact_chunks_join_to_the_text(docs):
    odd = docs.select("text", F.array_join(exact.chunks(F.col("text")), "").alias("joined")).collect()
    assert all(r.joined == (r.text or "") for r in odd)


def test_exact_repeated_rows_keep_one(docs):
    twice = docs.where("doc_id in (8, 9)").unionByName(docs.where("doc_id in (8, 9)"))
    assert exact.exact_duplicates(twice).where("kept").count() == 1
    assert [r.doc_id for r in exact.drop_exact_duplicates(twice).collect()] == [9]
    assert sorted(exact.drop_exact_duplicates(docs).columns) == sorted(docs.columns)


def test_exact_null_ids_and_empty(spark, nothing):
    ids = spark.createDataFrame([(None, "x"), (None, "x"), (3, "y")], "doc_id long, text string")
    assert exact.exact_duplicates(ids).where("kept").count() == 2
    assert exact.exact_duplicates(nothing).count() == 0
    assert exact.drop_exact_duplicates(nothing).count() == 0
    clash = ids.withColumn("_sha", F.lit("s")).withColumn("_key", F.lit("k")).withColumn("kept", F.lit(1)).withColumn("_id", F.lit(2))
    assert sorted(map(str, exact.drop_exact_duplicates(clash).collect())) == sorted(map(str, clash.distinct().collect()))


# -- simhash -----------------------------------------------------------------


def plain_simhash(text, words=3):
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(parts[i : i + words]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > n)


def plain_components(points):
    """id -> smallest reachable id at 3 bits."""
    root = {i: i for i in points}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(points)
    for a in ids:
        for b in ids:
            if a < b and (points[a] ^ points[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("bucket", [64, 1])
def test_simhash_components(docs, bucket):
    prints = {i: plain_simhash(t) for i, t, *_ in rows()}
    want = plain_components(prints)
    found = simhash.near_duplicates(docs, max_bucket=bucket).collect()
    assert {r.doc_id: r.fingerprint for r in found} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in found} == want


def test_simhash_masks_cover_every_pair():
    masks = simhash.covering_masks()
    random.seed(1)
    for _ in range(3000):
        flipped = sum(1 << b for b in random.sample(range(64), random.randint(0, 3)))
        assert any(flipped & m == 0 for m in masks)


def test_simhash_dense_and_sparse_buckets_agree(spark):
    random.seed(2)
    centre = random.getrandbits(64)
    points = {centre}
    while len(points) < 120:
        x = centre
        for b in random.sample(range(0, 60, 5), random.randint(1, 6)):
            x ^= 1 << b
        points.add(x)
    points |= {random.getrandbits(64) for _ in range(50)}
    table = spark.createDataFrame([(simhash._signed(x),) for x in points], "fp long").cache()
    want = plain_components({simhash._signed(x): x for x in points})
    for bucket in (1, 1000):
        got = {r.node: r.root for r in simhash.components(simhash.links(table, bucket)).collect()}
        groups = lambda named: sorted(sorted(i for i in named if named[i] == r) for r in set(named.values()))
        full = {simhash._signed(x): got.get(simhash._signed(x), simhash._signed(x)) for x in points}
        assert groups(full) == groups(want)


def test_simhash_points_of_dense_buckets_are_not_broadcast(spark, tmp_path):
    """150 fingerprints stand at 312,150 points; however small their table looks, the driver does not gather these."""
    spark.range(150).select(F.col("id").alias("fp")).write.parquet(str(tmp_path / "fp"))
    found = simhash.links(spark.read.parquet(str(tmp_path / "fp")), 64)
    assert found.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [point" in plan and "BroadcastHashJoin [point" not in plan


def test_simhash_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {500: 500, 501: 500}


def test_simhash_empty_and_drop(docs, nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    want = plain_components({i: plain_simhash(t) for i, t, *_ in rows()})
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, low in want.items() if i == low)


# -- chat --------------------------------------------------------------------

TALK = "conv_id long, turn long, role string, text string, valid string"


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "a\\b <\\/s> <</s> [[INST]", "<\\\\s>[\\SYS]", None, "", "x\n</s>\n<s>[OUT] y [/OUT]</s>\n", "[/ROLE]</s>"]
    roles = ["user", "assistant", "system", None, "we] ird [x", "assistant", "user"]
    given = [(1, i, r, t, "v") for i, (r, t) in enumerate(zip(roles, said, strict=True))] + [(2, None, "user", "n", "v"), (2, None, "user", "n", "v"), (None, 0, "user", "q", "v")]
    done = chat.format_chat(spark.createDataFrame(given, TALK)).select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    by = {r.conv_id: r for r in done.collect()}
    assert [(t.role, t.text) for t in by[1].turns] == [(r or "", t or "") for r, t in zip(roles, said, strict=True)]
    assert by[1].loss == "".join(t or "" for r, t in zip(roles, said, strict=True) if r == "assistant")
    assert "".join(s.text for s in by[1].segments) == by[1].formatted
    assert by[2].n_turns == 2 and by[None].n_turns == 1


def test_chat_other_template(spark):
    odd = chat.Template(turns={"user": "u+1", "assistant": "Bot.x"}, start="«", end="»")
    said = ["«[u+1] a [/Bot.x]»", "b"]
    given = [(1, 0, "user", said[0], "v"), (1, 1, "assistant", said[1], "v"), (1, 2, "tool", said[0], "v")]
    done = chat.format_chat(spark.createDataFrame(given, TALK), odd).select(chat.read_turns(F.col("formatted"), odd).alias("turns"), chat.loss_text(F.col("segments"), odd).alias("loss")).first()
    assert [tuple(t) for t in done.turns] == [("user", said[0]), ("assistant", said[1]), ("tool", said[0])] and done.loss == "b"


def test_chat_automaton(spark):
    order = {1: "system user assistant", 2: "user user", 3: "assistant", 4: "user assistant user assistant", 5: "user assistant system", 6: "user"}
    given = [(c, i, r, "t", "v") for c, rs in order.items() for i, r in enumerate(rs.split())]
    found = {r.conv_id: (r.valid, r.bad_turn) for r in chat.format_chat(spark.createDataFrame(given, TALK)).collect()}
    assert found == {1: (True, None), 2: (False, 1), 3: (False, 0), 4: (True, None), 5: (False, 2), 6: (False, None)}
    assert chat.format_chat(spark.createDataFrame([], TALK)).count() == 0


# -- bpe ---------------------------------------------------------------------


def test_bpe_like_tiktoken(docs, nothing):
    import tiktoken

    ranks = bpe.parse_ranks(open(MULTI, "rb").read())
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: plain.encode_ordinary(t or "") for i, t, *_ in rows()}
    found = {r.doc_id: r for r in bpe.encode_documents(docs, MULTI, public_tokenizers.PATTERN).collect()}
    assert {i: list(r.ids) for i, r in found.items()} == want
    texts = {i: t or "" for i, t, *_ in rows()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest() and r.n_tokens == len(r.ids) for i, r in found.items())
    assert all(r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() for r in found.values())
    assert bpe.encode_documents(nothing, MULTI, public_tokenizers.PATTERN).count() == 0


def test_bpe_other_patterns_and_ranks():
    """A pattern that holds a blank with what stands before it, and a token that no merge reaches."""
    import tiktoken

    ranks = bpe.parse_ranks(open(MULTI, "rb").read())
    ranks |= {b"zqxzq": max(ranks.values()) + 1}
    texts = ["zqxzq zqxzqq the rio  casa", "a b c", "", "água the\nof "]
    for pattern in (public_tokenizers.PATTERN, r"\w+ ?|\s+|[^\w\s]+", r"\w+(?= )|."):
        plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        assert [list(x) for x in bpe.Codec(ranks, pattern).encode_batch(texts)] == [plain.encode_ordinary(t) for t in texts]


def test_bpe_memory_is_bounded():
    ranks = bpe.parse_ranks(open(MULTI, "rb").read())
    small, large = bpe.Codec(ranks, public_tokenizers.PATTERN, memory=5), bpe.Codec(ranks, public_tokenizers.PATTERN)
    texts = [t or "" for _, t, *_ in rows()]
    assert [list(small.encode_batch([t]))[0] for t in texts] == list(large.encode_batch(texts))


# -- urls --------------------------------------------------------------------


def plain_rule(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for _, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark):
    given = [None, "", "x", "http://A.Example.NET/en/1?q#f", "http://example.net/de/", "http://example.net", "http://example.com/de/x", "https://notexample.com/de/", "http://q.org/fr/a", "http://net/", "s://u?x/y", "http://ÄB.net/a#", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "h", "t") for i, u in enumerate(given)], "page_id long, url string, host string, tokens string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = {r.page_id: (r.host, r.path, r.rule) for r in urls.judge_urls(pages, labels).collect()}
    assert found == {i: plain_rule(u) for i, u in enumerate(given)}
    assert urls.judge_urls(pages.limit(0), labels).count() == 0


def test_url_rules_are_mined(spark):
    random.seed(3)
    bad = [f"http://spam{i % 3}.shop/win/{i}" for i in range(60)]
    good = [f"http://news{i % 3}.site/{random.choice(['win', 'read'])}/{i + 100}" for i in range(200)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(bad + good + bad[:1] + [None])], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, 0) for i in range(60)] + [(i + 100, 1, 0) for i in range(200)] + [(5, None, None)], "doc_id long, quality int, toxic int")
    found = urls.judge_urls(pages, labels, rules=()).collect()
    assert {r.page_id for r in found if r.verdict == "block"} == {*range(60), 260}
    assert len(found) == 262


# -- quality -----------------------------------------------------------------


def test_quality_learns_and_scores_all(spark, docs, nothing):
    random.seed(4)
    fine = [" ".join(random.choice(["river", "house", "green", "walks"]) for _ in range(30)) for _ in range(60)]
    junk = [" ".join(random.choice(["x$$", "!!", "BUY", "%%q"]) for _ in range(30)) for _ in range(60)]
    table = spark.createDataFrame(list(enumerate(fine + junk + [None, ""])), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.classify(table, labels).collect()}
    out = [r for i, r in found.items() if i < 120 and r.held_out]
    assert all((r.predicted == 1) == (r.doc_id < 60) for r in out) and out
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert all(0 <= r.score <= 1 for r in found.values()) and len(found) == 122
    kept = quality.keep_good(table, labels)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.predicted}
    none = labels.limit(0)
    assert quality.classify(docs, none).count() == docs.count()
    assert quality.classify(nothing, none).count() == 0


def plain_features(text):
    """Buckets of words and n-grams, one at a time."""
    factor, mix = int(quality._FACTOR), int(quality._MIX)

    def bucket(h):
        mixed = h * mix % (1 << 64)
        return ((mixed ^ mixed >> 32) * factor % (1 << 64) >> 48) % quality.BUCKETS

    whole, found = f" {' '.join(text.split())} ", []
    if len(whole) < 3:
        return found
    for n in quality.GRAMS:
        for i in range(len(whole) - n + 1):
            h = n
            for c in whole[i : i + n]:
                h = (h * factor + ord(c)) % (1 << 64)
            found.append(bucket(h))
    return found + [bucket(sum(ord(c) * pow(factor, k, 1 << 64) for k, c in enumerate(w)) % (1 << 64)) for w in text.split()]


@pytest.mark.parametrize("size", [1 << 18, 500, 7, 3])
def test_quality_features_do_not_depend_on_pieces(monkeypatch, size):
    monkeypatch.setattr(quality, "_AT_ONCE", size)
    for text in ("", "a", " ab  cd ", "z" * 2000, "é漢 " * 30 + "x" * 40, " ".join(f"w{i}" for i in range(400))):
        assert sorted(np.concatenate([[], *quality.features(text)]).tolist()) == sorted(plain_features(text))


def test_quality_trains_like_the_plain_version():
    import math

    rng = random.Random(9)
    texts = [(" ".join(rng.choice("abc") for _ in range(rng.randint(1, 9))), rng.randint(0, 1)) for _ in range(12)]
    model = quality.train([(*quality.counted(t), y) for t, y in texts], epochs=2)
    draw = np.random.default_rng(0)
    vectors = draw.uniform(-1 / quality.WIDTH, 1 / quality.WIDTH, (quality.BUCKETS, quality.WIDTH)).tolist()
    share = (sum(y for _, y in texts) + 1) / (len(texts) + 2)
    weights, bias, done, steps = [[0.0, 0.0] for _ in range(quality.WIDTH)], [math.log(1 - share), math.log(share)], 0, 2 * len(texts)

    def odds(found):
        mean = [sum(vectors[b][k] for b in found) / max(1, len(found)) for k in range(quality.WIDTH)]
        logits = [sum(m * w[c] for m, w in zip(mean, weights)) + bias[c] for c in (0, 1)]
        return mean, [math.exp(x) / sum(map(math.exp, logits)) for x in logits]

    for _ in range(2):
        for i in draw.permutation(len(texts)).tolist():
            found, (_, y) = plain_features(texts[i][0]), texts[i]
            pace, done = 0.08 * (1 - done / steps), done + 1
            mean, p = odds(found)
            error = [p[c] - (c == y) for c in (0, 1)]
            back = [sum(w[c] * error[c] for c in (0, 1)) for w in weights]
            kinds = len(set(found))
            for k in range(quality.WIDTH):
                for c in (0, 1):
                    weights[k][c] -= pace * mean[k] * error[c]
            bias = [b - pace * e for b, e in zip(bias, error)]
            for b in found:
                vectors[b] = [v - pace * kinds / len(found) * g for v, g in zip(vectors[b], back)]
    for text, _ in [*texts, ("", 0), ("other words", 0)]:
        assert abs(quality.score(text, model.margins(), model.offset()) - odds(plain_features(text))[1][1]) < 1e-9


def test_quality_clashing_columns(spark):
    table = spark.createDataFrame([(i, f"text {i}", 1, 2, "x") for i in range(30)] + [(3, "another", 1, 2, "x")], "doc_id long, text string, label int, _id int, _doc string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    assert quality.classify(table, labels).count() == 31
    assert quality.keep_good(table, labels).columns == table.columns


# -- html --------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<nav><a href=x>menu</a></nav><footer>f</footer>", ""),
        ("<article><h1>T&amp;t</h1><p><b>One.<br><p>Two\n  three.</p></article><footer>&copy; x</footer>", "T&t One. Two three."),
        ("<div class=ad>Buy</div><article><p>A&nbsp;b</p><script>var t='</p>'</script><aside>more</aside><p>c</p></article>", "A b c"),
        ("<body><div id='cookie-notice'>We use</div><main><p>Long main text of the page itself.</p><form>Name <input></form><div class='comments'><p>first!</p></div></main>", "Long main text of the page itself."),
        ("<div><p>unclosed <b>bold <i>it<p>next</div>", "unclosed bold it next"),
    ],
)
def test_html_cases(page, want):
    assert html.main_text(page) == want


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>á x</p></article>", 5), (1, "u", None, 5), (None, None, "<p>q</p>", 5)], "page_id long, url string, html string, n_chars int")
    assert sorted((r.text, r.n_chars) for r in html.extract_pages(pages).collect()) == [("", 0), ("q", 1), ("á x", 3)]
    assert html.extract_pages(pages.limit(0)).count() == 0


def test_html_smoothing_and_clusters():
    assert np.allclose(html.smoothed(np.ones(9)), 1)
    assert 2 < html.split_level(np.array([1.0, 1.2, 0.9, 10.0, 11.0])) < 10


# -- packing -----------------------------------------------------------------


def test_packing_holds_every_token_once(docs, nothing):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PLAIN)
    plain.encode_special_tokens = True
    ids = {i: plain.encode(t or "", add_special_tokens=False).ids + [0] for i, t, *_ in rows()}
    found = packing.pack(docs, PLAIN, public_tokenizers.PATTERN).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(piece) and r.doc_tokens == len(ids[r.doc_id])
    for i, pieces in by.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[i])
    assert set(by) == set(ids)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(nothing, PLAIN, public_tokenizers.PATTERN).count() == 0


def test_packing_patterns_are_near_the_bound():
    random.seed(5)
    demand = {}
    for _ in range(20_000):
        s = random.randint(1, 1023)
        demand[s] = demand.get(s, 0) + 1
    patterns = packing.solve_patterns(demand)
    held = {}
    for p in patterns:
        assert sum(s * n for s, n in p.holds.items()) <= 1024
        for s, n in p.holds.items():
            held[s] = held.get(s, 0) + n * p.times
    assert held == demand
    assert sum(p.times for p in patterns) <= 1.03 * sum(s * n for s, n in demand.items()) / 1024
    assert packing.solve_patterns({}) == []


# -- syncmers ----------------------------------------------------------------


def test_syncmers_edits(docs, nothing):
    texts = {i: t or "" for i, t, *_ in rows()}
    order = sorted(texts, reverse=True)
    found = {r.doc_id: r for r in syncmers.fingerprint_edits(docs).collect()}
    assert set(found) == set(texts)
    prints = {}
    for at, i in enumerate(order):
        following, n = texts[order[(at + 1) % len(order)]], len(texts[i])
        edited = texts[i][: n - n // 2] + following[: n // 2]
        r = found[i]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == n
        assert prints.setdefault(texts[i], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == texts[i]:
            assert r.near_edited == 1
    assert syncmers.fingerprint_edits(nothing).count() == 0
    assert syncmers.fingerprint_edits(docs.limit(1)).count() == 1


def test_syncmers_are_context_free(spark):
    passage = " ".join(f"word{i * i % 97}" for i in range(40))
    table = spark.createDataFrame([(1, passage), (2, f"some other words before it {passage} and after"), (3, "few words")], "doc_id long, text string")
    marked = syncmers.with_anchors(table, "text", "anchors")
    found = {r.doc_id: r.anchors for r in marked.collect()}
    place = {d: {a.code: a.pos for a in x.runs} for d, x in found.items()}
    assert len(place[1]) > 5 and {c: p + 5 for c, p in place[1].items()}.items() <= place[2].items()
    assert not found[3].runs and len(found[3].pairs) == 1


# -- sharding ----------------------------------------------------------------


def test_shards_are_even_and_gapless(docs, nothing):
    twice = docs.unionByName(docs.where("doc_id < 10"))
    found = sharding.hilbert_shards(twice, shards=7, rows_a_part=3).collect()
    counts = {}
    for r in found:
        counts.setdefault(r.shard, []).append(r.slot)
    assert len(found) == twice.count() and set(counts) == set(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    texts = {i: (t or "").encode() for i, t, *_ in rows()}
    assert all(r.size == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in found)
    curve = [r.curve for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    assert curve == sorted(curve)
    assert sharding.hilbert_shards(nothing).count() == 0


def test_hilbert_curve_steps_to_neighbours(spark):
    cells = spark.range(4096).selectExpr("cast(id % 16 as int) a", "cast(id div 16 % 16 as int) b", "cast(id div 256 as int) c")
    path = sharding.hilbert_index(cells, ("a", "b", "c")).orderBy("curve").collect()
    assert [r.curve for r in path] == list(range(4096))
    assert all(sum(abs(x - y) for x, y in zip(p[:3], q[:3], strict=True)) == 1 for p, q in zip(path, path[1:], strict=False))


def test_ranks_in_cells(spark):
    table = spark.range(500).selectExpr("id", "if(id % 3 = 0, id % 7, 99) as cell")
    placed, parts = rank_in_cells(table, ["cell"], ["id"], 40, 5)
    ranks = placed.join(parts, ["cell", "sub"]).select("cell", (F.col("before") + F.col("place")).alias("rank")).collect()
    by = {}
    for r in ranks:
        by.setdefault(r.cell, []).append(r["rank"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
