import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from catalume.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, block=100, most=6):
    """The contract over lists: (conv_id, depth, parent, members, children, leaves, saved, digest) of each node, in preorder."""
    own = collections.defaultdict(list)
    digest = lambda t: hashlib.sha256(f"{len(t[0])}:{t[0]}{t[1]}".encode()).hexdigest()
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, digest((role or "", text or "")), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % most
        base = [] if c is None else own.get(c - (c % block if c >= 0 else -(-c % block)), [])
        rebuilt[c] = tuple(base[:h] + ts[h:])
    members = collections.defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    out = []
    order = sorted(members, key=lambda p: [digest(t) for t in p])
    ids = lambda p: min((c for c in members[p] if c is not None), default=None)
    for at, p in enumerate(order):
        below = [q for q in order[at:] if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = sorted((c for c in members[p] if len(rebuilt[c]) == len(p)), key=lambda c: (c is not None, c or 0))
        said = ",".join("" if c is None else str(c) for c in ends)
        out.append((ids(p), len(p), ids(p[:-1]) if p else None, len(members[p]), kids[p], sum(not kids[q] for q in below), saved, hashlib.sha256(said.encode()).hexdigest(), at, at + len(below) - 1))
    return out


def talks(seed, convs):
    rng = random.Random(seed)
    for c in convs:
        for turn in range(rng.randrange(1, 9)):
            yield c, rng.choice([turn, turn, turn, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "é\U0001f600"])


@pytest.mark.parametrize("seed", range(2))
def test_like_plain(spark, seed):
    rows = [*talks(seed, [*range(0, 12), 100, 103, 205, 207, -1, -250, 1001]), *[(k, 0, "user", "same") for k in range(300, 360)], *[(77, t, "user", str(t % 3)) for t in range(60)]]
    rows += rows[:5] + [(None, 1, "user", "lost"), (None, None, None, None)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", Node string")
    assert sorted(map(tuple, tries.prefix_trie(frame).collect()), key=lambda r: r[8]) == plain(rows)


def test_only_a_null_conversation(spark):
    rows = [(None, 0, "user", "alone")]
    assert sorted(map(tuple, tries.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=lambda r: r[8]) == plain(rows)


def test_nothing(spark):
    assert tries.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_turnless(spark):
    """A conversation whose own turns all go, and whose block has no base, is a member of the root alone."""
    gone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(gone, 0, "user", "x")]
    found = tries.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert list(map(tuple, found)) == plain(rows) and len(found) == 1


@pytest.mark.parametrize("group", [[], ["g"]])
def test_running(spark, group):
    """A group over all ranges, some over two, many in one."""
    frame = spark.range(3000).select(F.when(F.col("id") < 2000, None).otherwise((F.col("id") / 37).cast("long")).alias("g"), "id", (F.col("id") % 7).alias("v"))
    found = tries.running(frame, group, ["id"], {"n": ("count", "v"), "s": ("sum", "v"), "x": ("bit_xor", "v")}, "t").collect()
    assert len(found) == 3000
    seen = collections.defaultdict(lambda: [0, 0, 0])
    for r in sorted(found, key=lambda r: r.id):
        at = seen[r.g if group else 0]
        at[0], at[1], at[2] = at[0] + 1, at[1] + r.v, at[2] ^ r.v
        assert [r.n, r.s, r.x] == at
