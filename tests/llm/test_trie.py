"""Prefix tries by brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tests.conftest import DATA
from tickforge.llm import op12_prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, p long, depth int, n_convs string"


def built(rows):
    """The rebuilt conversations, by their definition."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    shared = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: tuple(own.get(c - c % 5, [])[: shared[c]] + own[c][shared[c] :]) for c in own}


def plain(convs):
    members, ends, kids, leaves, saved = defaultdict(list), defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        own = (len(m) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own
            leaves[k[:d]] += not kids.get(k)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids.get(k, 0), leaves[k], saved[k], digest(ends.get(k, []))) for k, m in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_query_by_brute_force(spark):
    folder = f"{DATA}/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain(built(rows))
    assert result(trie.query(spark, folder)) == want
    assert len({(r[0], r[1]) for r in want}) == len(want)  # the key of a node


def test_random_conversations_with_holes(spark):
    """Few different turns, so that paths are shared; turnless, repeated, without ids, turns or texts; clashing columns."""
    draw = random.Random(5)
    rows = []
    for c in draw.sample(range(60), 40):
        for t in range(draw.choice([1, 2, 3, 9, 12, 40])):
            rows.append((c, None if draw.random() < 0.02 else t, draw.choice(["user", None]), draw.choice(["a", "b", "ä", "", None])))
    rows += [(None, 0, "user", "a"), (7, 900, "user", "long " * 5000)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(5)
    built_rows, lengths = trie.rebuilt(trie.turns(df))
    want = built(rows)
    assert {r.conv_id: r.length for r in lengths.collect()} == {c: len(s) for c, s in want.items()}
    assert any(not s for s in want.values()) and any(len(s) > 30 for s in want.values())
    ties = len({(c, t) for c, t, *_ in rows}) < len(rows)
    assert ties or result(trie.trie(built_rows, lengths)) == plain(want)


def test_rows_of_one_place_stay(spark):
    """Turns of equal number are turns each, in an order that a rerun gives again."""
    rows = [(5, 1, "user", "x"), (5, 1, "user", "x"), (5, 1, "user", "y"), (5, None, None, None)]
    found = [result(trie.trie(*trie.rebuilt(trie.turns(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(n))))) for n in (1, 3)]
    assert found[0] == found[1] and max(r[1] for r in found[0]) == 4


def test_long_paths_go_in_chunks(spark):
    """Digests of chunked paths and pieces of ids don't depend on the cuts."""
    rows = [(c, d, d * (d % 7 == 0 or c), 0, 3, d == 50) for c in range(3) for d in range(1, 51)] + [(9, d, d * 2, 0, 3, d == 20) for d in range(1, 21)]
    df = spark.createDataFrame(rows, "conv_id long, depth long, a long, b long, bytes long, ends boolean")
    lengths = spark.createDataFrame([(0, 50), (1, 50), (2, 50), (9, 20), (4, 0)], "conv_id long, length long")
    convs = {c: tuple((str(r[2]), "abc") for r in rows if r[0] == c) for c in (0, 1, 2, 9)} | {4: ()}
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(trie.paths(df, 4)) == key(trie.paths(df, 1000))
    assert result(trie.trie(df, lengths)) == plain(convs)
    prefixes = trie.paths(df)
    assert key(trie.ends(prefixes, lengths, 1)) == key(trie.ends(prefixes, lengths))


def test_no_conversations(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert trie.trie(*trie.rebuilt(trie.turns(nothing))).count() == 0
    one = spark.createDataFrame([(3, 0, "user", "hi", 1, 2, "x")], SCHEMA)
    assert trie.trie(*trie.rebuilt(trie.turns(one))).filter(F.col("depth") == 0).count() == 1
