"""Fingerprints, near-duplicates and line dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import TEXTS
from tickforge.llm import alike
from tickforge.llm import op04_winnowing as winnowing
from tickforge.llm import op05_simhash as simhash
from tickforge.llm import op06_line_dedup as lines


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def check_near(found, rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(fps)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min(i, least.get(r, i))
    want = Counter((i, f, least[r]) for (i, _), f, r in zip(rows, fps, roots, strict=True))
    assert Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in found) == want


def test_near_duplicates(docs, nothing, small):
    check_near(simhash.near_duplicates(docs).collect(), [(i, t) for i, t, _ in TEXTS])
    check_near(simhash.near_duplicates(small).collect(), [(r.doc_id, r.text) for r in small.collect()])
    assert simhash.near_duplicates(nothing).count() == 0


def test_keep_one(docs, nothing):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6, 7, 9]
    assert simhash.keep_one(nothing).count() == 0


def edited(words, draw, edits):
    words = list(words)
    for at in draw.sample(range(len(words)), edits):
        words[at] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


def likeness(a, b):
    a, b = ({tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(a & b) / len(a | b)


def plain_set(text):
    """Hashes of the five-word shingles, by their definition."""
    factors = [xxhash.xxh64_intdigest(str(j), seed=42) | 1 for j in range(6)]
    words = [xxhash.xxh64_intdigest(w, seed=42) for w in text.encode().lower().split()]
    n, out = min(5, len(words)), set()
    for i in range(len(words) - n + 1 if n else 0):
        h = sum(w * f for w, f in zip(words[i : i + n], factors, strict=False)) % 2**64
        h = (h ^ h >> 32) * factors[5] % 2**64
        out.add(h ^ h >> 29)
    return out


def test_sketches_by_definition():
    turns = [xxhash.xxh64_intdigest(f"turn{j}", seed=42) | 1 for j in range(24)]
    factor = xxhash.xxh64_intdigest("0", seed=42) | 1
    for text in ("", "one", "One two", "a b c d e f g a b c d e", " ".join(f"w{i}" for i in range(15000)), "same " * 40000):
        want = plain_set(text)
        assert alike.shingle_set(text).tolist() == sorted(want)
        node, least, variants = alike.sketch(text)
        assert np.frombuffer(least, np.uint32).tolist() == sorted({h * factor % 2**64 >> 32 for h in want})[:512]
        if want:
            each = [[(h ^ turns[23 - j]) * turns[j] % 2**64 for h in want] for j in range(24)]
            assert alike.symbols(np.array(sorted(want), np.uint64)).tolist() == [min(x ^ x >> 31 for x in e) for e in each]
            assert len(set(variants.tolist())) == 24
        else:
            assert not len(variants)
        assert node == alike.sketch(text.upper())[0]
    none, one = np.zeros(0, np.uint32), np.array([1], np.uint32)
    assert alike.alike(none, none) and not alike.alike(none, one) and not alike.alike(one, none)


def test_a_variant_is_a_fingerprint_less_one_symbol(monkeypatch):
    """Two fingerprints share a variant exactly if they differ in one place at most, and never across places."""
    draw = np.random.default_rng(2)
    for _ in range(200):
        a = draw.integers(0, 2**63, 24, np.uint64)
        b = a.copy()
        changed = draw.choice(24, draw.integers(0, 10), replace=False)
        b[changed] = draw.integers(0, 2**63, len(changed), np.uint64)
        found = []
        for x in (a, b):
            monkeypatch.setattr(alike, "symbols", lambda hashes, x=x: x)
            found.append(alike.variants(np.ones(1, np.uint64)).reshape(4, 6))
        for f in range(4):
            differ = np.flatnonzero((a != b)[6 * f : 6 * f + 6])
            same = found[0][f] == found[1][f]
            assert same.sum() == (6 if not len(differ) else len(differ) == 1) and (len(differ) != 1 or same[differ[0]])


EDITS = {
    "appended": lambda w, k, draw, other: w + [f"n{draw.randrange(10**6)}" for _ in range(k)],
    "of another": lambda w, k, draw, other: w + (other * (k // len(other) + 1))[:k],
    "prepended": lambda w, k, draw, other: [f"n{draw.randrange(10**6)}" for _ in range(k)] + w,
    "cut": lambda w, k, draw, other: w[: len(w) - int(k * 0.8)],
    "replaced": lambda w, k, draw, other: edited(w, draw, max(1, k // 10)).split(),
}


@pytest.mark.parametrize("kind", EDITS)
def test_recall_of_edits_at_the_threshold(small, kind):
    """Of pairs of likeness 0.8 to 0.84, whatever the edit, 95 of 100 meet and pass; unlike pairs of the corpus never pass."""
    draw = random.Random(7)
    bases = [w for r in small.collect() if 60 <= len(w := (r.text or "").lower().split()) <= 3000]
    pairs = []
    while len(pairs) < 300:
        w = draw.choice(bases)
        e = EDITS[kind](w, int(len(w) * draw.uniform(0.2, 0.26)), draw, draw.choice(bases))
        if 0.8 <= likeness(" ".join(w), " ".join(e)) <= 0.84:
            pairs.append((alike.sketch(" ".join(w)), alike.sketch(" ".join(e))))
    met = [bool({*a[2].tolist()} & {*b[2].tolist()}) for a, b in pairs]
    passed = [alike.alike(alike._hashes(a[1]), alike._hashes(b[1])) for a, b in pairs]
    assert np.mean([m and p for m, p in zip(met, passed, strict=True)]) >= 0.95
    for _ in range(300):
        a, b = draw.choice(bases), draw.choice(bases)
        if likeness(" ".join(a), " ".join(b)) < 0.6:
            assert not alike.alike(*(alike._hashes(alike.sketch(" ".join(x))[1]) for x in (a, b)))


def test_a_bucket_spans_batches(spark):
    """One key's rows come in several Arrow batches and are still one bucket."""
    rows = [(key, key * 1000 + k) for key in (1, 2, 2**40) for k in range(25)]
    frame = spark.createDataFrame(rows, "key long, fp long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = simhash._met(frame, lambda joined, keys, fps: simhash._linked([int(k) for k in sorted({*keys.tolist()})], [int((keys == k).sum()) for k in sorted({*keys.tolist()})])).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got)) == [(1, 25), (2, 25), (2**40, 25)]


def test_keep_one_of_similar_texts(spark, docs, nothing):
    """Groups of edited copies, unlike texts of the same words, clashing and missing ids, against all pairs."""
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(25):
        base = draw.choices(vocabulary, k=draw.randrange(3, 500))
        rows += [(draw.choice([None, *range(200)]), " ".join(base)), (draw.choice([None, *range(200)]), " ".join(draw.sample(base, len(base))))]
        rows += [(draw.randrange(200), edited(base, draw, len(base) // 60 * copy)) for copy in range(draw.randrange(4))]
    sketches = [alike.sketch(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            (x, least, mine), (y, others, theirs) = sketches[i], sketches[j]
            if x == y or ({*mine.tolist()} & {*theirs.tolist()} and alike.alike(alike._hashes(least), alike._hashes(others))):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(f"{'none' if r[0] is None else r[0]}:{r[1]}".encode()).digest())
    want = [min((r for r, x in zip(rows, root, strict=True) if x == one), key=key) for one in set(root)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), similar=True)
    kept = [tuple(r) for r in kept.collect()]
    assert sorted(kept, key=repr) == sorted(want, key=repr) and len(want) < len(rows)
    assert not any(likeness(a[1], b[1]) >= 0.9 for i, a in enumerate(kept) for b in kept[:i])
    for row in {r for r in rows if r not in kept}:
        assert max(likeness(row[1], other[1]) for k, other in enumerate(rows) if k != rows.index(row)) >= 0.7
    kept = simhash.keep_one(docs, similar=True)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6, 7, 9]
    assert simhash.keep_one(nothing, similar=True).count() == 0


def test_similar_texts_are_linked_by_fingerprints_too(spark):
    """Texts within three bits are one group however unlike their sets are, through texts that have both kinds of link."""
    draw = random.Random(8)
    tail = lambda n: " ".join(f"t{draw.randrange(10**6)}" for _ in range(n))
    same = "buy it now " * 60
    first = same + tail(40)
    texts = {5: first, 6: same + tail(40), 7: same.upper() + tail(50), 8: tail(60), 9: tail(3), 4: f"{first} {first}"}
    texts |= {10: f"{texts[6]} and", 11: tail(60)}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert all((fps[5] ^ fps[i]).bit_count() <= 3 for i in (6, 7, 10)) and all((fps[5] ^ fps[i]).bit_count() > 3 for i in (8, 9, 11))
    assert all(likeness(texts[i], texts[j]) < 0.2 for i, j in ((5, 6), (5, 7), (6, 7))) and likeness(texts[6], texts[10]) > 0.9 and likeness(texts[4], first) > 0.9
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in simhash.keep_one(rows, similar=True).collect()) == [4, 8, 9, 11]


def test_similar_groups_hold_all_fingerprint_groups(spark):
    """No two rows that stay are in one component of the fingerprints, against all pairs."""
    draw = random.Random(9)
    rows = [(i, " ".join(draw.choices("ab", k=draw.randrange(1, 7))) + draw.choice(["", " c" * 30, " c d" * 40])) for i in range(150)]
    roots = plain_components([plain_fingerprint(t) for _, t in rows])
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), similar=True).collect()}
    assert len({roots[i] for i in kept}) == len(kept) <= len({*roots}) < len({t for _, t in rows})


@pytest.mark.parametrize("block", [3, 256])
def test_every_pair_that_meets_is_verified(spark, block):
    """One bucket: chains of alike texts, unlike texts, and the least member like none; in blocks of any size."""
    draw = random.Random(5)
    texts = ["alone with its own few words in this bucket"]
    for _ in range(6):
        words = [f"w{draw.randrange(10**6)}" for _ in range(120)]
        for _ in range(draw.randrange(1, 9)):
            texts.append(" ".join(words))
            words = [*words[9:], *(f"w{draw.randrange(10**6)}" for _ in range(9))]  # the next is like this one, the one after it is not
    sketches = spark.createDataFrame([(k, alike.sketch(t)[1]) for k, t in enumerate(texts)], "node long, least binary")
    members = spark.createDataFrame([(1, k, 0, len(texts)) for k in range(len(texts))] + [(2, 0, 0, 2), (2, 1, 0, 2), (3, 1, 1, 3), (3, 2, 1, 3), (3, 3, 1, 3)], "key long, node long, rep long, n long")
    joined = {k: k for k in range(len(texts))}
    true = [(i, j) for i in range(len(texts)) for j in range(i) if likeness(texts[i], texts[j]) >= 0.8]

    def parts(links):
        up = dict(joined)
        for a, b in links:
            old, new = up[a], up[b]
            up = {k: new if v == old else v for k, v in up.items()}
        return {frozenset(k for k in up if up[k] == r) for r in up.values()}

    for known in ([], true[:3]):
        roots = alike.components(spark.createDataFrame(known, "a long, b long"))
        found = [tuple(r) for r in alike.crossed(members, roots, sketches, block).collect()]
        assert {(max(p), min(p)) for p in found} <= set(true) and len(found) < 3 * len(texts)
        assert parts([*known, *found]) == parts(true) and len(parts(true)) == 7
    settled = alike.components(spark.createDataFrame([(k, 0) for k in range(1, len(texts))], "a long, b long"))
    assert alike.crossed(members, settled, sketches) is None


def test_columns_of_any_name_go_through(spark):
    """Names of the operators' own columns, dots, and kinds that can't be ordered."""
    names = ["__key", "key", "row", "node", "least", "variants", "first", "root", "fp", "a.b", "doc.id", "o0", "a", "b", "n", "rep"]
    rows = [(1, "some words that are repeated here", *range(16)), (1, "some words that are repeated here", 9, *range(1, 16)), (2, "quite other words than those of the first", *range(16))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names)).withColumn("m", F.create_map(F.lit("x"), F.lit(1)))
    for similar in (True, False):
        kept = simhash.keep_one(df, similar)
        assert kept.columns == df.columns and kept.dtypes == df.dtypes
        assert sorted(tuple(r)[:-1] for r in kept.collect()) == [rows[0], rows[2]]



@pytest.mark.parametrize("paired", [10**9, 33])
def test_dense_cluster_links_like_all_pairs(spark, monkeypatch, paired):
    """A cluster whose buckets are large: pairs and the linear star give the same components as all pairs."""
    draw = random.Random(4)
    centre = draw.getrandbits(64)
    fps = {centre}
    for _ in range(700):
        x = centre
        for b in draw.sample(range(64), draw.randrange(6)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "PAIRED", paired)
    array = np.array(fps, np.uint64)
    keys, values = [], []
    for part, (kept, flips) in enumerate(simhash._masks()):
        keys.append((((array & np.uint64(kept))[None, :] ^ flips[:, None]) | np.uint64(part + 1 << simhash.PARTS[part][0])).ravel())
        values.append(np.tile(array, len(flips)))
    keys, values = np.concatenate(keys).view(np.int64), np.concatenate(values)
    order = np.argsort(keys, kind="stable")
    a, b = simhash.collide(keys[order], values[order])
    assert (np.bitwise_count(a ^ b) <= 3).all()
    joined = simhash._Joined()
    joined.new(a, b)
    mine, want = {}, {}
    for x, r in zip(fps, plain_components(fps), strict=True):
        mine.setdefault(joined.root(x), set()).add(x)
        want.setdefault(r, set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(1, 41)) and found[102] == found[101] == 100


LETTER = "[a-z\u00c0-\u0dff\u10a0-\u177f\u1800-\u1fff]"


def plain_units(text):
    return re.findall(rf"{LETTER}{{1,24}}+(?!{LETTER})[!-`{{-~]?|\S", (text or "").lower(), re.ASCII)


def plain_selection(text):
    """Winnowing by its definition, (position, hash), with Spark's hash of units taken from xxhash."""
    mask = 2**64 - 1
    units = [xxhash.xxh64_intdigest(u.encode(), seed=42) for u in plain_units(text)]
    if not units:
        return []
    turn = lambda x, by: (x << by % 64 | x >> (64 - by % 64)) & mask if by % 64 else x
    full = units + [0] * (4 if len(units) < 5 else 0)
    grams = []
    for i in range(max(1, len(units) - 4)):
        h = 0
        for k in range(5):
            h ^= turn(full[i + k], 13 * (4 - k))
        grams.append(h >> 3)
    signed = lambda h: h - (1 << 61) if h >> 60 else h
    chosen = []
    for j in range(max(1, len(grams) - 7)):
        window = grams[j : j + 8]
        least = min(window, key=signed)
        at = j + max(k for k, h in enumerate(window) if h == least)
        if (at, grams[at]) not in chosen[-1:]:
            chosen.append((at, grams[at]))
    return chosen


def test_units():
    assert plain_units("Don't go, 東京x2 ") == ["don'", "t", "go,", "東", "京", "x2"]
    assert plain_units("a" * 30) == ["a"] * 6 + ["a" * 24]


def test_winnowing_equals_its_definition(docs, small, nothing, spark):
    odd = [(1, "東京都は日本の首都であり、世界最大の都市圏を形成している。" * 9), (2, "function(a,b){return a+b;}" * 20), (3, "q" * 500), (4, "no"), (5, "a a a a a a a a a a a a a a a a a a a a"), (6, "x" * 24 + "9 " + "Y" * 25)]
    for df, rows in ((docs, [(i, t) for i, t, _ in TEXTS]), (small, [(r.doc_id, r.text) for r in small.collect()]), (spark.createDataFrame(odd, "doc_id long, text string"), odd)):
        got = {r.doc_id: list(zip(r.positions, r.hashes, strict=True)) for r in winnowing.fingerprints(df).collect()}
        assert all(got[i] == plain_selection(t) for i, t in rows)
    assert winnowing.fingerprints(nothing).count() == 0 and winnowing.compared(nothing).count() == 0


def plain_comparison(rows):
    """By doc_id, its text's hash and text: what the query gives for each."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    rows = sorted(((i, signed(xxhash.xxh64_intdigest(t.encode(), seed=42)), t) for i, t in rows))
    shown = lambda f: ",".join(f"{at}:{h:X}" for at, h in f)
    like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    want = Counter()
    for k, (i, _, t) in enumerate(rows):
        following, half = rows[(k + 1) % len(rows)][2], len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        mine, other, after = (plain_selection(x) for x in (t, edited, following))
        a, b, c = ({h for _, h in f} for f in (mine, other, after))
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(mine), shown(other), round(like(a, b), 9), round(like(a, c), 9)] += 1
    return want


@pytest.mark.parametrize("rows_a_range", [3, 1000])
def test_edited_texts_and_likeness(docs, monkeypatch, rows_a_range):
    monkeypatch.setattr(winnowing, "RANGE_ROWS", rows_a_range)
    found = winnowing.shown_comparison(docs).collect()
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in found)
    assert got == plain_comparison([(i, t or "") for i, t, _ in TEXTS])


def test_winnowing_query(spark):
    folder = "/root/testdata/sf0.001"
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in winnowing.query(spark, folder).collect())
    assert got == plain_comparison([(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()])


def test_equal_and_missing_ids_spread_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "RANGE_ROWS", 10)
    df = spark.createDataFrame([(7 if k % 2 else None, f"text number {k}") for k in range(200)], "doc_id long, text string")
    per = [r["count"] for r in winnowing.with_next(df).groupBy("range").count().collect()]
    assert len(per) > 8 and max(per) < 80 and winnowing.compared(df).count() == 200


@pytest.mark.parametrize("unit", ["word", "ideograph"])
def test_a_shared_passage_is_found(spark, unit):
    draw = random.Random(1)
    new = (lambda: f" {''.join(draw.choices('abcdefghij', k=9))}") if unit == "word" else (lambda: chr(draw.randrange(0x4E00, 0x9FA0)))
    passage = "".join(new() for _ in range(winnowing.GRAM + winnowing.WINDOW - 1))
    df = spark.createDataFrame([(k, "".join(new() for _ in range(40 + k)) + passage + "".join(new() for _ in range(9))) for k in range(2)], "doc_id long, text string")
    a, b = ({*r.hashes} for r in winnowing.fingerprints(df).collect())
    assert a & b


def plain_dedup(rows, ratio, least):
    pages, seen = Counter(), Counter()
    for _, t, s in rows:
        pages[s] += 1
        for x in {*(t or "").split("\n")} - {""}:
            seen[s, x] += 1
    drop = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    return Counter((i, t if t is None else "\n".join(x for x in t.split("\n") if (s, x) not in drop)) for i, t, s in rows)


@pytest.mark.parametrize("broadcast", [250_000, -1])
def test_line_dedup(docs, nothing, monkeypatch, broadcast):
    monkeypatch.setattr(lines, "BROADCAST_LINES", broadcast)
    found = lines.dedup(docs, min_pages=2, ratio=0.5)
    assert found.columns == docs.columns
    got = found.collect()
    assert Counter((r.doc_id, r.text) for r in got) == plain_dedup(TEXTS, 0.5, 2)
    assert any(r.text == "" for r in got) and all(r.n_chars == len(r.text) for r in got if r.text is not None)
    assert lines.dedup(nothing).count() == 0


def test_line_dedup_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = Counter(map(tuple, con.execute(f"SELECT doc_id, source, text, n_lines, n_dropped FROM ({lines.ORACLE})").fetchall()))
    assert Counter(tuple(r) for r in lines.query(spark, folder).collect()) == want


def test_line_dedup_equals_sql_with_holes(spark, tmp_path, monkeypatch):
    """Null texts, null hosts and repeated doc_ids, by SQL and by both plans."""
    rows = [(k % 9, "a" if k % 3 else None, None if k % 5 == 0 else f"shared line\nline {k}\n\nshared line") for k in range(40)] + [(None, "b", "shared line")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = Counter(map(tuple, con.execute(f"SELECT doc_id, source, text, n_lines, n_dropped FROM ({lines.ORACLE})").fetchall()))
    assert Counter(tuple(r) for r in lines.query(spark, str(tmp_path)).collect()) == want and any(r[4] for r in want)
    monkeypatch.setattr(lines, "BROADCAST_LINES", -1)
    assert Counter(tuple(r) for r in lines.query(spark, str(tmp_path)).collect()) == want


def test_hosts_of_pages(spark):
    urls = ["https://www.Example.org:8080/a?b@c", "http://user:pw@site.example/x", "//no.scheme/", None, "ftp://[2001:db8::1]/f", "https://a.b.c#frag"]
    found = spark.createDataFrame([(u,) for u in urls], "url string").select(lines.host_of(F.col("url")).alias("host")).collect()
    assert [r.host for r in found] == ["example.org", "site.example", None, None, "[2001:db8::1]", "a.b.c"]
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = pages.select(F.col("page_id").alias("doc_id"), lines.host_of(F.col("url")).alias("source"), F.regexp_replace("html", "<[^>]*>", "\n").alias("text"))
    rows = [(r.doc_id, r.text, r.source) for r in texts.collect()]
    assert len({h for _, _, h in rows}) > 3
    assert Counter((r.doc_id, r.text) for r in lines.dedup(texts).collect()) == plain_dedup(rows, lines.RATIO, lines.MIN_PAGES)
