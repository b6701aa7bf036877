"""Quality scores, lattice scores, media, mixing and the pipeline."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import TEXTS
from tickforge.llm import op02_quality as quality
from tickforge.llm import op03_media as media
from tickforge.llm import op08_lattice_lm as lm
from tickforge.llm import op09_mixing as mixing
from tickforge.llm.encode import vocabulary
from tickforge.llm.lattice import Lattice, vocabulary_pieces

FOLDER = "/root/testdata/sf0.001"


def test_quality_held_out(spark):
    rows = quality.query(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.85
    assert np.mean([r.predicted for r in held if r.quality]) > 0.9


def test_quality_edges(docs, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, None), (99, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert model[1].flat
    assert {r.score for r in quality.score(docs, model, F.col("doc_id")).collect()} == {1.0}
    assert quality.keep(docs, labels).columns == docs.columns
    assert quality.fit(docs, labels.limit(0))[1].prior == 0.5
    assert quality.keep(nothing, labels).count() == 0


def test_word_vectors_by_brute_force(docs):
    """Random indexing by its definition: each word adds its neighbours' index vectors, over all documents."""
    plus, minus = quality.index_vectors()
    table = np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    for _, t, _ in TEXTS:
        words = quality.slots(t or "").tolist()
        for i, w in enumerate(words):
            for j in range(max(0, i - quality.REACH), min(len(words), i + quality.REACH + 1)):
                if j != i:
                    table[w, plus[words[j]]] += 1
                    table[w, minus[words[j]]] -= 1
    length = np.linalg.norm(table, axis=1, keepdims=True)
    vectors = quality.word_vectors(docs)
    assert np.allclose(vectors, table / np.maximum(length, 1e-9), atol=1e-6)
    text = TEXTS[0][1]
    words = quality.slots(text).tolist()
    v = np.array([vectors[w] for w in words], float)
    kinds = sorted({*words})
    want = [*v.mean(0), *np.array([vectors[k] for k in kinds], float).mean(0), *v.std(0), math.log1p(len(words)), len(kinds) / len(words)]
    assert np.allclose(quality.pooled(text, vectors), want, atol=1e-6)


def test_temperature_goes_both_ways():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(4000, quality.FEATURES))
    y = (draw.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    network = quality.Network(x, y)
    assert 1 / 8 < network.temperature < 8
    clear = quality.Network(np.where(x[:, :1] > 0, 3.0, -3.0) + 0 * x, (x[:, 0] > 0).astype(float))
    assert clear.temperature == 1.0 and ((clear.probability(np.full((1, quality.FEATURES), 3.0)) > 0.9).all())


def test_network_learns_and_calibrates():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(3000, quality.FEATURES))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (draw.random(3000) < p).astype(float)
    network = quality.Network(x[:2000], y[:2000])
    fresh, truth = network.log_odds(x[2000:]), 2 * y[2000:] - 1
    loss = lambda t: np.logaddexp(0, -truth * fresh / t).mean()
    assert network.temperature > 1 and loss(network.temperature) < min(loss(1.0), np.log(2))


def plain_lattice(word, weight):
    total = [0.0]
    for i in range(1, len(word) + 1):
        # in logs: under another class's weights a long word's probability is less than a double can hold
        total.append(np.logaddexp.reduce([total[j] + weight[word[j:i]] for j in range(max(0, i - 40), i) if word[j:i] in weight]))
    return total[-1]


def test_lattice_sums_all_segmentations():
    pieces, scores = vocabulary_pieces(vocabulary("piece_bpe_32k.model"))
    lattice, weight = Lattice(pieces, scores), dict(zip(pieces, scores, strict=True))
    words = [b" the", b" x", " größe,".encode(), b" " + b"thing" * 9, b" " + "東京".encode()]
    assert lattice.log_probability(words) == pytest.approx([plain_lattice(w, weight) for w in words])
    # expected uses spell each word: their lengths sum to the words'
    uses = lattice.expected(words, np.ones(len(words)))
    assert (uses * np.array(list(map(len, pieces)))).sum() == pytest.approx(sum(map(len, words)))


def check_scores(found, rows, held):
    train, ends = Counter(), 0
    for i, t in rows:
        if not held(i):
            train.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(train.values()) + ends, len(train) + (ends > 0)
    want = Counter()
    for i, t in rows:
        words = (t or "").encode().lower().split()
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
        want[i, held(i), len(words) + 1, sum(w in train for w in words) + (ends > 0), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def plain_scores(rows, held):
    """The model of the module's docstring, a word at a time; rows are (doc_id, text, class). Gives scores by doc_id."""
    words = {i: (t or "").encode().lower().split() for i, t, _ in rows}
    train = {}
    for i, _, k in rows:
        c, ends = train.setdefault(k, (Counter(), Counter()))
        if not held(i):
            c.update(words[i])
            ends["n"] += 1
    every = sum((c for c, _ in train.values()), Counter())
    ends_all = sum(e["n"] for _, e in train.values())

    def discount(c):
        n = [sum(x == j for x in c.values()) for j in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        one = 1 - 2 * y * n[2] / n[1] if n[1] and n[2] else 0.5
        two = 2 - 3 * y * n[3] / n[2] if n[2] and n[3] else 0.7
        more = 3 - 4 * y * n[4] / n[3] if n[3] and n[4] else 0.8
        d = [0.0] + [min(max(x, 0.05), 0.95 * j) for j, x in ((1, one), (2, two), (3, more))]
        return lambda x: d[min(x, 3)]

    pieces, first = vocabulary_pieces(vocabulary("piece_bpe_32k.model"))
    off = discount(every)
    kept = sum(every.values()) - sum(map(off, every.values()))
    parts = {}
    for k, (c, e) in train.items():
        total, weights = sum(c.values()) + e["n"], first
        once = [b" " + w for w, n in c.items() if n == 1]
        for _ in range(lm.ROUNDS if once else 0):
            uses = Lattice(pieces, weights).expected(once, np.ones(len(once))) + lm.SMOOTHING
            weights = np.log(uses / uses.sum())
        d = discount(c)
        freed = sum(map(d, c.values())) / total if c else 1.0
        shared = (sum(every[w] > 1 for w, n in c.items() if n == 1) + 0.5) / (sum(n == 1 for n in c.values()) + 1) if len(train) > 1 and sum(every.values()) > sum(c.values()) else 0.0
        parts[k] = c, d, total, freed, shared, dict(zip(pieces, weights, strict=True)), e["n"]
    out = {}
    for i, _, _ in rows:
        by_class = []
        for c, d, total, freed, shared, weight, e in parts.values():
            plain, known = [], {}
            for w in words[i]:
                if w not in known:
                    spelled = plain_lattice(b" " + w, weight) + math.log(freed * (1 - shared))
                    whole = (c[w] - d(c[w])) / max(total, 1) + freed * shared * (every[w] - off(every[w])) / max(kept, 1)
                    known[w] = np.logaddexp(spelled, math.log(whole)) if whole > 0 else spelled
                plain.append(known[w])
            by_weight = []
            for own in lm.OWN:
                seen, s = Counter(), 0.0
                for t, (w, p) in enumerate(zip(words[i], plain, strict=True)):
                    o = own * t / (t + 20)
                    s += np.logaddexp(p + math.log(1 - o), math.log(o * seen[w] / t) if o * seen[w] else -np.inf)
                    seen[w] += 1
                by_weight.append(s)
            by_class.append(np.logaddexp.reduce(by_weight) - math.log(len(lm.OWN)) + math.log((e or 0.5) / max(total, 1)) + math.log((e + 1) / (ends_all + len(train))))
        out[i] = np.logaddexp.reduce(by_class) / math.log(10)
    return out


def test_scores_equal_the_plain_model(spark, docs):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    rows = [r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect() if r.doc_id % 5 == 0]
    rows = [(r.doc_id, " ".join((r.text or "").split(" ")[:60]), r.lang) for r in rows] + [(10**6, None, "xx"), (10**6 + 1, "9" * 70 + " ab ab ab", None), (10**6 + 7, "de le la", "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    most = [lang for lang, _ in sorted(Counter(lang for i, _, lang in rows if lang and not held(i)).items(), key=lambda x: (-x[1], x[0]))][: lm.CLASSES - 1]
    for f, classed in ((df, [(i, t, lang if lang in most else None) for i, t, lang in rows]), (df.drop("lang"), [(i, t, 0) for i, t, _ in rows])):
        want = plain_scores(classed, held)
        got = {r.doc_id: r.score for r in lm.scores(f, held_out).collect()}
        assert len(got) == len(want) and all(got[i] == pytest.approx(want[i], rel=1e-6) for i in want)


def test_scores_dont_depend_on_a_texts_own_label(spark):
    """Other labels of documents that are held out change no score."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    other = docs.withColumn("lang", F.when(held_out, F.when(F.col("doc_id") % 2 == 0, F.lit("en"))).otherwise(F.col("lang")))
    a, b = ({r.doc_id: r.score for r in lm.scores(x, held_out).collect()} for x in (docs, other))
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], rel=1e-6) for i in a)


def test_long_words_hold_few_places():
    """Probabilities under several weights at once, over more places than are held."""
    pieces, scores = vocabulary_pieces(vocabulary("piece_bpe_32k.model"))
    lattice = Lattice(pieces, scores)
    draw = np.random.default_rng(1)
    other = scores + draw.normal(0, 1, len(scores))
    words = [b" the", b"q", b" " + b"thing" * 1200, b" thingly", b" of"] + [b" " + bytes(draw.choice([*b"etaoin"], n).tolist()) for n in (3, 9, 2500, 9)]
    both = lattice.log_probabilities(words, np.stack([scores, other]))
    assert np.allclose(both[0], lattice.log_probability(words)) and np.allclose(both[1], lattice.weighed(other).log_probability(words))


@pytest.mark.parametrize("places", [1, 7, 50])
def test_expected_uses_by_blocks(monkeypatch, places):
    """A word's expected uses don't depend on the blocks that they are summed by."""
    from tickforge.llm import lattice as module

    lattice = Lattice(*vocabulary_pieces(vocabulary("piece_bpe_32k.model")))
    draw = np.random.default_rng(3)
    words = [b" q", b" the", b" " + b"thing" * 40, " größe東京".encode() * 9] + [bytes(draw.integers(1, 256, n).tolist()) for n in (49, 50, 51, 99, 100, 101, 300)]
    counts = draw.uniform(0.5, 3, len(words))
    whole = lattice.expected(words, counts)
    monkeypatch.setattr(module, "_PLACES", places)
    assert np.allclose(lattice.expected(words, counts), whole, rtol=1e-9, atol=1e-12)


def test_words_of_any_length_re_estimate_the_pieces(spark):
    """Scores follow the plain model, which learns from every word met once, where words have hundreds or thousands of letters."""
    draw = random.Random(6)
    long = ["".join(draw.choices("abcdefgh", k=n)) for n in (255, 256, 257, 700, 2500)]
    rows = [(i, f"some words of text {i} {w} and more", None) for i, w in enumerate(long)] + [(100, "abcdefgh some words hgfedcba", None), (101, "xyz of abab", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = plain_scores(rows, lambda i: i > 99)
    got = {r.doc_id: r.score for r in lm.scores(df, F.col("doc_id") > 99).collect()}
    assert len(got) == len(want) and all(got[i] == pytest.approx(want[i], rel=1e-6) for i in want)


def test_model_is_better_than_its_base(spark):
    found = lm.query(spark, "/root/testdata/sf0.01").collect()
    for group in ([r for r in found if not r.held_out], [r for r in found if r.held_out and r.n_known == r.n_tokens]):
        assert sum(r.score for r in group) > sum(r.base_score for r in group) and np.mean([r.score > r.base_score for r in group]) > 0.9


def test_lattice_scores(docs, nothing, spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 50_000)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    check_scores(lm.scores(docs, held_out).collect(), [(i, t) for i, t, _ in TEXTS], held)
    assert lm.scores(nothing, held_out).count() == 0
    check_scores(lm.scores(docs, F.lit(True)).collect(), [(i, t) for i, t, _ in TEXTS], lambda i: True)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    found = lm.query(spark, FOLDER).collect()
    check_scores(found, rows, held)


def test_html_sequences():
    got = media.read_html("<p>One &amp; two<script>no()</script></p><figure><img src=a.png alt=x><figcaption>The <b>cap</b></figcaption></figure>tail<img data-digest=d0 alt='y z'><br/>end<p>open")
    assert [(i["position"], i["kind"], i["text"] or i["src"], i["caption"]) for i in got] == [(0, "text", "One & two", None), (1, "media", "a.png", "The cap"), (2, "text", "tail", None), (3, "media", "", "y z"), (4, "text", "end", None), (5, "text", "open", None)]
    assert got[3]["digest"] == "d0" and got[1]["digest"] == hashlib.sha256(b"a.png").hexdigest()
    assert media.read_html(None) == [] and media.read_html("<figcaption>x</figure><<<") is not None


def test_media_round_trip(docs, nothing, spark):
    raw = docs.select(F.encode("text", "UTF-8").alias("payload"))
    found = {r.payload_sha256: r for r in media.features(media.store(raw)).collect()}
    for _, t, _ in TEXTS:
        b = (t or "").encode()
        payload = b + b"\xff" * (-len(b) % 576 if b else 576)
        r = found[hashlib.sha256(payload).hexdigest()]
        assert (r.digest, r.n_bytes, r.payload_bytes, r.tail_crc32) == (r.payload_sha256, len(b), len(payload), zlib.crc32(payload[-32:]))
        assert r.media_bytes == len(payload) + len(f"P5\n24 {len(payload) // 24}\n255\n")
    assert media.features(media.store(nothing.select(F.encode("text", "UTF-8")))).count() == 0


def plain_feature(payload):
    picture = np.frombuffer(payload, np.uint8).reshape(-1, 24).astype(float)
    rows = len(picture) // 8
    small = [[picture[r * rows : (r + 1) * rows, c * 3 : c * 3 + 3].mean() for c in range(8)] for r in range(8)]
    mean = np.mean(small)
    bits = lambda f: "".join(f"{int(''.join(str(int(f(r, c))) for c in range(8)), 2):02x}" for r in range(8))
    return f"{bits(lambda r, c: small[r][c] > mean)}:{bits(lambda r, c: small[r][c] > small[r][c - 1])}:{picture.mean():.4f}"


def test_media_query_by_brute_force(docs, nothing, spark):
    more = spark.createDataFrame([(None, None), (None, "z")], "doc_id long, text string")
    found = media.described(docs.select("doc_id", "text").union(more)).collect()
    want = Counter()
    for i, t in [*((i, t) for i, t, _ in TEXTS), (None, None), (None, "z")]:
        b, name = (t or "").encode(), "document" if i is None else f"document {i}"
        payload = b + b"\xff" * (-len(b) % 576 if b else 576)
        kept = f"P5\n24 {len(payload) // 24}\n255\n".encode() + payload
        sha = hashlib.sha256(payload).hexdigest()
        want[
            i, len(b), len(payload), sha, zlib.crc32(payload[-32:]), len(kept), hashlib.sha256(kept).hexdigest(), plain_feature(payload), 1, name, 6,
            "text,media,text,media,text,media", f"{name}={sha};none of {name}=-;again={sha}",
        ] += 1
    assert Counter(tuple(r) for r in found) == want
    assert media.described(nothing).count() == 0


def test_real_pages_keep_their_order(spark):
    """On the pages table: media in the order of their tags, texts with all words of the page in order."""
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").limit(60)
    found = {r.page_id: r["items"] for r in media.interleave(pages, spark.createDataFrame([(None,)], "payload binary")).collect()}
    for r in pages.collect():
        items = found[r.page_id]
        assert [i.position for i in items] == list(range(len(items)))
        bare = re.sub(r"(?is)<(script|style|template|noscript|title)\b.*?</\1\s*>|<!--.*?-->", " ", r.html or "")
        assert [i.src for i in items if i.kind == "media"] == [html.unescape(x) for x in re.findall(r"""(?is)<(?:img|video|audio|source|embed)\b[^>]*?src=["']?([^"'> ]*)""", bare)]
        words = lambda t: Counter(re.findall(r"\w+", t))
        told = " ".join(i.text or i.caption or "" for i in items)
        assert not words(html.unescape(re.sub(r"(?s)<[^>]*>", " ", bare))) - words(told) or "<fig" in bare


def test_no_piece_is_too_long_for_the_lattice():
    pieces, scores = vocabulary_pieces(vocabulary("piece_bpe_32k.model"))
    word = " университе".encode()
    assert word in pieces
    sums = [0.0] + [-np.inf] * len(word)
    known = dict(zip(pieces, scores, strict=True))
    for i in range(1, len(word) + 1):
        sums[i] = np.logaddexp.reduce([sums[k] + known[word[k:i]] for k in range(i) if word[k:i] in known])
    assert Lattice(pieces, scores).log_probability([word])[0] == pytest.approx(sums[-1])


def test_no_caption_or_text_is_lost():
    read = lambda html: [(i["kind"], i["text"] or i["src"], i["caption"]) for i in media.read_html(html)]
    assert read("<figure><figcaption>before</figcaption><img src=a></figure>b") == [("media", "a", "before"), ("text", "b", None)]
    assert read("a<figure><figcaption>of a table</figcaption><table><tr><td>x</table></figure>b") == [("text", t, None) for t in ("a", "of a table", "x", "b")]
    assert read("<figure><img src=a><figcaption>open</figure><p>rest<img src=b alt=c>of it") == [("media", "a", "open"), ("text", "rest", None), ("media", "b", "c"), ("text", "of it", None)]
    assert read("<img src=a><figcaption>never closed <p>rest") == [("media", "a", None), ("text", "never closed rest", None)]
    assert read("<figcaption>x<p>y<img src=b><p>z") == [("text", "xy", None), ("media", "b", None), ("text", "z", None)]
    assert read("<figure><img src=a><figure><img src=b><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure>") == [("media", "a", "out"), ("media", "b", "in")]


def test_each_page_row_has_its_own_sequence(spark):
    source = "<p>a</p><img src=x alt=one><p>b</p><figure><img src=y><figcaption>two</figcaption></figure>"
    pages = spark.createDataFrame([(1, source), (1, source), (None, "<p>c</p>"), (None, source), (None, None)], "page_id long, html string").repartition(3)
    found = media.interleave(pages, spark.createDataFrame([(None,)], "payload binary")).collect()
    one = [(0, "a", None), (1, None, "one"), (2, "b", None), (3, None, "two")]
    got = sorted(((r.page_id, [(i.position, i.text, i.caption) for i in r["items"]]) for r in found), key=repr)
    assert got == sorted([(1, one), (1, one), (None, [(0, "c", None)]), (None, one), (None, [])], key=repr)


def test_interleaved_pages_resolve_by_digest(spark):
    payload = b"picture"
    digest = hashlib.sha256(media.padded(payload)).hexdigest()
    source = f"<p>a</p><img data-digest='{digest}' alt=first><p>b</p><img src=missing.png alt=second>"
    pages = spark.createDataFrame([(1, source), (2, None), (1, source)], "page_id long, html string")
    found = media.interleave(pages, spark.createDataFrame([(bytearray(payload),), (None,)], "payload binary")).collect()
    ones = [r for r in found if r.page_id == 1]
    assert len(ones) == 2  # the page is there twice, each row with its own sequence
    for one in ones:
        assert [(i.position, i.kind, i.text, i.caption, i.media.n_bytes if i.media else None) for i in one["items"]] == [
            (0, "text", "a", None, None), (1, "media", None, "first", 7), (2, "text", "b", None, None), (3, "media", None, "second", None)
        ]
    assert next(r for r in found if r.page_id == 2)["items"] == []


def waterfill(sizes, weights, budget):
    capped, target = set(), {}
    while True:
        open_weight = sum(weights[s] for s in sizes if s not in capped)
        left = budget - sum(2 * sizes[s] for s in capped)
        target = {s: 2.0 * sizes[s] if s in capped else left * weights[s] / open_weight for s in sizes} if open_weight else {s: 2.0 * sizes[s] for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def check_mix(rows, texts):
    sizes = Counter()
    for _, t, s in texts:
        sizes[s] += len((t or "").encode().split())
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    target = waterfill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1 for s in sizes)


def test_mixing(docs, nothing, spark):
    check_mix(mixing.copies(mixing.sized(docs, F.lit(0))).collect(), TEXTS)
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.copies(mixing.sized(big, F.lit(0))).collect()
    check_mix(rows, [(r.doc_id, r.text, r.source) for r in big.collect()])
    again = {r.doc_id: r.copies for r in mixing.copies(mixing.sized(big.repartition(7), F.lit(0))).collect()}
    assert again == {r.doc_id: r.copies for r in rows}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in mixing.copies(mixing.sized(docs, F.lit(0))).collect())
    assert mixing.mix(nothing).count() == 0


def test_copies_follow_the_prefix_sums(docs, spark):
    """A plain walk: prefix sums of the expected copies from one offset, a copy for each integer crossed, the offset the best of the draws."""
    big = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "source")
    for df in (docs, big):
        rows = mixing.copies(mixing.sized(df, F.lit(0))).collect()
        order = sorted(mixing.sized(df, F.lit(0)).collect(), key=lambda r: (r.source is not None, r.source or "", r.size, r.doc_id, r.tie is not None, r.tie or 0))
        target = {r.source: (r.target, r.source_size) for r in rows}
        want = Counter()
        for source in target:
            mine = [r for r in order if r.source == source]
            seed = spark.range(1).select(F.pmod(F.xxhash64(F.lit(mixing.SEED), F.lit("\0null" if source is None else source)), F.lit(1 << 30))).first()[0] / (1 << 30)
            ratio = target[source][0] / target[source][1] if target[source][1] else 0.0
            draws = []
            for j in range(mixing.DRAWS):
                offset = (seed + j * mixing.GOLDEN) % 1.0
                taken = [math.floor(offset + ratio * (k + 1)) - math.floor(offset + ratio * k) for k in range(len(mine))]
                draws.append((abs(sum(n * r.size for n, r in zip(taken, mine, strict=True)) - target[source][0]), j, taken))
            for n, r in zip(min(draws)[2], mine, strict=True):
                want[source, r.doc_id, r.size, n] += 1
        assert Counter((r.source, r.doc_id, r.size, r.copies) for r in rows) == want


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark, docs, nothing, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, FOLDER)
        assert now.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, FOLDER).count() == 0
    found = corpus_pipeline.run(spark, FOLDER)
    ends = found.groupBy("sequence_id").agg(F.max(F.col("offset") + F.col("length")).alias("e"), F.sum("length").alias("n")).collect()
    assert all(r.e == r.n <= 2048 for r in ends) and len(ends) > 10


def test_stages_by_brute_force(spark, tmp_path):
    """The whole chain over a small corpus: what each stage keeps of its input, and the pieces that come out, by plain walks."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from tickforge.llm import alike

    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    with_line = F.when(F.col("doc_id") % 7 > 0, F.concat("text", F.lit("\nThe same line at the end of many pages."))).otherwise(F.col("text"))
    docs.withColumn("text", with_line).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels), F.col("doc_id")).collect()}
    now = {r.doc_id: r for r in docs.collect() if scores[r.doc_id] >= 0.5}
    assert len(now) < docs.count() == len(scores)
    # lines on at least 5 pages of their source and on more than a twentieth of them
    pages, seen = Counter(r.source for r in now.values()), Counter((r.source, x) for r in now.values() for x in {*(r.text or "").split("\n")} if x)
    gone = {k for k, n in seen.items() if n >= 5 and n > 0.05 * pages[k[0]]}
    texts = {i: None if r.text is None else "\n".join(x for x in r.text.split("\n") if (r.source, x) not in gone) for i, r in now.items()}
    assert any(texts[i] != r.text for i, r in now.items())
    # of texts that meet and are alike the smallest doc_id
    ids = sorted(texts)
    sketches = {i: alike.sketch(texts[i] or "") for i in ids}
    root = {i: i for i in ids}
    for i in ids:
        for j in ids:
            (x, least, mine), (y, others, theirs) = sketches[i], sketches[j]
            if j < i and root[i] != root[j] and (x == y or ({*mine.tolist()} & {*theirs.tolist()} and alike.alike(alike._hashes(least), alike._hashes(others)))):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    kept = {i for i in ids if root[i] == i}
    assert len(kept) < len(ids)
    left = spark.createDataFrame([(i, texts[i], now[i].source) for i in sorted(kept)], "doc_id long, text string, source string")
    taken = {r.doc_id: r.copies for r in mixing.copies(mixing.sized(left, F.lit(0))).collect()}
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for i, n in taken.items():
        tokens = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(tokens) % 2048 or 2048
        cuts = [0, *range(first, len(tokens) + 1, 2048)] if len(tokens) > 2048 else [0, len(tokens)]
        if n:
            want.update({(i, k, a, b - a, zlib.crc32(tokens[a:b].tobytes())): n for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))})
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    assert len({r.sequence_id for r in found}) <= math.ceil(sum(r.length for r in found) / 2048) * 1.02 + 1
