"""Language filters: held-out accuracy, and filters and counts by brute force."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.conftest import TEXTS
from tickforge.llm import op11_language_id as lang

FOLDER = f"{DATA}/sf0.01"


def plain_grams(words, n):
    """n-grams as text, by their definition."""
    padded = [f" {w} " for w in words]
    return [p[i : i + n] for p in padded for i in range(len(p) - n + 1) if n > 1 or p[i] != " "]


def test_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = lang.query(spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    for x in {r.lang for r in held}:
        assert np.mean([r.lang_pred == x for r in held if r.lang == x]) > 0.97


def test_hashes_tell_ngrams_apart():
    words = ["the", "a", "größe", "東京", "the"]
    for n in range(1, lang.ORDERS + 1):
        hashes, of = lang.ngrams(words, n)
        want = plain_grams(words, n)
        assert len(hashes) == len(want) and len(set(hashes.tolist())) == len(set(want))
        assert of.tolist() == [k for k, w in enumerate(words) for _ in plain_grams([w], n)]
        assert len({*zip(hashes.tolist(), want, strict=True)}) == len(set(want))


def test_counts_by_brute_force(spark):
    rows = [("x", "The the cat. The cat²"), ("x", "Ärger 12"), ("y", "cat"), (None, "dog"), ("y", None)]
    found = lang.counted(spark.createDataFrame(rows, "lang string, text string").repartition(3)).collect()
    want = Counter()
    for x, t in rows:
        if x and t:
            for n in range(1, lang.ORDERS + 1):
                for w in lang.words_of(t):
                    want.update((x, n, int(h)) for h in lang.ngrams([w], n)[0].view(np.int64))
    assert {(r.lang, r.n, r.gram): r["count"] for r in found} == want


def test_filters_lose_nothing_and_correct_for_what_they_add():
    """Every n-gram is found at all its levels; evidence of n-grams that aren't held is zero in the mean."""
    draw = np.random.default_rng(3)
    grams, other = draw.integers(0, 2**63, 9000, np.uint64), draw.integers(0, 2**63, 200_000, np.uint64)
    of, levels = draw.integers(0, 3, 9000), draw.integers(1, 9, 9000)
    f = lang.build(["a", "b", "c"], of, grams, levels)
    bits = f.found(grams)[np.arange(9000), of]
    assert ((bits & (1 << levels) - 1) == (1 << levels) - 1).all()
    crowded = lang.Filters(f.languages, *lang.build(["a", "b", "c"], of, grams, levels)[1:])
    missed = crowded.found(other)
    assert (missed != 0).any()
    for k in range(3):
        mean, spread = crowded.worth[k][missed[:, k]].mean(), crowded.worth[k][missed[:, k]].std() / len(other) ** 0.5
        assert abs(mean) < 6 * spread + 1e-9
        assert np.isclose(crowded.worth[k][255], lang.LEVELS)


def test_edges(docs, nothing, spark):
    labelled = docs.withColumn("lang", F.when(F.col("source") == "a", "aa").when(F.col("source") == "b", "").otherwise(None))
    filters = lang.fit(labelled)
    assert filters.languages == ["", "aa"]
    found = {r.doc_id: r for r in lang.predict(docs, filters, F.col("doc_id"), F.col("row")).collect()}
    assert len(found) == len({t[0] for t in TEXTS}) and all(r.row == 1 for r in found.values())
    assert {i for i, r in found.items() if r.lang_pred == lang.NONE} == {2, 3, 4, 10} and all(found[i].score == 0 for i in (2, 3, 4, 10))
    assert found[1].lang_pred == "aa" and found[5].lang_pred == ""
    odd = spark.createDataFrame([(1, "²³ 12 _"), (2, "х" * 200_000), (3, "ok")], "doc_id long, text string")
    assert [r.lang_pred for r in lang.predict(odd, filters, F.col("doc_id")).orderBy("doc_id").collect()][0] == lang.NONE
    assert {r.lang_pred for r in lang.predict(docs, lang.fit(nothing), F.col("doc_id")).collect()} == {lang.NONE}
    assert lang.predict(nothing, filters, F.col("doc_id")).count() == 0


def test_workers_forget_and_long_texts_go_in_parts(docs, monkeypatch, spark):
    filters = lang.fit(docs)
    want = sorted(lang.predict(docs, filters, F.col("doc_id")).collect())
    code = lang.predict.__globals__["HELD"]
    try:
        lang.predict.__globals__["HELD"] = 50
        assert [(r.doc_id, r.lang_pred) for r in sorted(lang.predict(docs, filters, F.col("doc_id")).collect())] == [(r.doc_id, r.lang_pred) for r in want]
    finally:
        lang.predict.__globals__["HELD"] = code
