"""Rows without doc_id, text, language or source go through every operator."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.test_dedup import plain_components
from tickforge.llm import op01_token_files, op02_quality, op03_media, op04_winnowing, op05_simhash, op06_line_dedup, op07_packing, op08_lattice_lm, op09_mixing, op10_token_counts, op11_language_id


@pytest.fixture(scope="module")
def holes(spark):
    rows = [(None, None, None, None, None), (None, "some text here", None, None, 3), (1, None, "en", "a", 0), (2, "some other text with words", None, "a", 26), (None, "far away and different words altogether", None, "b", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_every_operator_keeps_the_rows(holes, spark):
    assert op01_token_files.read_ids(op01_token_files.write_ids(holes)).count() == 5
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1)], "doc_id long, quality int")
    assert op02_quality.score(holes, op02_quality.fit(holes, labels), F.col("doc_id")).count() == 5
    assert op03_media.described(holes).count() == 5
    assert op04_winnowing.compared(holes).count() == 5
    assert op05_simhash.near_duplicates(holes).count() == 5
    assert op06_line_dedup.dedup(holes).count() == 5
    assert op07_packing.pack(holes).count() == 5
    assert op08_lattice_lm.scores(holes, F.coalesce(F.col("doc_id") == 2, F.lit(False))).count() == 5
    assert op09_mixing.copies(op09_mixing.sized(holes, F.lit(0))).count() == 5
    assert op10_token_counts.histogram(op10_token_counts.lengths(holes)).agg(F.sum("n_docs")).first()[0] == 5
    assert op11_language_id.predict(holes, op11_language_id.fit(holes), F.col("doc_id")).count() == 5


def test_keep_one_without_ids(holes):
    """Rows without id that are nobody's near-duplicates all stay."""
    kept = [(r.doc_id, r.text) for r in op05_simhash.keep_one(holes).collect()]
    assert sorted(kept, key=repr) == sorted([(1, None), (2, "some other text with words"), (None, "some text here"), (None, "far away and different words altogether")], key=repr)


def test_one_row_of_each_component_stays(spark):
    """No text is lost to another that is no near-duplicate of it: not for want of an id, nor for sharing one."""
    near = "one two three four five six seven eight"
    rows = [(None, "some text here"), (None, "far away and different words altogether"), (None, None), (1, ""), (5, "alone under this number"), (5, near), (3, near), (None, near), (None, "some text here")]
    kept = op05_simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, ""), (3, near), (5, "alone under this number"), (None, "far away and different words altogether"), (None, "some text here")]
    assert sorted(map(tuple, kept), key=repr) == sorted(want, key=repr)


def test_kept_rows_by_brute_force(spark):
    """Random ids (few, so that they clash, or none) and texts that share most of their words."""
    draw = random.Random(3)
    texts = [" ".join(draw.choices("abcdefghij", k=draw.randrange(1, 9))) for _ in range(30)]
    rows = [(draw.choice([None, *range(12)]), draw.choice(texts), k) for k in range(160)]
    fps = [op05_simhash.fingerprint(t) & (2**64 - 1) for _, t, _ in rows]
    roots = plain_components(fps)
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(f"{'none' if r[0] is None else r[0]}:{r[1]}".encode()).digest(), r[2])
    want = [min((r for r, x in zip(rows, roots, strict=True) if x == root), key=key) for root in set(roots)]
    got = op05_simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(want) > 10
