"""Whitening against numpy's eigenvectors and exact whole numbers."""

import numpy as np

from tests.conftest import DATA
from tickforge.llm import op13_whitening as white

NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def compare(rows, vectors):
    """``vectors``: usable ones by vec_id (repeated ids keep all)."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in vectors], dtype=object)
    fit = np.array(sorted({tuple(v) for v in x}), dtype=object)
    n, sums = len(fit), fit.sum(0)
    centred = (n * fit - sums).astype(float) / n
    cov = centred.T @ centred / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    k = min(white.COMPONENTS, int((e > 1e-10 * e[0]).sum()))
    exact = ((n * x - sums) ** 2).sum(1)
    want = ((n * x - sums).astype(float) / n) @ q[:, :k] / np.sqrt(e[:k])
    order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0], exact[i]))
    rows = sorted(rows, key=lambda r: (r.vec_id, r.deviation, r.component))
    assert len(rows) == len(vectors) * k
    got = np.array([r.whitened for r in rows]).reshape(-1, k)
    assert [r.vec_id for r in rows[::k]] == [vectors[i][0] for i in order]
    assert [r.deviation for r in rows[::k]] == [exact[i] for i in order] and {r.n for r in rows} == {n}
    sign = np.sign((got * want[order]).sum(0))
    assert np.abs(got - want[order] * sign).max() < 1e-8
    assert np.allclose([r.explained for r in rows[:k]], e[:k] / np.trace(cov), rtol=1e-9)
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


def test_query(spark):
    folder = f"{DATA}/sf0.001"
    source = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    found = white.query(spark, folder)
    assert found.columns == NAMES
    compare(found.collect(), [(r.vec_id, r.embedding) for r in source])


def test_holes_copies_and_clashing_columns(spark):
    draw = np.random.default_rng(2)
    good = [(i, draw.normal(0, 1 + 5 * (i % 2), 5).tolist()) for i in range(40)]
    good += [(100 + i, good[7][1]) for i in range(90)] + [(3, good[8][1])]  # one vector makes up most rows, an id repeats
    bad = [(500, None), (501, [1.0, None, 2.0, 3.0, 4.0]), (502, [1.0, float("nan"), 2.0, 3.0, 4.0]), (503, [float("inf"), 1.0, 2.0, 3.0, 4.0]), (504, [1.0, 2.0]), (505, [])]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in good + bad], "vec_id long, embedding array<double>, x int, n int, component int").repartition(6)
    x = white.whole(df)
    compare(white.whitened(x, white.fit(x)).collect(), good)


def test_fewer_dimensions_than_vary(spark):
    """A dimension that repeats another, and one that never varies, give no component."""
    draw = np.random.default_rng(4)
    rows = [(i, [float(a), float(b), float(a), 7.0]) for i, (a, b) in enumerate(draw.normal(0, 3, (30, 2)))]
    x = white.whole(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = white.whitened(x, white.fit(x)).collect()
    assert {r.component for r in found} == {1, 2}
    compare(found, rows)


def test_nothing_varies(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)], [(1, None)]):
        x = white.whole(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        found = white.whitened(x, white.fit(x))
        assert found.columns == NAMES and found.count() == 0


def test_deviations_beyond_63_bits():
    x = np.array([[2**40, 5], [3, 2**41]], np.int64)
    assert white.deviations(x, 10**6, [1, 1], [0, 3]) == [((2**40 - 1) * 10**6) ** 2 + (4 * 10**6 - 3) ** 2, (2 * 10**6) ** 2 + ((2**41 - 1) * 10**6 - 3) ** 2]
