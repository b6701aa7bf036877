import pytest

#: Clashing names that the operators use inside or give out.
CLASH = {"row": 1, "idx": 2, "shard": 3, "rank": 4, "size": 5, "target": 6, "copies": 7, "fp": 8, "root": 9, "host": 10, "hashes": 11, "kept": 12, "start": 13, "length": 14, "score": 15, "range": 16, "guest": 17, "word": 18, "block": 19, "label": 20, "digest": 21, "item": 22, "n": 23, "held_out": 24}
#: Names that begin as the operators' own do, and one with a dot.
CLASH |= {c: 25 + k for k, c in enumerate(("__key", "__n", "__null", "__first", "__base", "__class", "__held", "__source", "__draw", "__target", "__all", "__at", "__block", "__d", "__docs", "__down", "__f", "__host", "__known", "__line", "__lows", "__page", "__row", "__t", "__text", "__tokens", "key", "node", "number", "lang_pred", "least", "variants", "first", "tie", "a.b"))}
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [
    (1, "the cat sat on the mat, and the dog ran.\nshared line\nend", "a"), (2, None, "a"), (3, "", "b"), (4, "   \n\t ", "b"),
    (5, LONG, "b"), (6, "one", None), (7, "Ärger über Größe — naïve café 東京", None), (8, "the cat sat on the mat, and the dog ran.\nshared line\nend", "a"),
    (8, "the cat sat on the mat, and the dog ran.\nshared line\nend", "a"), (9, "x" * 5000, "c"), (10, "\n\n\n", "c"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty, blank, long and repeated rows, a missing source, and columns whose names clash."""
    rows = [(i, t, "en", s, len(t or ""), *CLASH.values()) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASH)).repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    """The smallest documents table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
