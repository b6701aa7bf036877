"""The driver's entry points, with and without the optional subpackage."""

import subprocess
import sys

import pytest


def test_every_query_is_callable():
    import __spark_entry__

    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries) and all(map(callable, queries.values()))


@pytest.mark.parametrize("gone", ["corpus_pipeline", "tickforge.llm"])
def test_entry_works_without_the_subpackage(gone):
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {gone!r} or name.startswith({gone!r} + "."):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "backtest_metrics" in e.queries() and not [q for q in e.queries() if q.startswith("op") or q == "pipeline"]
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
