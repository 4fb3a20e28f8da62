import os
import subprocess
import sys
from pathlib import Path

import pytest

from sievewright.plans.queries import ORACLES, QUERIES
from tests.oracle import SF, same

here = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


@here
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


@here
def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["pattern", "n"] and df.count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_works_without_the_corpus_operators(tmp_path):
    """A copy without those folders, but with the pipeline's file, imports and has all other queries."""
    repo = Path(__file__).resolve().parent.parent
    (tmp_path / "sievewright").mkdir()
    for p in (repo / "sievewright").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "sievewright" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(repo / "__spark_entry__.py")
    (tmp_path / "corpus_pipeline.py").symlink_to(repo / "corpus_pipeline.py")
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import sievewright; sievewright.__path__ = [{str(tmp_path / 'sievewright')!r}]; import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""})
    assert out.stdout.strip() == str(len(QUERIES)), out.stderr
