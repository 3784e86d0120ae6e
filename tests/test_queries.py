"""Every registered query against its SQL on the smallest driver tables; those without SQL must run."""

import pytest
from oracle import compare

from siloflow.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, sf_dir, name):
    compare(spark, sf_dir, registry.QUERIES[name], registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "lang", "n_spans", "redacted"]
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_does_without_llm(tmp_path):
    """With the corpus operators and the pipeline gone, the entry imports and has the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parent.parent
    shutil.copytree(top / "siloflow", tmp_path / "siloflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
