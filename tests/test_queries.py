import os
import shutil
import subprocess
import sys

import pytest

from gapseries.plans import chosen, domain, kept, masked, more, oracles, whole  # noqa: F401
from gapseries.plans.queries import QUERIES

from compare import TABLES, assert_same

ORACLES = oracles.ORACLES | more.ORACLES
#: Columns of feature_set_full, made by the same code.
SUBSETS = {f"feature_set_{x}" for x in ("relative", "invariant", "radar", "optical")}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SUBSETS))
def test_query_equals_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, TABLES).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [["corpus_pipeline.py", "gapseries/llm"], ["gapseries/llm"], ["corpus_pipeline.py"]])
def test_entry_imports_without_optional_parts(tmp_path, gone):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for part in ("__spark_entry__.py", "corpus_pipeline.py", "gapseries"):
        if os.path.exists(f"{root}/{part}"):
            copy = shutil.copytree if os.path.isdir(f"{root}/{part}") else shutil.copy
            copy(f"{root}/{part}", tmp_path / part)
    for part in gone:
        path = tmp_path / part
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    said = "import __spark_entry__ as e; print(sum(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", said], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == ["0", "False", str(len(ORACLES))]
