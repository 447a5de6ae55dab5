import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_core_imports_without_the_llm_subpackage():
    code = "import sys; sys.modules['turnmill.llm'] = None; import __spark_entry__ as e; assert not any(n.startswith('p1_') for n in e.queries()); assert 'p3_found' in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
