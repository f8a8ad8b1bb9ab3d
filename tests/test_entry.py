"""The entry file, with and without the corpus subpackage."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry_counts_every_vector(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert [r.n for r in sorted(rows, key=lambda r: r.cluster)] == [111, 135, 145, 109]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_works_without_the_subpackage():
    code = "import sys; sys.modules['quern.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q), q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
