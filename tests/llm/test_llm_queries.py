"""The registered queries: names, the one with SQL against it, and what the entry does without the package."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from check_queries import connect, difference

SF = "/root/testdata/sf0.001"
ROOT = Path(entry.__file__).resolve().parent


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))


@pytest.mark.skipif(not Path(SF).exists(), reason="the given tables are not here")
def test_lines_against_sql(spark):
    name = "op4_line_dedup"
    assert difference(spark, connect(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_entry_without_the_package():
    code = (
        "import sys; sys.modules['urlshift.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; assert e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
