"""The entry module registers what can be imported, and everything else stays."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from checks.queries import all_queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("hidden", ["concilia.llm", "corpus_pipeline", "ahocorasick", "xxhash"])
def test_the_entry_imports_without(hidden):
    code = (
        f"import sys, warnings; sys.modules[{hidden!r}] = None; warnings.simplefilter('ignore'); import __spark_entry__ as e; "
        "assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert set(all_queries()) <= set(out.stdout.split())


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
