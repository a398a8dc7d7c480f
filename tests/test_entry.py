"""The driver's entry module."""

import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).parent.parent


@pytest.mark.parametrize("missing", ["public_tokenizers", "graphloom.llm", "corpus_pipeline"])
def test_a_missing_part_or_library_leaves_the_rest(missing):
    code = f"""
import sys, warnings
sys.modules[{missing!r}] = None
warnings.simplefilter("error", ResourceWarning)
import __spark_entry__ as entry
from graphloom import catalog
found, sql = entry.queries(), entry.oracle_sql()
assert set(catalog.QUERIES) <= set(found) and set(catalog.ORACLES) <= set(sql) and set(sql) <= set(found)
assert "pipeline" not in found
assert {missing == "corpus_pipeline"} or not any(n.startswith("op") and n[2].isdigit() for n in found)
"""
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=TOP, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
