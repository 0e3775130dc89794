"""The driver's entry points, without a session and without the training-data subpackage."""

import subprocess
import sys

from .conftest import ROOT

NAMES = "import sys; sys.path.insert(0, {root!r}); {before}import __spark_entry__ as e; q = e.queries(); print(len(q), set(e.oracle_sql()) <= set(q), 'pipeline' in q)"


def names(before=""):
    said = subprocess.run([sys.executable, "-c", NAMES.format(root=ROOT, before=before)], capture_output=True, text=True, timeout=120, check=True)
    return said.stdout.split()


def test_queries_are_listed_without_a_session():
    count, known, _ = names()
    assert int(count) > 90 and known == "True"


def test_engine_stands_alone():
    """Where the subpackage cannot be imported, all queries but its own are there."""
    count, known, pipeline = names("sys.modules['corpusgraph.llm'] = None; ")
    assert int(count) > 90 and known == "True" and pipeline == "False"
