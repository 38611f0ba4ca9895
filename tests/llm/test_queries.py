"""Registered queries against their SQL, and the rest of the library without this part."""

import os
import subprocess
import sys

import pytest
from compare import differences, oracle

from placeweave.llm import ORACLES, QUERIES

SF_DIR = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    found = differences(QUERIES[name](spark, SF_DIR), oracle(SF_DIR), ORACLES[name])
    assert not [x for x in found if "array" not in x], found


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_nothing_else_imports_this_part():
    code = ("import sys; sys.modules['placeweave.llm'] = None; import __spark_entry__ as e; "
            "assert 'pipeline' not in e.queries() and len(e.queries()) > 70 and len(e.oracle_sql()) > 70")
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
