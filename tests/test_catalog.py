"""Every registered query against its SQL, on whole tables at the smallest scale."""

import os
import re

import pytest

import __spark_entry__ as entry
from workload.check import compare, connect

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def link():
    return connect(FOLDER)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) >= 60
    corpus = {name for name in QUERIES if name == "pipeline" or re.match(r"op\d+_", name)}
    assert set(QUERIES) - set(SQL) - corpus <= {
        "bottom_k_blake2b", "file_hashes", "ql_test", "wilcoxon_markers", "concordance_p_values", "variable_features", "pca",
    }


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, link, name):
    ok, text = compare(spark, FOLDER, link, QUERIES[name], SQL.get(name))
    assert ok, text


def test_entry(spark):
    assert entry.entry(spark).count() > 0
