"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from wattaudit.plans.queries import QUERIES
from wattaudit.sources.views import TABLES

from conftest import SF


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return "NaN" if math.isnan(v) else round(float(v), 9) + 0.0
    return v


def bag(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in data)


def test_every_query_has_its_sql():
    assert set(QUERIES) <= set(oracle_sql())
    assert set(QUERIES) | set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = queries()[name](spark, SF)
    got = bag(df.columns, df.collect())
    res = db.execute(oracle_sql()[name])
    names = [c[0] for c in res.description]
    want = bag(names, res.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert got - want == Counter() and want - got == Counter()


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_stay_in_the_engine(spark, name):
    shown = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in shown and "NestedLoop" not in shown
    assert "BatchEvalPython" not in shown and ("ArrowEvalPython" not in shown or name in PYTHON)
    assert "SinglePartition" not in shown or name in ONE_RESULT_ROW or "Limit" in shown or "TakeOrdered" in shown


# A grand total or scalar is one row by nature; its parts are summed before that exchange.
ONE_RESULT_ROW = {"a8_list_documents", "e6_report_totals", "e7_savings_totals"}
# Python where Spark has no built-in: the full Unicode normal form, and the matching-block ratio of two names.
PYTHON = {"n1_names", "b15_doc_diagnostics", "e13_canonical_customer", "e13_account_customers", "l1_bill_rows", "a7_append_bills"}

HIDDEN = """
import sys
sys.modules["{0}"] = None
import __spark_entry__ as entry
from wattaudit.plans.queries import QUERIES
assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) >= set(QUERIES)
"""


@pytest.mark.parametrize("missing", ["xxhash", "corpus_pipeline", "wattaudit.llm"])
def test_entry_without_the_corpus_operators(missing):
    """What the corpus operators need, or they themselves, can be absent."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", HIDDEN.format(missing)], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
