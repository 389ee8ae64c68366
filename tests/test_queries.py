"""Every query beside its SQL on the smallest tables, and plans that must stay as they are."""

from __future__ import annotations

import os
import re

import pytest
from oracle import compared

from tallyforge.plans import library, packages, records, reference

QUERIES = records.QUERIES | reference.QUERIES | library.QUERIES | packages.QUERIES
SQL = records.SQL | reference.SQL | library.SQL | packages.SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    assert name in SQL, "a query that SQL cannot express needs a test of its own"
    ours, theirs, rows, expected = compared(spark, folder, QUERIES[name], SQL[name])
    assert ours == theirs
    assert rows == expected


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_malformed_lines_are_read_in_one_pass(spark, folder):
    text = plan(records.p1_found(spark, folder).select("line_id"))
    assert "Python" not in text
    assert "ReadSchema: struct<line_id:bigint,raw_line:string>" in text


def test_no_products_of_tables(spark, folder):
    for name in ("p1_found", "p2_found", "p3_found", "p5_found", "reconcile_keys", "recommend"):
        assert "CartesianProduct" not in plan(QUERIES[name](spark, folder)), name


def test_the_rest_does_not_import_the_text_subpackage():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tallyforge")
    for at, _, names in os.walk(root):
        if os.path.basename(at) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(at, n)) as f:
                    assert not re.search(r"^\s*(from|import) tallyforge\.llm", f.read(), re.M), n
