from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest

from tallyforge.operators import close_model as cm

SOURCE = "source_row_id string, entity_code string, account_code string, transaction_date date, description string, debit decimal(18,2), credit decimal(18,2), status_code string"
MAP = "account_code string, account_name string, statement_group string, reconciliation_owner_role string, active string"
ENTRY = "entry_id string, account_code string, description string, debit decimal(18,2), credit decimal(18,2), source_reference string, preparation_status string"
EXCEPTION = "exception_id string, detected_in string, question string, authority_class string, owner_role string, due_date date, status string"
DAY, D = date(2024, 1, 31), Decimal


def good():
    return {
        "source": [("1", "E", "100", DAY, "a", D("5.00"), D("0.00"), "OPEN"), ("2", "E", "200", DAY, "b", D("0.00"), D("5.00"), "OPEN")],
        "map": [("100", "A", "G", "R", "Yes"), ("200", "B", "G", "R", "Yes")],
        "ledger": [("100", D("5.00"), D("1.00")), ("200", D("-5.00"), D("1.00"))],
        "entries": [],
        "exceptions": [],
        "identity": ("e", "p", "c", "r"),
        "capacity": 25,
    }


def table(spark, p):
    source, mapping = spark.createDataFrame(p["source"], SOURCE), spark.createDataFrame(p["map"], MAP)
    ledger = spark.createDataFrame(p["ledger"], "account string, ledger_balance decimal(18,2), threshold decimal(18,2)")
    by_account = cm.accounts(source)
    recon = cm.reconcile_ledger(by_account, ledger)
    assert sorted(recon.collect()) == sorted(cm.reconcile_ledger(source, ledger).collect())
    t = cm.controls(by_account, mapping, recon, spark.createDataFrame(p["entries"], ENTRY), spark.createDataFrame(p["exceptions"], EXCEPTION), p["identity"], {"source": p["capacity"], "map": 25})
    rows = {r.position: r for r in t.collect()}
    return {k: r.result for k, r in rows.items()}, rows, cm.model_status(t).first().status


def test_minimal_valid_population(spark):
    results, _, status = table(spark, good())
    assert results == {1: "PASS", 2: "PASS", 3: "PASS", 4: "PASS", 5: "PASS", 6: "NOT APPLICABLE", 7: "PASS", 8: "PASS", 9: "PASS"} and status == "PASS"


@pytest.mark.parametrize(
    ("part", "change", "failing"),
    [
        ("source", lambda s: [s[0][:4] + (None,) + s[0][5:], s[1]], {1}),
        ("source", lambda s: [s[0], s[1][:6] + (D("4.00"),) + s[1][7:]], {3}),
        ("map", lambda m: m[:1], {4, 5}),
        ("map", lambda m: [*m, m[0]], {4, 5}),
        ("ledger", lambda x: [*x, ("999", D(0), D(1))], {5}),
        ("ledger", lambda x: [("100", D("50.00"), D("1.00")), x[1]], {5}),
        ("entries", lambda _: [("J1", "100", "x", D("1.00"), D("1.00"), None, "Draft")], {6}),
        ("entries", lambda _: [("J1", "100", "x", D("1.00"), D("2.00"), "s", "Draft")], {6}),
        ("exceptions", lambda _: [("X", "s", "q", "rumour", "r", DAY, "Resolved")], {7}),
        ("exceptions", lambda _: [("X", "s", "q", "supporting", "r", DAY, "Open")], {7}),
        ("capacity", lambda _: 1, {9}),
    ],
)
def test_one_defect_fails_its_control(spark, part, change, failing):
    p = good()
    p[part] = change(p[part])
    results, rows, status = table(spark, p)
    assert {k for k, v in results.items() if v == "FAIL"} == failing and status == "FAIL"
    assert all(rows[k].delta != 0 for k in failing)


def test_not_ready(spark):
    p = good() | {"ledger": [], "map": [], "identity": ("e", "{{period}}", "c", "r")}
    results, _, status = table(spark, p)
    assert results[4] == results[5] == results[7] == results[8] == "NOT READY" and results[1] == "PASS" and status == "NOT READY"
    results, _, _ = table(spark, good() | {"source": []})
    assert results[1] == results[2] == results[3] == "NOT READY"


def test_statuses(spark):
    source = spark.createDataFrame(good()["source"], SOURCE)
    ledger = spark.createDataFrame([("100", D("4.50"), D("0.50")), ("200", None, D(1)), ("300", D(9), D(1)), ("", D(1), D(1))], "account string, ledger_balance decimal(18,2), threshold decimal(18,2)")
    got = {r.account: (r.source_net, r.status) for r in cm.reconcile_ledger(source, ledger).collect()}
    assert got == {"100": (D(5), "PASS"), "200": (D(-5), "NOT READY"), "300": (D(0), "REVIEW"), "": (D(0), None)}


def test_ledger_match(spark):
    p = good()
    mk = lambda led, m: {tuple(r) for r in cm.ledger_match(spark.createDataFrame(p["source"], SOURCE), spark.createDataFrame(m, MAP), spark.createDataFrame(led, "account string, ledger_balance decimal(18,2), threshold decimal(18,2)")).collect()}
    assert mk(p["ledger"], p["map"]) == set()
    assert mk([("100", D(1), None), ("300", D(1), None)], p["map"][:1] * 2) == {("100", "balance"), ("200", "not_in_ledger"), ("300", "not_in_source"), ("100", "duplicate_map"), ("200", "unmapped")}
