from __future__ import annotations

import csv
import io
import re
from datetime import date
from decimal import Context, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.operators import malformed


def brute(line: str | None) -> set[str]:
    """The rules as a state machine over characters."""
    if line is None:
        return {"column_count"}
    fields, value, state = [], "", "start"
    for c in line:
        if state == "start":
            if c == '"':
                state = "quoted"
            elif c == ",":
                fields.append(value)
                value = ""
            else:
                value, state = value + c, "plain"
        elif state == "plain":
            if c == '"':
                return {"quoting"}
            if c == ",":
                fields.append(value)
                value, state = "", "start"
            else:
                value += c
        elif state == "quoted":
            if c == '"':
                state = "closed"
            else:
                value += c
        elif c == '"':
            value, state = value + c, "quoted"
        elif c == ",":
            fields.append(value)
            value, state = "", "start"
        else:
            return {"quoting"}
    if state == "quoted":
        return {"quoting"}
    fields.append(value)
    if len(fields) != 8:
        return {"column_count"}
    bad = set()
    try:
        if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", fields[3]):
            raise ValueError
        date.fromisoformat(fields[3])
    except ValueError:
        bad.add("transaction_date")
    for i, name in ((5, "debit"), (6, "credit")):
        if not re.fullmatch(r"-?([0-9]+\.?[0-9]*|\.[0-9]+)", fields[i]):
            bad.add(name)
    return bad


def reasons(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, raw_line string")
    got = {i: set() for i in range(len(lines))}
    for r in malformed.rejected(df, "raw_line").collect():
        got[r.line_id].add(r.reason)
    return [got[i] for i in range(len(lines))]


GOOD = "R1,E1,1000,2024-02-29,text,1.00,0.00,POSTED"
CASES = [
    GOOD,
    None,
    "",
    "   ",
    GOOD + ",",
    'R1,E1,1000,2024-02-29,"a ""b"", c",1.00,0.00,POSTED',
    'R1,E1,1000,2024-02-29,"a\nb",1.,-.5,POSTED',
    "R1,E1,1000,2024-02-29,a\nb,1.,-.5,POSTED",
    'R1,E1,1000,2024-02-29,12" pipe,1.00,0.00,POSTED',
    'R1,E1,1000,2024-02-29,"open,1.00,0.00,POSTED',
    'R1,E1,1000,2024-02-29,"shut"x,1.00,0.00,POSTED',
    "R1,E1,1000,2023-02-29,t,1e3,+1,POSTED",
    "R1,E1,1000,0000-01-01,t,1,٣,POSTED",
    "R1,E1,1000,2024-01-01\n,t, 1,1 ,POSTED",
    "R1,E1,1000,,t,,.,POSTED",
    "R1,E1,1000,2024-01-01,%2C%25,1,1,POSTED",
    'R1,E1,1000,2024-01-01,"%2C,%25",1,1,"POSTED"',
    '""""",,,,,,,',
    '"""",,,2024-01-01,,1,1,',
    "R1,E1,1000,2024-01-01," + "x" * 300_000 + ",1,1,POSTED",
    "," * 30_000,
    '"' * 20_001,
    "R1,E1,1000,2024-01-01,t,123456789012345678901234567890123456789012,1,POSTED",
    "R1,E1,1000,2024-01-01,\0,1,1,POSTED",
]


def test_reasons_follow_the_rules(spark):
    for line, got in zip(CASES, reasons(spark, CASES), strict=True):
        assert got == brute(line), repr(line)[:80]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(['"', '""', ",", "a", " ", "\n", "\r", "2024-01-31", "1.5", "-", "%2C", "\\"]), max_size=22).map("".join), min_size=1, max_size=40))
def test_any_lines(spark, lines):
    assert reasons(spark, lines) == [brute(x) for x in lines]


def test_no_amount_turns_into_another(spark):
    amounts = ["1.20", "1.2000", "1.239", "-.5", "5.", "0" * 40 + "7.10", "1" * 16 + ".99", "1" * 17, "-" + "9" * 45, ".001", "-0", "0.000"]
    lines = [(i, f"R,E,A,2024-01-01,t,{a},1,POSTED", "x") for i, a in enumerate(amounts)]
    rows = {r.line_id: r for r in malformed.loaded(spark.createDataFrame(lines, "line_id long, raw_line string, debit_text string"), "raw_line").collect()}
    for i, a in enumerate(amounts):
        exact = Decimal(a)
        cents = exact.quantize(Decimal("0.01"), context=Context(prec=60))
        assert rows[i].credit_text is None and rows[i].in_debit_text == "x"
        if cents == exact and abs(exact) < 10**16:
            assert rows[i].debit == exact and rows[i].debit_text is None
        else:
            assert rows[i].debit is None and rows[i].debit_text == a


def test_loaded_values_equal_a_strict_parser(spark):
    lines = [x for x in CASES if x is not None and not brute(x) and "\0" not in x and len(x) < 1000 and "a\nb,1" not in x]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, raw_line string")
    rows = {r.line_id: r for r in malformed.loaded(df, "raw_line").collect()}
    assert len(rows) == len(lines)
    for i, line in enumerate(lines):
        want = next(csv.reader(io.StringIO(line, newline=""), strict=True))
        assert [rows[i].source_row_id, rows[i].description, rows[i].status_code] == [want[0], want[4], want[7]]
        assert rows[i].transaction_date.isoformat() == want[3]


def test_amount_that_does_not_fit_loads_without_value(spark):
    df = spark.createDataFrame([(CASES[-2],)], "raw_line string")
    row = malformed.classify(df, "raw_line").first()
    assert row.reasons == [] and row.debit is None and row.credit == 1 and row.raw == CASES[-2]


def test_clashing_columns_and_empty_input(spark):
    df = spark.createDataFrame([(7, "mine", GOOD, "x")], "debit int, reasons string, raw_line string, other string")
    row = malformed.classify(df, "raw_line").first()
    assert row.in_debit == 7 and row.in_reasons == "mine" and row.other == "x" and row.debit == 1
    assert malformed.rejected(df.limit(0), "raw_line").count() == 0


@pytest.mark.parametrize("copies", [1, 3])
def test_repeated_lines_repeat(spark, copies):
    df = spark.createDataFrame([(1, "")] * copies, "line_id long, raw_line string")
    assert malformed.rejected(df, "raw_line").count() == copies
