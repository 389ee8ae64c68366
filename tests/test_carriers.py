from __future__ import annotations

import pytest

from tallyforge.operators import carriers as c
from tallyforge.operators import findings, integrity
from tallyforge.sources import carriers as files

GOOD = "id string, entity string, account string, status string, resolution string"
ROWS = [("1", "E1", "100", "Open", ""), ("2", "E2", "200", "Resolved", "R-1"), ("3", "E2", "300", "Retained", "R-2")]
LIFE = c.Lifecycle("status", "resolution", ("Open", "Resolved", "Retained"), ("Open", "Resolved"), ("Resolved", "Retained"), ("Open",))
RULES = c.Rules(("id", "account"), 3, "id", {"entity": 2, "account": 3}, LIFE)


def rules(spark, rows=ROWS, rule=RULES, schema=GOOD):
    return sorted({r.rule for r in c.audit(spark.createDataFrame(rows, schema), "x", rule).collect()})


def test_a_good_carrier_has_no_findings(spark):
    assert rules(spark) == []


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        (ROWS[:2], ["too_few_rows", "too_few_values"]),
        ([*ROWS, (" 1 ", "E1", "100", "Open", None)], ["id_not_unique"]),
        ([*ROWS, ROWS[0]], ["duplicate_row", "id_not_unique"]),
        ([*ROWS, (None, "E3", "400", "Open", None)], ["id_not_unique"]),
        ([*ROWS, ("4", "E {{x}}", "400", "Open", None)], ["unresolved_token"]),
        ([*ROWS, ("4", "E", "400", "Closed", None)], ["status_not_allowed"]),
        ([*ROWS, ("4", "E", "400", "Open", "R-9")], ["resolution_forbidden"]),
        ([*ROWS, ("4", "E", "400", "Resolved", " ")], ["resolution_required"]),
        (ROWS[1:] + [("4", "E", "400", "Retained", "R")], ["status_missing"]),
    ],
)
def test_one_defect_one_finding(spark, rows, expected):
    assert rules(spark, rows) == expected


def test_missing_columns(spark):
    rule = c.Rules(("id", "owner"), 1, "key", {"zone": 1}, c.Lifecycle("state", "resolution", ("Open",)))
    assert rules(spark, rule=rule) == ["column_missing", "status_not_allowed"]
    assert "too_few_rows" in rules(spark, [], RULES)


def test_reconciliations(spark):
    left, right = spark.createDataFrame([("a ",), ("b",), (None,)], "k string"), spark.createDataFrame([("a",), ("c",)], "k string")
    at = lambda l, r, how, lc="k": sorted({(x.rule, x.detail) for x in c.reconcile(l, lc, r, "k", how, "n").collect()})
    assert at(left, right, "equal") == [("keys_not_equal", "left: b"), ("keys_not_equal", "right: c")]
    assert at(left, right, "left_subset_of_right") == [("keys_not_left_subset_of_right", "left: b")]
    assert at(left, right, "similar") == [("unknown_relationship", "similar")]
    assert at(left, right, "equal", "zzz") == [("column_missing", "zzz")]
    assert ("empty_operand", "left") in at(left.filter("k is null"), right, "equal")
    assert findings.status(c.reconcile(left, "k", left, "k", "equal", "n")).first().status == "PASS"


def test_strict_files(spark, tmp_path):
    (tmp_path / "good.csv").write_bytes(b'\xef\xbb\xbfid,text\n1,"a ""b"",\nc"\n\n2,x\n')
    (tmp_path / "wide.csv").write_text("a,b\n1,2,3\n4\n")
    (tmp_path / "open.csv").write_text('a,b\n1,"x\n')
    (tmp_path / "latin.csv").write_bytes("a,b\n1,é\n".encode("latin-1"))
    (tmp_path / "heads.csv").write_text("a,a\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bare.csv").write_text("\n")
    read = files.files(spark, str(tmp_path), "*.csv")
    rows = files.strict_rows(read)
    name = lambda p: p.rpartition("/")[2]
    problems = sorted({(name(r.path), r.problem) for r in rows.filter("problem is not null").collect()})
    assert problems == [("bare.csv", "no_rows"), ("latin.csv", "unreadable"), ("open.csv", "unreadable"), ("wide.csv", "width")]
    good = files.named(rows, ["id", "text", "other"]).filter("path like '%good.csv'").orderBy("ordinal").collect()
    assert [(r.ordinal, r.id, r.text, r.other) for r in good] == [(2, "1", 'a "b",\nc', None), (3, "2", "x", None)]
    assert sorted(name(r.path) for r in files.header_problems(rows).collect()) == ["bare.csv", "heads.csv"]
    assert "good.csv" not in {name(r.path) for r in files.exact_header(rows, ["id", "text"]).collect()}
    assert {name(r.path) for r in files.shape_problems(read).collect()} == {"bare.csv", "latin.csv", "open.csv", "wide.csv"}
    m = {name(r.path): (r.rows, r.max_width, r.blank_rows) for r in files.metrics(read).collect()}
    assert m["wide.csv"] == (3, 3, 0) and m["good.csv"] == (4, 2, 1)
    assert [name(r.path) for r in files.misplaced(read, r"^[a-f]").collect()].count("good.csv") == 1


def test_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"catalog_id": "C", "templates": [{"template_id": "T", "version": "1"}]}')
    (tmp_path / "b.json").write_text("{broken")
    docs = files.json_documents(spark, str(tmp_path), "catalog_id string, templates array<struct<template_id:string,version:string>>")
    assert docs.filter("_corrupt is not null").count() == 1
    assert [(r.place, r.template_id) for r in files.entries(docs, "templates").collect()] == [(0, "T")]
    (tmp_path / "x.ndjson").write_text('{"a": 1}\nnope\n')
    assert {(r.a, r._corrupt) for r in files.json_lines(spark, str(tmp_path / "x.ndjson"), "a int").collect()} == {(1, None), (None, "nope")}
    texts = spark.createDataFrame([('{"a":1}',), ("[1]",), ("{",), (None,), ("{}",)], "t string")
    assert files.not_objects(texts, "t").count() == 3


def test_integrity_rules(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = lambda x: sorted(map(tuple, x.collect()), key=str)
    refs, held = df([("a", "1"), ("b", "2"), ("c", "3"), ("d", None)], "path string, sha256 string"), df([("a", "1"), ("b", "9"), ("d", "4")], "path string, sha256 string")
    assert sorted((r.path, r.defect) for r in integrity.bound_references(refs, held).collect()) == [("b", "hash_differs"), ("c", "missing"), ("d", "hash_differs")]
    assert got(integrity.not_exactly_once(df([("a",), ("b",), ("c",)], "k string"), df([("a",), ("b",), ("b",)], "k string"), ["k"])) == [("b", 2), ("c", 0)]
    assert got(integrity.broken_dependency(df([(1, "x"), (1, "x"), (2, "x"), (2, "y")], "k int, v string"), "k", "v")) == [(2, 2)]
    actors = df([("r", "build", "Ann"), ("r", "review", "ANN​"), ("r", "sign", "Bo"), ("q", "build", "Ann")], "s string, lane string, who string")
    assert got(integrity.shared_identities(actors, "s", "lane", "who")) == [("r", "ann", 2)]
    a, b = df([(1, 0, "x"), (1, 1, "y")], "k int, n int, v string"), df([(1, 0, "x"), (1, 1, "z"), (1, 2, None)], "k int, n int, v string")
    assert got(integrity.list_differences(a, b, "k", "n", "v")) == [(1, 1, "y", "z"), (1, 2, None, None)]
    assert got(integrity.registry_differences(df([("a",), ("b",)], "k string"), df([("b",), ("c",)], "k string"), ["k"])) == [("a", "unregistered"), ("c", "unused")]
    assert got(integrity.field_differences(df([(1, "a", None)], "k int, x string, y string"), df([(1, "b", None)], "k int, x string, y string"), ["k"], ["x", "y"])) == [(1, "x", "a", "b")]
    sheets = df([("p", "s1", "f"), ("p", "s2", "f"), ("p", "s3", "f"), ("p", "s4", "g"), ("q", "s1", "f")], "p string, s string, f string")
    assert got(integrity.converging(sheets, "p", "s", "f")) == [("p", 4, 3, 0.75)]
    layers = df([([("core", 0), ("a", 1)],), ([("a", 0), ("core", 1)],), ([("core", 1), ("a", 0)],), (None,)], "l array<struct<name:string,place:int>>")
    assert [r.v for r in layers.select(integrity.layers_valid(layers.l).alias("v")).collect()] == [True, False, False, False]
