from __future__ import annotations

import pytest
from test_artifacts import CELLS, workbook

from tallyforge.functions import documents
from tallyforge.operators import office
from tallyforge.sources.artifacts import workbook_cells
from tallyforge.sources.carriers import files

EXTRA = {
    "docProps/core.xml": '<c xmlns:dc="d"><dc:creator>x</dc:creator><dc:title>t</dc:title></c>',
    "docProps/custom.xml": '<p><property name="k"><v>1</v></property></p>',
    "xl/styles.xml": '<s><numFmts><numFmt numFmtId="164" formatCode="0.0"/></numFmts><cellXfs><xf/><xf/><xf/><xf numFmtId="164"/></cellXfs></s>',
    "xl/comments1.xml": "<c><t>see {{slot}} and the answer key</t></c>",
    "xl/embeddings/o.bin": "x",
}


def test_surfaces_and_findings(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(workbook(CELLS, EXTRA, 'state="hidden"'))
    (tmp_path / "clean.xlsx").write_bytes(workbook('<row r="1"><c r="A1"><f>1+1</f><v>2</v></c></row>'))
    (tmp_path / "bad.xlsx").write_bytes(b"nope")
    read = files(spark, str(tmp_path))
    got = {(r.rule, r.subject.rpartition("/")[2], r.detail) for r in office.findings(read, require_formulas=True).collect()}
    assert {(a, c) for a, b, c in got if b == "w.xlsx"} == {
        ("hidden_sheet", "Checks"), ("hidden_row", "Checks!1"), ("formula_error", "Checks!A2"), ("unresolved_token", "{{slot}}"), ("prohibited_phrase", "answer_key"),
        ("hidden_columns", "Checks!1:1"), ("stale_metadata", "creator"), ("stale_metadata", "k"), ("comments", "xl/comments1.xml"), ("embedded_object", "xl/embeddings/o.bin"),
    }
    assert {a for a, b, _ in got if b == "clean.xlsx"} == {"hidden_columns"} and {(a, c) for a, b, c in got if b == "bad.xlsx"} == {("no_formulas", ""), ("malformed_part", "package")}
    formats = office.number_formats(read)
    assert {(r.style, r.format) for r in formats.filter("format is not null").collect()} == {(3, "0.0")}
    assert office.layouts(workbook_cells(read), formats).select("fingerprint").distinct().count() == 2


def test_one_malformed_part_hides_no_other(spark, tmp_path):
    extra = EXTRA | {"xl/comments1.xml": "<c><t>open", "xl/drawings/vml1.vml": "<v><t>the {{hidden}} slot</t></v>", "docProps/custom.xml": "<p", "xl/_rels/comments1.xml.rels": '<R><Relationship Id="r1" Type="x/hyperlink" Target="http://far" TargetMode="External"/></R>'}
    (tmp_path / "w.xlsx").write_bytes(workbook(CELLS, extra))
    got = {(r.rule, r.detail) for r in office.findings(files(spark, str(tmp_path))).collect()}
    assert {("malformed_part", "part: xl/comments1.xml"), ("malformed_part", "part: docProps/custom.xml"), ("unresolved_token", "{{hidden}}"), ("stale_metadata", "creator"), ("external_relationship", "hyperlink http://far")} <= got


def test_a_malformed_sheet_hides_no_other(spark, tmp_path):
    two = {
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="A" r:id="rId1"/><sheet name="B" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<R><Relationship Id="rId1" Type="x/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="x/worksheet" Target="worksheets/sheet2.xml"/></R>',
        "xl/worksheets/sheet2.xml": "<worksheet><row",
    }
    (tmp_path / "w.xlsx").write_bytes(workbook(CELLS, two))
    assert {r.sheet for r in workbook_cells(files(spark, str(tmp_path))).collect()} == {"A"}


def test_layouts_see_widths_and_gridlines(spark, tmp_path):
    for name, cols in (("a", 'width="9"'), ("b", 'width="12"'), ("c", 'width="9"')):
        sheet = f'<worksheet xmlns="m"><cols><col min="1" max="2" {cols}/></cols><sheetData>{CELLS}</sheetData></worksheet>'
        (tmp_path / f"{name}.xlsx").write_bytes(workbook(CELLS, {"xl/worksheets/sheet1.xml": sheet}))
    read = files(spark, str(tmp_path))
    prints = {r.path[-6]: r.fingerprint for r in office.layouts(workbook_cells(read), office.number_formats(read), office.column_runs(read)).collect()}
    assert prints["a"] == prints["c"] != prints["b"]


def test_native_tables(spark, tmp_path):
    extra = {"xl/worksheets/_rels/sheet1.xml.rels": '<R><Relationship Id="r1" Type="x/table" Target="../tables/t1.xml"/></R>', "xl/tables/t1.xml": '<table displayName="T" ref="A1:B3"><tableColumns><tableColumn name="a"/><tableColumn name="b"/></tableColumns></table>'}
    (tmp_path / "w.xlsx").write_bytes(workbook(CELLS, extra))
    r = office.native_tables(files(spark, str(tmp_path))).first()
    assert (r.sheet, r.name, r.ref, r["columns"]) == ("Checks", "T", "A1:B3", ["a", "b"])


def test_formula_evidence_and_caches(spark):
    schema = "path string, sheet string, sheet_hidden boolean, cell string, kind string, formula string, value string, style int, row_hidden boolean"
    rows = [("p", "s", False, "A1", "n", None, None, 0, False), ("p", "s", False, "B1", "str", 'IF($A$1="","",A1)', "", 0, False), ("p", "s", False, "A2", "n", None, "5", 0, False), ("p", "s", False, "B2", "str", 'IF(A2="","",A2)', None, 0, False), ("p", "s", False, "C1", "n", "1+1", "2", 0, False), ("p", "s", False, "C2", "e", "1/0", "#DIV/0!", 0, False)]
    cells = spark.createDataFrame(rows, schema)
    assert {(r.cell, r.valid) for r in office.empty_caches(cells).collect()} == {("B1", True), ("B2", False)}
    e = office.formula_evidence(cells, [("s", "C1")]).first()
    assert (e.formulas, e.cached, e.errors, e.controls["s!C1"]) == (4, 3, 1, "2")
    again = office.formula_evidence(cells.repartition(3)).first()
    changed = office.formula_evidence(cells.replace("2", "3", ["value"])).first()
    assert (again.structure, again.results) == (e.structure, e.results) and changed.structure == e.structure and changed.results != e.results
    proofs = spark.createDataFrame([("a", b"REL-1 " + b"x" * 64, "REL-1"), ("b", b"REL-1", "REL-2")], "path string, content binary, release string")
    assert sorted((r.path, r.problem) for r in office.proof_problems(proofs, ["release"]).collect()) == [("b", "lacks_release"), ("b", "too_short")]


SCHEMA = {
    "type": "object",
    "required": ["id", "kind"],
    "additionalProperties": False,
    "properties": {"id": {"$ref": "#/$defs/id"}, "kind": {"enum": ["a", "b"]}, "n": {"type": "integer", "minimum": 1}, "tags": {"type": "array", "uniqueItems": True, "minItems": 1, "items": {"type": "string"}}, "x": {"oneOf": [{"type": "null"}, {"const": 1}]}},
    "if": {"properties": {"kind": {"const": "b"}}},
    "then": {"required": ["n"]},
    "$defs": {"id": {"type": "string", "pattern": "^[A-Z]+$", "maxLength": 3}},
}


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ({"id": "AB", "kind": "a"}, []),
        ({"id": "AB", "kind": "b"}, [("/n", "required")]),
        ({"id": "abcd", "kind": "c", "more": 1}, [("/id", "length"), ("/id", "pattern"), ("/kind", "enum"), ("/more", "additionalProperties")]),
        ({"id": 1, "kind": "a", "n": 0, "tags": ["x", "x", 2]}, [("/id", "type"), ("/n", "bounds"), ("/tags", "uniqueItems"), ("/tags/2", "type")]),
        ({"id": "A", "kind": "a", "n": True, "tags": [], "x": 2}, [("/n", "type"), ("/tags", "size"), ("/x", "oneOf")]),
        ([], [("", "type")]),
    ],
)
def test_closed_schemas(value, expected):
    assert sorted(documents.problems(value, SCHEMA)) == expected


def test_document_rules_in_spark(spark):
    df = spark.createDataFrame([(1, '{"id": "A", "kind": "z"}'), (2, None), (3, "{"), (4, '{"a": [{"Secret": {"url": "file:///x"}}]}')], "n int, body string")
    assert {(r.subject, r.problem) for r in documents.schema_findings(df.filter("n < 4"), "n", "body", SCHEMA).collect()} == {("1", "enum"), ("2", "unreadable"), ("3", "unreadable")}
    got = documents.forbidden_findings(df.filter("n = 4"), "n", "body", ["secret"], [r"^[a-z]+://"]).collect()
    assert {(r.location, r.problem) for r in got} == {("/a/0/Secret", "forbidden_key"), ("/a/0/Secret/url", "forbidden_text")}
