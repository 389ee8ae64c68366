from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib

import pytest

from tallyforge.sources import artifacts as a
from tallyforge.sources import pdf
from tallyforge.sources.carriers import files

RELS = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def zipped(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def workbook(rows: str, extra: dict | None = None, state: str = "") -> bytes:
    return zipped(
        {
            "[Content_Types].xml": '<Types><Override PartName="/xl/workbook.xml" ContentType="a/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/></Types>',
            "xl/workbook.xml": f'<workbook xmlns:r="r"><sheets><sheet name="Checks" sheetId="1" {state} r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": RELS.format('<Relationship Id="rId1" Type="x/worksheet" Target="worksheets/sheet1.xml"/>'),
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="m"><cols><col min="1" hidden="1"/></cols><sheetData>{rows}</sheetData></worksheet>',
            "xl/sharedStrings.xml": "<sst><si><r><t>two </t></r><r><t>runs</t></r></si></sst>",
        }
        | (extra or {})
    )


CELLS = '<row r="1" hidden="1"><c r="A1" t="s"><v>0</v></c><c r="B1" s="3"><f>A1/0</f><v>5</v></c></row><row r="2"><c r="A2" t="e"><v>#N/A</v></c><c r="B2" t="inlineStr"><is><t>in</t></is></c></row>'


def png(width=2, height=2, color=2, damage=None, interlace=0) -> bytes:
    raw = b"".join(b"\0" + b"\1" * (width * (3 if color == 2 else 1)) for _ in range(height))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    body = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, interlace)) + chunk(b"IDAT", zlib.compress(raw if damage != "raster" else raw[:-1])) + chunk(b"IEND", b"")
    data = b"\x89PNG\r\n\x1a\n" + body
    return data[:40] + bytes([data[40] ^ 1]) + data[41:] if damage == "bit" else data + b"x" if damage == "tail" else data


PDF = pdf.write([(612, 792, b"q endobj obj (a\\) ) Q"), (20, 30, b"")])
MAIL = "From: a@x\nTo: b@x\nDate: Mon, 1 Jan 2024 00:00:00 +0000\nSubject: s\nMessage-ID: <1@x>\nContent-Type: text/plain\n\nhello\n> quoted\n"


def test_inspectors():
    x = a.inspected("xlsx", workbook(CELLS, {"xl/externalLinks/e.xml": "<e/>"}, 'state="hidden"'))
    assert (x["hidden_sheets"], x["hidden_rows"], x["hidden_columns"], x["formulas"], x["formula_errors"], x["external_links"]) == (["Checks"], 1, 1, 1, 1, 1)
    assert a.inspected("pdf", PDF) == {"pages": 2, "problems": [], "smallest_side": 20, "encrypted": False, "compressed": False, "objects": 6}
    assert a.inspected("pdf", b"nope")["problems"] == ["no_header"] and "unreadable" in a.inspected("docx", b"nope")
    m = a.inspected("eml", MAIL.encode())
    assert (m["missing_headers"], m["reply_markers"], m["attachments"]) == ([], 1, [])
    d = a.inspected("docx", zipped({"word/document.xml": '<w:document xmlns:w="w"><w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:rPr><w:vanish/></w:rPr><w:t>hi</w:t></w:r></w:p><w:p/></w:document>'}))
    assert (d["paragraphs"], d["styles"], d["hidden_text"], d["characters"]) == (2, {"(none)": 1, "Title": 1}, 1, 2)
    assert "unreadable" in a.inspected("docx", zipped({"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'}))
    assert a.inspected("csv", b"a,b\n1,2\n,\n") == {"rows": 3, "columns_max": 2, "blank_rows": 1}


@pytest.mark.parametrize(("kwargs", "problems"), [({}, []), ({"damage": "bit"}, ["checksum", "compressed_data"]), ({"damage": "tail"}, ["end"]), ({"damage": "raster"}, ["raster_size"]), ({"color": 3}, ["palette"]), ({"color": 7}, ["header"]), ({"width": 9000, "height": 1000, "color": 0}, ["too_many_pixels"])])
def test_png(kwargs, problems):
    got = a.inspected("png", png(**kwargs))["problems"]
    assert got == problems or (kwargs.get("damage") == "bit" and "checksum" in got)


@pytest.mark.parametrize(
    ("old", "new", "problem"),
    [
        (b"/Count 2", b"/Count 3", "count_differs"),
        (b"[3 0 R 5 0 R]", b"[2 0 R 5 0 R]", "cycle"),
        (b"[3 0 R 5 0 R]", b"[3 0 R 9 0 R]", "missing_object"),
        (b"/Parent 2 0 R/MediaBox[0 0 20 30]", b"/Parent 1 0 R/MediaBox[0 0 20 30]", "parent_differs"),
        (b"/MediaBox[0 0 20 30]", b"/MediaBox[0 0 20 (3]", "token"),
        (b"/MediaBox[0 0 20 30]", b"/MediaBux[0 0 20 30]", "no_media_box"),
        (b"/Contents 6 0 R", b"/Contents 1 0 R", "no_contents"),
        (b"/Type/Catalog", b"/Type/Catalig", "no_catalog"),
        (b"startxref", b"startxraf", "no_xref"),
        (b"%PDF-1.7", b"%PDF-9.7", "no_header"),
        (b"2 0 obj\n", b"7 0 obj\n", "xref_place"),
        (b"/Length 0", b"/Length 3", "stream_length"),
        (b"/Type/Page/Parent 2 0 R/MediaBox[0 0 20 30]", b"/Type/Type/Parent 2 0 /MediaBox[0 0 20 30 R]", "dictionary"),
        (b"00000 n", b"0000x n", "xref_entry"),
        (b"%%EOF", b"%%EOX", "no_xref"),
        (b"6 0 obj\n", b"6 0 obj\n<", "xref_place"),
    ],
)
def test_pdf_problems(old, new, problem):
    assert old in PDF
    got = a.inspected("pdf", PDF.replace(old, new, 1))["problems"]
    assert problem in got or (got and problem in ("xref_place", "token", "dictionary"))


def test_pdf_reads_no_structure_in_strings_comments_and_streams():
    body = b"(9 0 obj <</Type/Pages>> endobj \\( ) % 8 0 obj\nq"
    got = pdf.inspect(pdf.write([(100, 100, body)]))
    assert got["pages"] == 1 and got["objects"] == 4 and not got["problems"]
    comment = PDF.replace(b"%PDF-1.7\n", b"%PDF-1.7\n%9 0 obj endobj\n")
    assert pdf.inspect(comment)["problems"]  # every offset is off by the comment
    assert pdf.inspect(b"%PDF-1.7\n" + b"(" * 100_000)["problems"] == ["no_xref"]
    assert pdf.value(b"[1 0 R (a(b)c) <</A/B/C[true null -1.5]>>] x", 0, 43)[0] == [(1, 0), b"(a(b)c)", {b"/A": b"/B", b"/C": [True, None, -1.5]}]
    with pytest.raises(pdf.Malformed):
        pdf.value(b"[" * 5000, 0, 5000)


def palette_png(rows, depth=8, colors=2, filters=(0,)) -> bytes:
    """A palette image of rows of indices, each filtered as asked for."""
    packed = []
    for r in rows:
        bits = "".join(f"{v:0{depth}b}" for v in r)
        packed.append([int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8)])
    raw, above = b"", [0] * len(packed[0])
    for n, line in enumerate(packed):
        kind, left, corner, out = filters[n % len(filters)], 0, 0, []
        for i, x in enumerate(line):
            up = above[i]
            p = left + up - corner
            near = min((left, up, corner), key=lambda v: (abs(p - v), (left, up, corner).index(v)))
            out.append((x - (0, left, up, (left + up) // 2, near)[kind]) % 256)
            left, corner = x, up
        raw += bytes([kind, *out])
        above = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), depth, 3, 0, 0, 0)) + chunk(b"PLTE", b"\1\2\3" * colors) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("filters", [(0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4)])
@pytest.mark.parametrize("depth", [1, 2, 4, 8])
def test_png_palette_indices_are_reconstructed(filters, depth):
    most = min(2**depth, 7)
    rows = [[(x * 3 + y) % most for x in range(13)] for y in range(9)]
    assert a.inspected("png", palette_png(rows, depth, most, filters))["problems"] == []
    assert a.inspected("png", palette_png(rows, depth, most - 1, filters))["problems"] == ["palette_index"]


def test_binary_attachments():
    assert a.is_binary("a.txt", PDF) and not a.is_binary("a.txt", b"see %PDF-1.7 in the text")
    assert a.is_binary("a", "\x85".encode()) and a.is_binary("a", b"abc", "no-such-set") and not a.is_binary("a", "é".encode("latin-1"), "latin-1")
    assert all(a.is_binary("a", b"MZ" + b" " * 58 + struct.pack("<I", 64) + s) for s in (b"PE\0\0", b"NE", b"LE", b"LX")) and not a.is_binary("a", b"MZ" + b" " * 90)
    assert a.is_binary("a.pdf", b"x") and a.is_binary("a.txt", b"PK\x03\x04") and a.is_binary("a", b"\xff\xfe") and a.is_binary("a.txt", b"a\0b")
    assert not a.is_binary("a.csv", "é,b\n".encode())


def test_files_in_spark(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.zip").write_bytes(zipped({"in/b.csv": "a,b\n1,2\n", "c.zip": zipped({"d.txt": "x"})}))
    (tmp_path / "sub" / "w.xlsx").write_bytes(workbook(CELLS))
    (tmp_path / "p.png").write_bytes(png(3, 2))
    (tmp_path / "m.eml").write_text(MAIL.replace("Subject: s\n", ""))
    (tmp_path / "bad.zip").write_bytes(b"PKnope")
    (tmp_path / "note.xyz").write_text("?")
    read = files(spark, str(tmp_path))
    rows = {(r.container.rpartition("/")[2] if r.container else None, r.name.rpartition("/")[2]): r for r in a.inventory(read).collect()}
    assert json.loads(rows["one.zip", "b.csv"].detail)["rows"] == 2 and rows["one.zip!c.zip", "d.txt"].bytes == 1
    assert rows["bad.zip", ""].problem == "unreadable" and rows[None, "note.xyz"].detail is None
    assert a.duplicate_members(a.members(read)).count() == 0
    cells = {r.cell: r for r in a.workbook_cells(read.filter("name = 'w.xlsx'")).collect()}
    assert cells["A1"].value == "two runs" and cells["A1"].row_hidden and cells["B1"].formula == "A1/0" and cells["B2"].value == "in" and cells["B1"].style == 3
    size = read.filter("name = 'p.png'").select(a.png_size(read.content).alias("s")).first().s
    assert tuple(size) == (3, 2)
    found = {(r.name.rpartition("/")[2], r.problem) for r in a.shape_findings(read.filter("name not like '%.zip'")).collect()}
    assert found == {("m.eml", "missing_subject"), ("note.xyz", "unsupported_type")}
