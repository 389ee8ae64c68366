"""Rows as workbooks, documents, mail, images and archives: bytes that the artifact readers read back.

Each package is made where its rows lie. Workbooks hold a bounded number of rows: a partition's rows
fill one workbook after another, so no group is ever gathered into a file.
"""

from __future__ import annotations

import email.message
import email.policy
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one workbook holds by default; the format's own bound is 1,048,575 below a header.
CAPACITY = 5000
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument."
#: What XML cannot hold, however it is written.
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")


def _shown(text: str) -> str:
    return escape(_NO_XML.sub("\ufffd", text), {"\r": "&#13;"})


def letters(number: int) -> str:
    """1, 2, ..., 26, 27 as A, B, ..., Z, AA."""
    out = ""
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def zipped(parts: Mapping[str, str | bytes]) -> bytes:
    """An archive with fixed times, so that equal parts make equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _relations(*rows: tuple[str, str, str]) -> str:
    return f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="{i}" Type="{_OFFICE}/{kind}" Target="{target}"/>' for i, kind, target in rows) + "</Relationships>"


def _types(parts: Mapping[str, str]) -> str:
    return f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>' + "".join(f'<Override PartName="/{p}" ContentType="{_TYPE}{t}"/>' for p, t in parts.items()) + "</Types>"


def workbook(headers: Sequence[str], rows: Sequence[Sequence[object]], formulas: Mapping[str, tuple[str, Sequence[object]]] | None = None, sheet: str = "Data", capacity: int = CAPACITY) -> bytes:
    """A workbook of one sheet and one table. Numbers are numbers, all else inline text; None is no cell.

    formulas: further columns, each a formula with ``{r}`` for the row, and its cached values.
    Raises ValueError where there are more rows than the table's capacity.
    """
    if len(rows) > capacity:
        raise ValueError(f"{len(rows)} rows are more than the capacity of {capacity}")
    more = formulas or {}
    names = [*headers, *more]

    def cell(c: int, r: int, v: object, formula: str | None = None) -> str:
        at = f'r="{letters(c)}{r}"'
        made = f"<f>{_shown(formula)}</f>" if formula is not None else ""
        if v is None:
            return f"<c {at}>{made}</c>" if made else ""
        if isinstance(v, str):
            return f'<c {at} t="str">{made}<v>{_shown(v)}</v></c>' if made else f'<c {at} t="inlineStr"><is><t xml:space="preserve">{_shown(v)}</t></is></c>'
        return f"<c {at}>{made}<v>{v}</v></c>"

    lines = ["".join(cell(c, 1, h) for c, h in enumerate(names, 1))]
    for i, row in enumerate(rows):
        cells = [cell(c, i + 2, v) for c, v in enumerate(row, 1)]
        cells += [cell(c, i + 2, values[i], f.format(r=i + 2)) for c, (f, values) in enumerate(more.values(), len(headers) + 1)]
        lines.append("".join(cells))
    data = "".join(f'<row r="{r}">{cells}</row>' for r, cells in enumerate(lines, 1))
    ref = f"A1:{letters(len(names))}{len(rows) + 1}"
    columns = "".join(f"<tableColumn id={quoteattr(str(c))} name={quoteattr(_NO_XML.sub('', h))}/>" for c, h in enumerate(names, 1))
    parts = {"xl/workbook.xml": "spreadsheetml.sheet.main+xml", "xl/worksheets/sheet1.xml": "spreadsheetml.worksheet+xml", "xl/tables/table1.xml": "spreadsheetml.table+xml"}
    return zipped(
        {
            "[Content_Types].xml": _types(parts),
            "_rels/.rels": _relations(("rId1", "officeDocument", "xl/workbook.xml")),
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": _relations(("rId1", "worksheet", "worksheets/sheet1.xml")),
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheetData>{data}</sheetData><tableParts count="1"><tablePart r:id="rId1"/></tableParts></worksheet>',
            "xl/worksheets/_rels/sheet1.xml.rels": _relations(("rId1", "table", "../tables/table1.xml")),
            "xl/tables/table1.xml": f'<table xmlns="{_MAIN}" id="1" name="{sheet}Table" displayName="{sheet}Table" ref="{ref}"><autoFilter ref="{ref}"/><tableColumns count="{len(names)}">{columns}</tableColumns></table>',
        }
    )


def workbooks(df: DataFrame, headers: Sequence[str], formulas: Mapping[str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(path, rows, content): df's columns ``headers`` as workbooks of at most ``capacity`` rows.

    formulas: further columns as formulas; their cached values are df's columns of the same names.
    """
    more = dict(formulas or {})
    wanted = df.select(*[F.col(f"`{h}`") for h in (*headers, *more)], F.spark_partition_id().alias("__tf_part"))

    def one(part: int, n: int, rows: list[tuple]) -> pa.RecordBatch:
        k = len(headers)
        made = workbook(headers, [r[:k] for r in rows], {h: (f, [r[k + j] for r in rows]) for j, (h, f) in enumerate(more.items())}, capacity=capacity)
        return pa.RecordBatch.from_arrays([pa.array([f"part-{part}-{n}.xlsx"]), pa.array([len(rows)], pa.int64()), pa.array([made], pa.binary())], names=["path", "rows", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        part = n = 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            part = columns[-1][0] if columns[-1] else part
            held += zip(*columns[:-1], strict=True)
            while len(held) >= capacity:
                yield one(part, n, held[:capacity])
                held, n = held[capacity:], n + 1
        if held:
            yield one(part, n, held)

    return wanted.mapInArrow(run, "path string, rows bigint, content binary")


def without_caches(data: bytes) -> bytes:
    """A workbook whose formulas have no cached values, all else as it was."""
    parts: dict[str, str | bytes] = {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in z.namelist():
            content = z.read(name)
            if re.fullmatch(r"xl/worksheets/[^/]+\.xml", name):
                root = ElementTree.fromstring(content)
                for c in (e for e in root.iter() if e.tag.endswith("}c") or e.tag == "c"):
                    kinds = {e.tag.rpartition("}")[2]: e for e in c}
                    if "f" in kinds and "v" in kinds:
                        c.remove(kinds["v"])
                        c.attrib.pop("t", None)
                content = ElementTree.tostring(root)
            parts[name] = content
    return zipped(parts)


def document(paragraphs: Sequence[str]) -> bytes:
    """A word-processing document of plain paragraphs."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{_shown(p)}</w:t></w:r></w:p>' for p in paragraphs)
    return zipped(
        {
            "[Content_Types].xml": _types({"word/document.xml": "wordprocessingml.document.main+xml"}),
            "_rels/.rels": _relations(("rId1", "officeDocument", "word/document.xml")),
            "word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>',
        }
    )


def mail(subject: str, message_id: str, body: str, attachments: Mapping[str, str] | None = None, date: str = "Mon, 01 Jan 2024 00:00:00 +0000") -> bytes:
    """A mail with its headers, a plain body and text attachments."""
    m = email.message.EmailMessage(policy=email.policy.default)
    m["From"], m["To"], m["Date"], m["Message-ID"] = "sender@example.com", "receiver@example.com", date, f"<{message_id}>"
    m["Subject"] = " ".join(subject.split())
    m.set_content(body.encode("utf-8", "replace").decode(), cte="base64")
    for name, text in (attachments or {}).items():
        m.add_attachment(text.encode("utf-8", "replace").decode(), filename=name, cte="base64")
    return m.as_bytes()


def png(rows: Sequence[bytes]) -> bytes:
    """A grey image of 8 bits a pixel."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")


def built(maker, *inputs: Column) -> Column:  # noqa: ANN001
    """A binary column that a maker builds from each row's values; null where the first is null."""

    @F.udf(T.BinaryType(), useArrow=True)
    def run(*values: object) -> bytes | None:
        return None if values[0] is None else maker(*values)

    return run(*inputs)
