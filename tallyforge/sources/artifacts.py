"""Document artifacts: archives and their members, workbooks, documents, mail, PDF and PNG structure.

A file is parsed where it lies, one row in, rows out; nothing is gathered. Parsers are strict about
size: members and rasters beyond a bound are findings, not read.
"""

from __future__ import annotations

import email
import email.message
import email.policy
import io
import json
import re
import struct
import zipfile
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.scalars import FORMULA_ERRORS, REPLY, relation_target
from tallyforge.sources import pdf
from tallyforge.sources.carriers import tally

#: Bounds: a member's bytes, archives within archives, a PNG's pixels and its decoded bytes.
MEMBER_BYTES, NESTING, PNG_PIXELS, PNG_BYTES = 256 << 20, 3, 8_000_000, 64 << 20
#: The smallest side of a plausible page, in points, and of an image, in pixels.
SMALLEST_PAGE, SMALLEST_IMAGE = 16, 2

_MEMBERS = pa.schema([("container", pa.string()), ("name", pa.string()), ("type", pa.string()), ("bytes", pa.int64()), ("content", pa.binary()), ("problem", pa.string())])


def _suffix(name: str) -> str:
    return name.rpartition(".")[2].lower() if "." in name.rpartition("/")[2] else ""


def _members(container: str | None, name: str, data: bytes, deep: int) -> Iterator[dict]:
    suffix = _suffix(name)
    yield {"container": container, "name": name, "type": suffix, "bytes": len(data), "content": data, "problem": None}
    if suffix != "zip":
        return
    inside = name if container is None else f"{container}!{name}"
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for m in z.infolist():
                if m.is_dir():
                    continue
                if m.file_size > MEMBER_BYTES or deep >= NESTING:
                    yield {"container": inside, "name": m.filename, "type": _suffix(m.filename), "bytes": m.file_size, "content": None, "problem": "too_large" if m.file_size > MEMBER_BYTES else "too_deep"}
                else:
                    yield from _members(inside, m.filename, z.read(m), deep + 1)
    except (zipfile.BadZipFile, RuntimeError, zlib.error, NotImplementedError):
        yield {"container": inside, "name": "", "type": "", "bytes": 0, "content": None, "problem": "unreadable"}


def _expand(df: DataFrame, each: Callable[[str, bytes], Iterator[dict]], schema: pa.Schema, ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = data.as_py()
                if content is not None:
                    rows = list(each(path, content))
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return df.select("path", "content").mapInArrow(run, ddl)


def members(files: DataFrame) -> DataFrame:
    """(container, name, type, bytes, content, problem): every file, and every member of archives within."""
    return _expand(files, lambda p, d: _members(None, p, d, 0), _MEMBERS, "container string, name string, type string, bytes bigint, content binary, problem string")


def inventory(files: DataFrame) -> DataFrame:
    """members with a hash and a detail document by type, without the bytes themselves."""
    return members(files).select("container", "name", "type", "bytes", F.sha2("content", 256).alias("sha256"), "problem", detail(F.col("type"), F.col("content")).alias("detail"))


@F.pandas_udf(T.StringType())
def _detail(kind: pd.Series, content: pd.Series) -> pd.Series:
    return content.combine(kind, lambda c, k: None if c is None or k not in INSPECTORS else json.dumps(inspected(k, bytes(c)), sort_keys=True))


def detail(kind: Column, content: Column) -> Column:
    """What a type's inspector tells of a content, as JSON; null for types without one."""
    return _detail(kind, content)


def inspected(kind: str, data: bytes) -> dict:
    try:
        return INSPECTORS[kind](data)
    except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError, IndexError, RecursionError, struct.error, zlib.error) as e:
        return {"unreadable": type(e).__name__}


def duplicate_members(member_rows: DataFrame) -> DataFrame:
    """Archives that hold a name more than once."""
    return member_rows.filter("container is not null").groupBy("container", "name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


# OOXML


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    data = z.read(name)
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
        raise ValueError("document types are refused: their entities may expand without bound")
    return ElementTree.fromstring(data)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if _local(k) == name), None)


def _all(root: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (e for e in root.iter() if _local(e.tag) == name)


def relations(z: zipfile.ZipFile) -> list[dict]:
    """The package's relationships: (source, id, type, target, external)."""
    out = []
    for name in sorted(n for n in z.namelist() if n.endswith(".rels")):
        folder, _, file = name.rpartition("_rels/")
        source = folder + file.removesuffix(".rels")
        for r in _all(_xml(z, name), "Relationship"):
            external = r.get("TargetMode") == "External"
            out.append({"source": source, "id": r.get("Id"), "type": (r.get("Type") or "").rpartition("/")[2], "target": r.get("Target") if external else relation_target(source, r.get("Target") or ""), "external": external})
    return out


_CELLS = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("sheet_hidden", pa.bool_()), ("cell", pa.string()), ("kind", pa.string()), ("formula", pa.string()), ("value", pa.string()), ("style", pa.int32()), ("row_hidden", pa.bool_())])


def _cells(path: str, data: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        # runs of a shared string are one text
        shared = ["".join(t.text or "" for t in _all(si, "t")) for si in _all(_xml(z, "xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
        targets = {r["id"]: r["target"] for r in relations(z) if r["source"] == "xl/workbook.xml"}
        for s in _all(_xml(z, "xl/workbook.xml"), "sheet"):
            part = targets.get(_attribute(s, "id") or "")
            if part not in names:
                continue
            try:
                sheet_rows = list(_all(_xml(z, part), "row"))
            except (ElementTree.ParseError, ValueError):
                continue  # surfaces tells of a part that cannot be read; the other sheets are read
            for row in sheet_rows:
                for c in (e for e in row if _local(e.tag) == "c"):
                    kind = c.get("t") or "n"
                    raw = next((e.text for e in c if _local(e.tag) == "v"), None)
                    value = "".join(t.text or "" for t in _all(c, "t")) if kind == "inlineStr" else shared[int(raw)] if kind == "s" and raw is not None else raw
                    yield {
                        "path": path, "sheet": s.get("name"), "sheet_hidden": s.get("state", "visible") != "visible", "cell": c.get("r"), "kind": kind,
                        "formula": next((e.text or "" for e in c if _local(e.tag) == "f"), None), "value": value, "style": int(c.get("s") or 0), "row_hidden": row.get("hidden") in ("1", "true"),
                    }


def _quiet(path: str, data: bytes) -> Iterator[dict]:
    try:
        yield from _cells(path, data)
    except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError, IndexError):
        return


def workbook_cells(files: DataFrame) -> DataFrame:
    """One row a cell: (path, sheet, sheet_hidden, cell, kind, formula, value, style, row_hidden). Unreadable workbooks give none."""
    return _expand(files, _quiet, _CELLS, "path string, sheet string, sheet_hidden boolean, cell string, kind string, formula string, value string, style int, row_hidden boolean")


def _xlsx(data: bytes) -> dict:
    cells = list(_cells("", data))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = list(_all(_xml(z, "xl/workbook.xml"), "sheet"))
        external = sum(r["external"] for r in relations(z))
        hidden_columns = 0
        for n in z.namelist():
            if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n):
                hidden_columns += sum(c.get("hidden") in ("1", "true") for c in _all(_xml(z, n), "col"))
        members_ = z.namelist()
    formats = Counter((c["sheet"], c["style"]) for c in cells)
    return {
        "sheets": [s.get("name") for s in book],
        "hidden_sheets": [s.get("name") for s in book if s.get("state", "visible") != "visible"],
        "hidden_rows": len({(c["sheet"], re.sub(r"\D", "", c["cell"] or "")) for c in cells if c["row_hidden"]}),
        "hidden_columns": hidden_columns,
        "cells": len(cells),
        "formulas": sum(c["formula"] is not None for c in cells),
        "formula_errors": sum(c["kind"] == "e" or c["value"] in FORMULA_ERRORS or any(t in (c["formula"] or "") for t in FORMULA_ERRORS) for c in cells),
        "external_links": external + sum(n.startswith("xl/externalLinks/") and n.endswith(".xml") for n in members_),
        "tables": sum(bool(re.fullmatch(r"xl/tables/[^/]+\.xml", n)) for n in members_),
        "comments": sum("/comments" in n or "threadedComment" in n for n in members_ if n.endswith(".xml")),
        "embedded": sum("/embeddings/" in n for n in members_),
        "styles": {f"{a}:{b}": n for (a, b), n in sorted(formats.items(), key=str)},
    }


def _docx(data: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _xml(z, "word/document.xml")
        names = z.namelist()
        paragraphs = list(_all(body, "p"))
        styles = Counter(next((_attribute(s, "val") for s in _all(p, "pStyle")), None) or "(none)" for p in paragraphs)
        headers = sum(bool(re.fullmatch(r"word/(header|footer)\d*\.xml", n)) for n in names)
        return {
            "paragraphs": len(paragraphs),
            "tables": sum(1 for _ in _all(body, "tbl")),
            "characters": sum(len(t.text or "") for t in _all(body, "t")),
            "styles": dict(sorted(styles.items())),
            "headers_footers": headers,
            "insertions": sum(1 for _ in _all(body, "ins")),
            "deletions": sum(1 for _ in _all(body, "del")),
            "comments": "word/comments.xml" in names,
            "hidden_text": sum(_attribute(v, "val") not in ("0", "false", "off") for v in _all(body, "vanish")),
            "external_links": sum(r["external"] for r in relations(z)),
            "embedded": sum("/embeddings/" in n for n in names),
        }


def _readable(message: email.message.EmailMessage) -> Iterator[str]:
    """Decoded text of the parts shown to a reader; unknown character sets are read as UTF-8."""
    stack = [message]
    while stack:
        part = stack.pop()
        if part.is_multipart():
            stack += reversed(list(part.iter_parts()))
        elif part.get_content_type().startswith("text/") and not part.is_attachment():
            raw = part.get_payload(decode=True) or b""
            try:
                yield raw.decode(part.get_content_charset("utf-8"), "replace")
            except LookupError:
                yield raw.decode("utf-8", "replace")


def _mail(data: bytes) -> dict:
    message = email.message_from_bytes(data, policy=email.policy.default)
    shown = "\n".join(_readable(message))
    attached = [(a.get_filename() or "", a.get_content_type(), a.get_payload(decode=True) or b"", a.get_content_charset()) for a in message.iter_attachments()]
    return {
        "subject": str(message["Subject"] or ""),
        "missing_headers": [h for h in ("From", "To", "Date", "Subject", "Message-ID") if not message[h]],
        "message_id": str(message["Message-ID"] or ""),
        "attachments": [{"name": n, "type": t, "binary": is_binary(n, raw, charset)} for n, t, raw, charset in attached],
        "body_characters": len(shown),
        "reply_markers": len(re.findall(REPLY, shown)),
    }


#: Suffixes and first bytes of attachments that hold no text.
BINARY_SUFFIXES = ("7z", "bin", "bz2", "docx", "exe", "gz", "gzip", "pdf", "pptx", "rar", "tar", "xlsx", "xz", "zip")
BINARY_STARTS = (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08", b"\x1f\x8b", b"\xfd7zXZ\x00", b"7z\xbc\xaf\x27\x1c", b"\xd0\xcf\x11\xe0", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff")
_CONTROL = re.compile("[\x00-\x08\x0b\x0e-\x1f\x7f-\x9f]")


def _executable(data: bytes) -> bool:
    """An old program header that leads to a newer one (PE, NE, LE or LX)."""
    if len(data) < 64 or data[:2] != b"MZ":
        return False
    at = struct.unpack_from("<I", data, 60)[0]
    return data[at : at + 4] == b"PE\0\0" or (at > 0 and data[at : at + 2] in (b"NE", b"LE", b"LX"))


def is_binary(name: str, data: bytes, charset: str | None = None) -> bool:
    """By suffix, first bytes, program headers, a whole PDF's structure, bytes that its character set does
    not have, or control characters in what should be text. An unknown character set is binary."""
    if _suffix(name) in BINARY_SUFFIXES or data.startswith(BINARY_STARTS) or _executable(data):
        return True
    if b"%PDF-" in data[:1024] and pdf.inspect(data)["problems"] in ([], ["compressed"]):
        return True
    try:
        text = data.decode(charset or "utf-8")
    except (LookupError, UnicodeError):
        return True
    return _CONTROL.search(text) is not None


# PNG

_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}


def _unfiltered(lines: np.ndarray, step: int = 1) -> np.ndarray:
    """Scanlines (filter, bytes...) with their filters undone: each byte is told from those left and above.

    step: bytes of a pixel; 1 for palette images, the only ones whose values are looked at.
    """
    out = np.zeros((len(lines), lines.shape[1] - 1), np.uint8)
    above = np.zeros(lines.shape[1] - 1, np.uint8)
    for r, line in enumerate(lines):
        kind, got = int(line[0]), line[1:]
        if kind == 0:
            out[r] = got
        elif kind == 1:  # sums from the left wrap at 256, and may be taken all at once
            for lane in range(step):
                out[r, lane::step] = np.cumsum(got[lane::step], dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            out[r] = got + above
        else:
            row, up = got.tolist(), above.tolist()
            for i, x in enumerate(row):
                left, b, corner = (row[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
                if kind == 3:
                    guess = (left + b) >> 1
                else:
                    to_left, to_up, to_corner = abs(b - corner), abs(left - corner), abs(left + b - 2 * corner)
                    guess = left if to_left <= to_up and to_left <= to_corner else b if to_up <= to_corner else corner
                row[i] = (x + guess) & 255
            out[r] = row
        above = out[r]
    return out


def _unpacked(rows: np.ndarray, width: int, depth: int) -> np.ndarray:
    """Values of ``depth`` bits out of bytes; the bits that fill a row's last byte are left out."""
    if depth == 8:
        return rows[:, :width]
    bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(len(rows), width, depth)
    return bits @ (1 << np.arange(depth - 1, -1, -1))


def _png(data: bytes) -> dict:
    """Chunk structure, checksums and raster of a PNG; problems are listed, none raises."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return {"problems": ["signature"]}
    problems, kinds, at, packed, header, palette = [], [], 8, [], None, 0
    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(data):
            problems.append("truncated")
            break
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            problems.append("checksum")
        if kind == b"IDAT" and packed and kinds[-1] != b"IDAT":
            problems.append("split_data")
        kinds.append(kind)
        if kind == b"IHDR" and n == 13:
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = n // 3
            if n % 3 or not 1 <= palette <= 256:
                problems.append("palette")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    if not kinds or kinds[0] != b"IHDR" or header is None or kinds.count(b"IHDR") > 1:
        return {"problems": sorted({*problems, "header"})}
    if kinds[-1] != b"IEND" or at != len(data):
        problems.append("end")
    width, height, depth, color, compression, filtering, interlace = header
    if color not in _CHANNELS or depth not in _DEPTHS[color] or compression or filtering or interlace > 1 or not width or not height:
        problems.append("header")
    if color == 3 and (not palette or b"PLTE" not in kinds[: kinds.index(b"IDAT") if b"IDAT" in kinds else 0]):
        problems.append("palette")
    out = {"width": width, "height": height, "problems": problems}
    if width * height > PNG_PIXELS:
        problems.append("too_many_pixels")
    elif "header" not in problems:
        bits = _CHANNELS[color] * depth
        passes = [(width, height)] if not interlace else [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))]
        rows = [(-(-w * bits // 8), h) for w, h in passes if w > 0 and h > 0]
        expected = sum((b + 1) * h for b, h in rows)
        try:
            stream = zlib.decompressobj()
            raw = stream.decompress(b"".join(packed), min(expected + 1, PNG_BYTES))
            if len(raw) != expected or not stream.eof:
                problems.append("raster_size")
            else:
                place = 0
                for (b, h), (w, _) in zip(rows, [p for p in passes if p[0] > 0 and p[1] > 0], strict=True):
                    lines = np.frombuffer(raw, np.uint8, (b + 1) * h, place).reshape(h, b + 1)
                    if (lines[:, 0] > 4).any():
                        problems.append("filter")
                    elif color == 3 and palette and int(_unpacked(_unfiltered(lines), w, depth).max()) >= palette:
                        problems.append("palette_index")
                    place += (b + 1) * h
        except zlib.error:
            problems.append("compressed_data")
    out["problems"] = sorted(set(problems))
    return out


def png_size(content: Column) -> Column:
    """(width, height) from a PNG's header, without decoding it."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).try_cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


def _text(data: bytes) -> dict:
    text = data.decode("utf-8", "replace")
    return {"characters": len(text), "lines": text.count("\n") + 1}


def _csv(data: bytes) -> dict:
    return dict(zip(("rows", "columns_max", "blank_rows"), tally(data), strict=True))


INSPECTORS: dict[str, Callable[[bytes], dict]] = {"csv": _csv, "docx": _docx, "eml": _mail, "pdf": pdf.inspect, "png": _png, "txt": _text, "xlsx": _xlsx}


#: The main part of each kind of package, and what its content type ends with.
MAIN_PARTS = {"docx": ("word/document.xml", "wordprocessingml.document.main+xml"), "xlsx": ("xl/workbook.xml", "spreadsheetml.sheet.main+xml")}


def _parts(z: zipfile.ZipFile, kind: str) -> list[str]:
    """Problems of a package's content types and of the parts that its main part needs."""
    names, (main, ending) = set(z.namelist()), MAIN_PARTS[kind]
    if "[Content_Types].xml" not in names:
        return ["content_types"]
    if main not in names:
        return ["main_part"]
    try:
        kinds = {(o.get("PartName") or "").lstrip("/"): o.get("ContentType") or "" for o in _all(_xml(z, "[Content_Types].xml"), "Override")}
        out = ["content_types"] * (not kinds.get(main, "").endswith(ending))
        if kind == "xlsx":
            targets = {r["id"]: r["target"] for r in relations(z) if r["source"] == main and not r["external"]}
            sheets = [targets.get(_attribute(s, "id") or "") for s in _all(_xml(z, main), "sheet")]
            out += ["worksheet_target"] * (not sheets or any(t not in names for t in sheets))
        return out
    except (ElementTree.ParseError, ValueError, KeyError):
        return ["content_types"]


def shape_findings(files: DataFrame) -> DataFrame:
    """(name, type, problem): files whose content does not have its type's shape.

    Unknown types are refused; office files need their main part; mail needs its headers and a body.
    """

    def each(path: str, data: bytes) -> Iterator[dict]:
        kind = _suffix(path)
        if kind not in INSPECTORS:
            yield {"name": path, "type": kind, "problem": "unsupported_type"}
            return
        d = inspected(kind, data)
        problems = list(d.get("problems") or [])
        if "unreadable" in d:
            problems.append("unreadable")
        if kind in ("docx", "xlsx") and not problems:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = z.namelist()
                problems += ["duplicate_member"] * (len(names) != len(set(names))) + _parts(z, kind)
        if kind == "csv" and (d.get("rows", 0) < 2 or d.get("columns_max", 0) < 2):
            problems.append("too_small")
        if kind == "eml":
            problems += [f"missing_{h.lower()}" for h in d.get("missing_headers", [])] + ["no_body"] * (not d.get("body_characters"))
        if kind == "pdf" and not d.get("pages"):
            problems.append("no_pages")
        if kind == "pdf" and d.get("pages") and (d.get("smallest_side") or 0) < SMALLEST_PAGE:
            problems.append("page_too_small")
        if kind == "png" and min(d.get("width", 0), d.get("height", 0)) < SMALLEST_IMAGE:
            problems.append("image_too_small")
        yield from ({"name": path, "type": kind, "problem": p} for p in sorted(set(problems)))

    schema = pa.schema([("name", pa.string()), ("type", pa.string()), ("problem", pa.string())])
    return _expand(files, each, schema, "name string, type string, problem string")
