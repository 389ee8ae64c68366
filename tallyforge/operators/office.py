"""Surfaces of office packages as tables and findings: text, properties, formats, hidden parts, formula evidence."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import scalars
from tallyforge.operators.findings import finding, together
from tallyforge.sources import artifacts as a

#: Core properties that tell of a document's making.
STALE = ("creator", "lastModifiedBy", "created", "modified")
_UNREADABLE = (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError, IndexError)


def _safe(each):  # noqa: ANN001, ANN202
    """A parser that gives what it could read of a package; parts it could not read are rows of ``surfaces``."""

    def run(path: str, data: bytes) -> Iterator[dict]:
        try:
            yield from each(path, data)
        except _UNREADABLE:
            return

    return run


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    """A part's root; None where it is absent or cannot be read."""
    try:
        return a._xml(z, name)
    except _UNREADABLE:
        return None


def _surfaces(path: str, data: bytes) -> Iterator[dict]:
    try:
        package = zipfile.ZipFile(io.BytesIO(data))
    except _UNREADABLE:
        yield {"path": path, "member": "", "surface": "malformed", "text": "package"}
        return
    with package as z:
        for name in dict.fromkeys(z.namelist()):
            if not name.lower().endswith((".xml", ".rels", ".vml")):
                continue
            root = _part(z, name)
            if root is None:
                yield {"path": path, "member": name, "surface": "malformed", "text": "part"}
                continue
            # runs of one item are one text, so that a token cut over runs is seen whole
            items = [e for e in root.iter() if a._local(e.tag) in ("si", "is", "p")]
            for e in items:
                yield {"path": path, "member": name, "surface": "item", "text": "".join(t.text or "" for t in a._all(e, "t"))}
            for e in root.iter():
                for surface, text in (("text", e.text), ("tail", e.tail), *(("attribute", v) for v in e.attrib.values())):
                    if text and text.strip():
                        yield {"path": path, "member": name, "surface": surface, "text": text}


def surfaces(files: DataFrame) -> DataFrame:
    """(path, member, surface, text): every text, tail and attribute of a package's XML, and items with their runs joined.

    A part that cannot be read is one row of surface ``malformed``, and hides no other part; so is a
    package that is none.
    """
    schema = pa.schema([("path", pa.string()), ("member", pa.string()), ("surface", pa.string()), ("text", pa.string())])
    return a._expand(files, _safe(_surfaces), schema, "path string, member string, surface string, text string")


def tokens(texts: DataFrame) -> DataFrame:
    """(path, token, members): unfilled slots and the members they stand in (a package has few)."""
    each = texts.select("path", "member", F.explode(scalars.found_tokens(F.col("text"))).alias("token"))
    return each.groupBy("path", "token").agg(F.array_sort(F.collect_set("member")).alias("members"))


def phrases(texts: DataFrame) -> DataFrame:
    """(path, code, members) of prohibited phrases."""
    each = texts.select("path", "member", F.explode(scalars.prohibited(F.col("text"))).alias("code"))
    return each.groupBy("path", "code").agg(F.array_sort(F.collect_set("member")).alias("members"))


def _properties(path: str, data: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        core, custom = (_part(z, n) if n in names else None for n in ("docProps/core.xml", "docProps/custom.xml"))
        if core is not None:
            for e in core:
                yield {"path": path, "kind": "core", "name": a._local(e.tag), "value": e.text}
        if custom is not None:
            for e in a._all(custom, "property"):
                yield {"path": path, "kind": "custom", "name": e.get("name"), "value": "".join(e.itertext())}


def properties(files: DataFrame) -> DataFrame:
    """(path, kind, name, value) of core and custom properties."""
    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("value", pa.string())])
    return a._expand(files, _safe(_properties), schema, "path string, kind string, name string, value string")


def _formats(path: str, data: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "xl/styles.xml" not in z.namelist():
            return
        root = a._xml(z, "xl/styles.xml")
        custom = {int(f.get("numFmtId")): f.get("formatCode") for f in a._all(root, "numFmt")}
        for table in a._all(root, "cellXfs"):
            for i, x in enumerate(e for e in table if a._local(e.tag) == "xf"):
                n = int(x.get("numFmtId") or 0)
                yield {"path": path, "style": i, "format_id": n, "format": custom.get(n)}


def number_formats(files: DataFrame) -> DataFrame:
    """(path, style, format_id, format): what a cell's style says of its number format; null for built-in ones."""
    schema = pa.schema([("path", pa.string()), ("style", pa.int32()), ("format_id", pa.int32()), ("format", pa.string())])
    return a._expand(files, _safe(_formats), schema, "path string, style int, format_id int, format string")


def _columns(path: str, data: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        targets = {r["target"]: r["id"] for r in a.relations(z) if r["source"] == "xl/workbook.xml"}
        sheets = {a._attribute(s, "id"): s.get("name") for s in a._all(a._xml(z, "xl/workbook.xml"), "sheet")}
        for name in sorted(targets):
            root = _part(z, name) if name in z.namelist() else None
            if root is None or targets[name] not in sheets:
                continue
            grid = next((v.get("showGridLines") for v in a._all(root, "sheetView")), None)
            yield {"path": path, "sheet": sheets[targets[name]], "first": None, "last": None, "width": None, "hidden": False, "gridlines": grid not in ("0", "false")}
            for c in a._all(root, "col"):
                yield {"path": path, "sheet": sheets[targets[name]], "first": int(c.get("min") or 0), "last": int(c.get("max") or c.get("min") or 0), "width": c.get("width"), "hidden": c.get("hidden") in ("1", "true"), "gridlines": None}


def column_runs(files: DataFrame) -> DataFrame:
    """(path, sheet, first, last, width, hidden, gridlines): runs of columns as declared, and one row a sheet (first null) with its gridlines."""
    schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("width", pa.string()), ("hidden", pa.bool_()), ("gridlines", pa.bool_())])
    return a._expand(files, _safe(_columns), schema, "path string, sheet string, first int, last int, width string, hidden boolean, gridlines boolean")


def _links(path: str, data: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for r in a.relations(z):
            yield {"path": path, **r}


def relationships(files: DataFrame) -> DataFrame:
    """(path, source, id, type, target, external) of a package's parts."""
    schema = pa.schema([("path", pa.string()), ("source", pa.string()), ("id", pa.string()), ("type", pa.string()), ("target", pa.string()), ("external", pa.bool_())])
    return a._expand(files, _safe(_links), schema, "path string, source string, id string, type string, target string, external boolean")


def _native(path: str, data: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        links = [r for r in a.relations(z) if not r["external"]]
        sheets = {r["target"]: r["id"] for r in links if r["source"] == "xl/workbook.xml"}
        called = {a._attribute(s, "id"): s.get("name") for s in a._all(a._xml(z, "xl/workbook.xml"), "sheet")}
        for r in links:
            root = _part(z, r["target"]) if r["type"] == "table" and r["target"] in names else None
            if root is not None:
                yield {"path": path, "sheet": called.get(sheets.get(r["source"])), "name": root.get("displayName") or root.get("name"), "ref": root.get("ref"), "columns": [c.get("name") for c in a._all(root, "tableColumn")]}


def native_tables(files: DataFrame) -> DataFrame:
    """(path, sheet, name, ref, columns) of the tables that a workbook's sheets hold."""
    schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("name", pa.string()), ("ref", pa.string()), ("columns", pa.list_(pa.string()))])
    return a._expand(files, _safe(_native), schema, "path string, sheet string, name string, ref string, columns array<string>")


def layouts(cells: DataFrame, formats: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(path, sheet, fingerprint): a hash of how often each style and number format occurs in a sheet, and
    of its gridlines and column widths (runs: what ``column_runs`` gives)."""
    if runs is not None:
        shape = runs.groupBy("path", "sheet").agg(F.max("gridlines").alias("grid"), F.array_sort(F.collect_list(F.struct("first", "last", "width"))).alias("widths"))  # a sheet has few runs
        plain = layouts(cells, formats)
        return plain.join(shape, ["path", "sheet"], "left").select("path", "sheet", F.sha2(F.to_json(F.struct("fingerprint", "grid", "widths")), 256).alias("fingerprint"))
    counts = cells.join(formats, ["path", "style"], "left").groupBy("path", "sheet", "style", "format_id").agg(F.count(F.lit(1)).alias("n"))
    # a sheet's styles are at most a package's, some tens of thousands
    return counts.groupBy("path", "sheet").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("style", F.coalesce("format_id", F.lit(-1)).alias("format_id"), "n")))), 256).alias("fingerprint"))


#: Fixed value: a formula that is empty where the cell it guards is.
_GUARD = r'(?i)^\s*IF\(\s*(\$?[A-Z]{1,3}\$?\d+)\s*=\s*""\s*,\s*""\s*,'


def empty_caches(cells: DataFrame) -> DataFrame:
    """Formula cells without a cached value, and whether that is right: their guard cell is blank."""
    guard = F.replace(F.regexp_extract("formula", _GUARD, 1), F.lit("$"))
    bare = cells.filter("formula is not null and (value is null or value = '')").select("path", "sheet", "cell", F.upper(guard).alias("guard"))
    held = cells.filter("value is not null and value <> ''").select("path", "sheet", F.col("cell").alias("guard"), F.lit(True).alias("filled")).distinct()
    joined = bare.join(held, ["path", "sheet", "guard"], "left")
    return joined.select("path", "sheet", "cell", ((F.col("guard") != "") & F.col("filled").isNull()).alias("valid"))


def formula_evidence(cells: DataFrame, controls: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(path, formulas, cached, errors, structure, results, controls): what a workbook's formulas are and gave.

    structure and results are order-free sums of row hashes, so a workbook of any size is hashed without
    gathering its cells. controls: the values of some (sheet, cell) places.
    """
    f = cells.filter("formula is not null")
    error = scalars.formula_error(F.col("value"), F.col("formula"), F.col("kind"))
    digest = lambda *c: F.sum(F.xxhash64(*c).bitwiseAND(F.lit(0xFFFFFFFFFF)))
    place = [F.when((F.col("sheet") == s) & (F.col("cell") == c), F.col("value")) for s, c in controls]
    named = F.struct(*[F.max(p).alias(f"{s}!{c}") for p, (s, c) in zip(place, controls, strict=True)]) if controls else F.lit(None)
    return f.groupBy("path").agg(
        F.count(F.lit(1)).alias("formulas"),
        F.count_if(F.col("value").isNotNull()).alias("cached"),
        F.count_if(error).alias("errors"),
        digest("sheet", "cell", "formula").alias("structure"),
        digest("sheet", "cell", F.coalesce("value", F.lit(""))).alias("results"),
        named.alias("controls"),
    )


def findings(files: DataFrame, allow_hidden: Sequence[str] = (), require_formulas: bool = False) -> DataFrame:
    """Everything about workbooks and documents that a clean package must not have."""
    path = F.col("path")
    cells = a.workbook_cells(files.filter("lower(name) like '%.xlsx'"))
    texts, props = surfaces(files), properties(files)
    shown = ~F.col("sheet").isin(*allow_hidden) if allow_hidden else F.lit(True)
    parts = [
        finding(cells.filter(F.col("sheet_hidden") & shown).select("path", "sheet").distinct(), "hidden_sheet", path, F.col("sheet")),
        finding(cells.filter(F.col("row_hidden") & shown).select("path", "sheet", F.regexp_extract("cell", r"\d+", 0).alias("row")).distinct(), "hidden_row", path, F.concat_ws("!", "sheet", "row")),
        finding(cells.filter(scalars.formula_error(F.col("value"), F.col("formula"), F.col("kind"))), "formula_error", path, F.concat_ws("!", "sheet", "cell")),
        finding(tokens(texts), "unresolved_token", path, F.col("token")),
        finding(phrases(texts), "prohibited_phrase", path, F.col("code")),
        finding(props.filter(F.col("name").isin(*STALE) | (F.col("kind") == "custom")), "stale_metadata", path, F.col("name"), severity="warning"),
    ]
    members = a.members(files.select(F.concat(path, F.lit(".zip")).alias("path"), "content")).filter("container is not null")
    owner = F.regexp_replace("container", r"\.zip$", "")
    surplus = F.when(F.col("name").contains("/embeddings/"), "embedded_object").when(F.col("name").rlike(r"(?i)/(threaded)?comments?[^/]*\.xml$"), "comments").when(F.col("name").startswith("customXml/"), "custom_xml").when(F.col("name").startswith("xl/externalLinks/"), "external_link").when(F.col("name") == "xl/connections.xml", "connection")
    for rule in ("embedded_object", "comments", "custom_xml", "external_link", "connection"):
        parts.append(finding(members.filter(surplus == rule), rule, owner, F.col("name")))
    parts += [
        finding(texts.filter("surface = 'malformed'"), "malformed_part", path, F.concat_ws(": ", "text", F.nullif(F.col("member"), F.lit("")))),
        finding(column_runs(files).filter(F.col("hidden") & shown), "hidden_columns", path, F.concat_ws("!", "sheet", F.concat_ws(":", "first", "last"))),
        finding(relationships(files).filter("external"), "external_relationship", path, F.concat_ws(" ", "type", "target")),
    ]
    if require_formulas:
        none = files.filter("lower(name) like '%.xlsx'").select("path").join(cells.filter("formula is not null").select("path").distinct(), "path", "left_anti")
        parts.append(finding(none, "no_formulas", path, F.lit("")))
    return together(parts).orderBy("rule", "subject", "detail")


def proof_problems(proofs: DataFrame, required: Sequence[str]) -> DataFrame:
    """(path, problem): proofs shorter than 64 bytes, or that lack one of the texts (columns) they must contain."""
    text = F.col("content").cast("string")
    checks = F.array_compact(F.array(F.when(F.length("content") < 64, F.lit("too_short")), *[F.when(~F.coalesce(F.contains(text, F.col(c)), F.lit(False)), F.lit(f"lacks_{c}")) for c in required]))
    return proofs.select("path", F.explode(checks).alias("problem"))
