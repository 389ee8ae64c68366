"""Rules over whole JSON documents: closed schemas, and keys that must not occur at any depth."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import scalars
from tallyforge.functions.scalars import pointer
from tallyforge.functions.structure import index

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
_FOUND = pa.schema([("subject", pa.string()), ("location", pa.string()), ("problem", pa.string())])


def _is(value: object, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES[kind]) and not (kind != "boolean" and isinstance(value, bool))


def _same(a: object, b: object) -> bool:
    return type(a) is type(b) and a == b or (_is(a, "number") and _is(b, "number") and a == b)


def problems(value: object, schema: Mapping | bool, root: Mapping | None = None, at: str = "") -> Iterator[tuple[str, str]]:
    """(location, keyword) of each rule that a value breaks.

    The keywords of closed record schemas: type, const, enum, required, properties, patternProperties,
    additionalProperties, propertyNames, items, prefixItems, contains, uniqueItems, bounds of numbers, lengths and sizes, pattern,
    allOf, anyOf, oneOf, not, if/then/else, and references within the schema.
    """
    if isinstance(schema, bool):
        if not schema:
            yield at, "false"
        return
    root = root if root is not None else schema
    if "$ref" in schema:
        target: object = root
        for step in schema["$ref"].removeprefix("#").split("/")[1:]:
            target = target[step.replace("~1", "/").replace("~0", "~")]  # type: ignore[index]
        yield from problems(value, target, root, at)  # type: ignore[arg-type]
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        yield at, "type"
        return
    if "const" in schema and not _same(value, schema["const"]):
        yield at, "const"
    if "enum" in schema and not any(_same(value, e) for e in schema["enum"]):
        yield at, "enum"
    holds = lambda s: next(problems(value, s, root, at), None) is None
    for s in schema.get("allOf", ()):
        yield from problems(value, s, root, at)
    if "anyOf" in schema and not any(map(holds, schema["anyOf"])):
        yield at, "anyOf"
    if "oneOf" in schema and sum(map(holds, schema["oneOf"])) != 1:
        yield at, "oneOf"
    if "not" in schema and holds(schema["not"]):
        yield at, "not"
    if "if" in schema:
        branch = schema.get("then" if holds(schema["if"]) else "else")
        if branch is not None:
            yield from problems(value, branch, root, at)
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            yield at, "length"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            yield at, "pattern"
    elif _is(value, "number"):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value) or value <= schema.get("exclusiveMinimum", float("-inf")) or value >= schema.get("exclusiveMaximum", float("inf")):  # type: ignore[operator]
            yield at, "bounds"
    elif isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", len(value)):
            yield at, "size"
        if schema.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in value}) < len(value):
            yield at, "uniqueItems"
        lead = schema.get("prefixItems", ())
        for i, v in enumerate(value):
            rule = lead[i] if i < len(lead) else schema.get("items", True)
            yield from problems(v, rule, root, f"{at}/{i}")
        if "contains" in schema and not any(next(problems(v, schema["contains"], root), None) is None for v in value):
            yield at, "contains"
    elif isinstance(value, dict):
        for k in schema.get("required", ()):
            if k not in value:
                yield f"{at}/{k}", "required"
        if len(value) < schema.get("minProperties", 0) or len(value) > schema.get("maxProperties", len(value)):
            yield at, "size"
        known, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        for k, v in value.items():
            if "propertyNames" in schema and next(problems(k, schema["propertyNames"], root), None) is not None:
                yield f"{at}/{k}", "propertyNames"
            rules = ([known[k]] if k in known else []) + [s for p, s in patterns.items() if re.search(p, k)]
            if not rules:
                extra = schema.get("additionalProperties", True)
                if extra is False:
                    yield f"{at}/{k}", "additionalProperties"
                    continue
                rules = [extra]
            for s in rules:
                yield from problems(v, s, root, f"{at}/{k}")


def forbidden(value: object, keys: Sequence[str], patterns: Sequence[str] = (), at: str = "") -> Iterator[tuple[str, str]]:
    """(location, problem) of keys that must not occur, and of texts that look like what must not, at any depth."""
    if isinstance(value, dict):
        for k, v in value.items():
            if k.casefold() in keys:
                yield f"{at}/{k}", "forbidden_key"
            yield from forbidden(v, keys, patterns, f"{at}/{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from forbidden(v, keys, patterns, f"{at}/{i}")
    elif isinstance(value, str) and any(re.search(p, value) for p in patterns):
        yield at, "forbidden_text"


def _each(df: DataFrame, subject: str, text: str, rule) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = list(rule(json.loads(body))) if body is not None else [("", "unreadable")]
                except (ValueError, RecursionError):
                    found = [("", "unreadable")]
                out += [{"subject": name, "location": a, "problem": b} for a, b in found]
            yield pa.RecordBatch.from_pylist(out, schema=_FOUND)

    return df.select(F.col(f"`{subject}`").cast("string").alias("subject"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "subject string, location string, problem string")


def schema_findings(df: DataFrame, subject: str, text: str, schema: Mapping) -> DataFrame:
    """(subject, location, problem): every rule of a schema that documents break; null or malformed text is ``unreadable``."""
    return _each(df, subject, text, lambda d: problems(d, schema))


def forbidden_findings(df: DataFrame, subject: str, text: str, keys: Sequence[str], patterns: Sequence[str] = ()) -> DataFrame:
    """(subject, location, problem) of forbidden keys and texts at any depth."""
    lowered = tuple(k.casefold() for k in keys)
    return _each(df, subject, text, lambda d: forbidden(d, lowered, patterns))


def object_flags(df: DataFrame, text: str) -> DataFrame:
    """df with ``is_object``: whether a text is a whole JSON object, judged by the structural index of each batch.

    Null, blank and malformed texts, and texts of another kind, are none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            raw = [t.encode("utf-8", "surrogatepass") if t is not None else None for t in batch.column(at).to_pylist()]
            ix = index(raw)
            held = np.maximum(ix.root, 0)
            flags = (ix.root >= 0) & ~ix.bad & ~(ix.is_array[held] if len(ix.is_array) else np.ones(len(raw), bool))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags)], names=[*batch.schema.names, "is_object"])

    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", is_object boolean")


def pointed(df: DataFrame, text: str, carry: Sequence[str], pointers: Sequence[str]) -> DataFrame:
    """(carry..., pointer, value): what each JSON pointer finds in each text; texts as they stand, anything
    else as JSON. Null where the text is malformed or the pointer leads nowhere, or to null."""
    types = dict(df.dtypes)

    def value(document: object, path: str) -> str | None:
        try:
            found = pointer(document, path)
        except (KeyError, IndexError, ValueError, TypeError):
            return None
        return found if found is None or isinstance(found, str) else json.dumps(found, ensure_ascii=False, separators=(",", ":"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body in batch.column(len(carry)).to_pylist():
                try:
                    document = json.loads(body) if body is not None else None
                except (ValueError, RecursionError):
                    document = None
                out += [value(document, p) if document is not None else None for p in pointers]
            rows = np.repeat(np.arange(batch.num_rows), len(pointers))
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns[:-1], pa.array(list(pointers) * batch.num_rows), pa.array(out, pa.string())], names=[*carry, "pointer", "value"])

    return df.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`")).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in carry) + ", pointer string, value string")


def patched(df: DataFrame, text: str, carry: Sequence[str], operations: Sequence[Mapping[str, object]]) -> DataFrame:
    """(carry..., document, problem): each text with ``replace`` and ``remove`` operations applied in turn.

    Where an operation's target does not exist the document is null and the problem ``no_target``; for a
    null or malformed text it is ``unreadable``. Nothing is applied in part.
    """
    types = dict(df.dtypes)

    def one(body: str | None) -> tuple[str | None, str | None]:
        try:
            document = json.loads(body or "")
        except (ValueError, RecursionError):
            return None, "unreadable"
        try:
            return json.dumps(scalars.patched(document, operations), ensure_ascii=False, separators=(",", ":")), None
        except (KeyError, IndexError, TypeError, ValueError):
            return None, "no_target"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(body) for body in batch.column(len(carry)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([d for d, _ in made], pa.string()), pa.array([p for _, p in made], pa.string())], names=[*carry, "document", "problem"])

    return df.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`")).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in carry) + ", document string, problem string")
