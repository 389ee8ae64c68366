"""Carriers of rows and documents in files: delimited text, JSON documents, lines of JSON.

Cells are read as text; types are checked and cast later. Row ordinals are data ordinals in their
file, from 2, since the header is row 1.
"""

from __future__ import annotations

import csv
import io
import json
import os
import tomllib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PARSED = "path string, problem string, ordinal bigint, width int, headers array<string>, cells array<string>"


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, length, content, sha256) of the files below a folder; the reader leaves out files of no bytes."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return read.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content", F.sha2("content", 256).alias("sha256"))


def strict_rows(content: DataFrame) -> DataFrame:
    """Rows of delimited files (path, content), parsed strictly; one row a record, or one with a problem.

    Invalid UTF-8 and broken quoting are the file's problem ``unreadable``; wrong widths are each row's
    ``width``; a blank line is no record. A file is one task's, since one broken quote makes all of it
    unreadable; files too large for that are read by ``lines``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _records(path, data.as_py())

    return content.select("path", "content").mapInArrow(run, _PARSED)


_SCHEMA = pa.schema([("path", pa.string()), ("problem", pa.string()), ("ordinal", pa.int64()), ("width", pa.int32()), ("headers", pa.list_(pa.string())), ("cells", pa.list_(pa.string()))])


def _records(path: str, data: bytes) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    ready: list[dict] = []
    try:
        rows = csv.reader(io.StringIO(data.decode("utf-8-sig"), newline=""), strict=True)
        headers = next(rows, [])
        ordinal = 1
        for cells in rows:
            if not cells:
                continue
            ordinal += 1
            held.append({"path": path, "problem": None if len(cells) == len(headers) else "width", "ordinal": ordinal, "width": len(cells), "headers": headers, "cells": cells})
        ready = held or [{"path": path, "problem": "no_rows", "ordinal": None, "width": len(headers), "headers": headers, "cells": []}]
    except (UnicodeDecodeError, csv.Error):
        ready = [{"path": path, "problem": "unreadable", "ordinal": None, "width": None, "headers": None, "cells": None}]
    for i in range(0, len(ready), 5000):
        yield pa.RecordBatch.from_pylist(ready[i : i + 5000], schema=_SCHEMA)


def header_problems(rows: DataFrame) -> DataFrame:
    """Files whose headers are empty, blank or repeated."""
    heads = rows.select("path", "headers").distinct()
    clean = F.transform("headers", F.trim)
    return heads.filter((F.size("headers") == 0) | F.exists(clean, lambda h: h == "") | (F.size(F.array_distinct("headers")) < F.size("headers")))


def exact_header(rows: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Files whose header is not exactly the expected list, in order."""
    return rows.filter(~F.coalesce(F.col("headers") == F.array(*map(F.lit, expected)), F.lit(False))).select("path", "headers").distinct()


def named(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The good rows as columns by header name; a header that is missing gives nulls."""
    place = lambda c: F.array_position("headers", c)
    good = rows.filter("problem is null")
    return good.select("path", "ordinal", *[F.when(place(c) > 0, F.get("cells", (place(c) - 1).cast("int"))).alias(c) for c in columns])


def tally(data: bytes) -> tuple[int, int, int]:
    """Records, widest record and blank records of delimited bytes; damaged UTF-8 is read past."""
    n = widest = blank = 0
    with io.TextIOWrapper(io.BytesIO(data), "utf-8-sig", "replace", newline="") as text:
        for n, cells in enumerate(csv.reader(text), 1):  # noqa: B007
            widest = max(widest, len(cells))
            blank += not "".join(cells).strip()
    return n, widest, blank


def metrics(content: DataFrame) -> DataFrame:
    """(path, rows, max_width, blank_rows): the header counts as a row."""
    schema = pa.schema([("path", pa.string()), ("rows", pa.int64()), ("max_width", pa.int32()), ("blank_rows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [tally(data.as_py()) for data in batch.column(1)]
            columns = zip(*counted, strict=True) if counted else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]], schema=schema)

    return content.select("path", "content").mapInArrow(run, "path string, rows bigint, max_width int, blank_rows bigint")


def shape_problems(content: DataFrame) -> DataFrame:
    """Delimited files with fewer than two rows or two columns, or rows of unequal width."""
    rows = strict_rows(content)
    by = rows.groupBy("path").agg(F.count_if(F.col("cells").isNotNull() & (F.size("cells") > 0)).alias("data_rows"), F.max(F.size("headers")).alias("columns"), F.count_if(F.col("problem") == "width").alias("ragged"), F.count_if(F.col("problem") == "unreadable").alias("unreadable"))
    return by.filter("data_rows < 1 or columns < 2 or ragged > 0 or unreadable > 0")


def json_documents(spark: SparkSession, folder: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """Whole-file JSON documents under an explicit schema, with their path; ``_corrupt`` holds a text that does not fit."""
    texts = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder)
    return _under(texts.select(F.col("_metadata.file_path").alias("path"), "value"), schema)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; other lines keep their text in ``_corrupt``."""
    return _under(spark.read.text(path).filter("trim(value) <> ''").select(F.col("_metadata.file_path").alias("path"), "value"), schema)


def _under(texts: DataFrame, schema: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return texts.select("path", F.from_json("value", F.lit(f"{schema}, _corrupt string"), options).alias("d")).select("path", "d.*")


def toml_documents(content: DataFrame) -> DataFrame:
    """(path, document, problem) of TOML files (path, content): each as JSON with sorted keys, or ``unreadable``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str | None, str | None]] = []
            for data in batch.column(1):
                try:
                    read = tomllib.loads(data.as_py().decode("utf-8"))
                    out.append((json.dumps(read, sort_keys=True, ensure_ascii=False, default=str), None))
                except (AttributeError, UnicodeDecodeError, tomllib.TOMLDecodeError, RecursionError):
                    out.append((None, "unreadable"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d for d, _ in out], pa.string()), pa.array([p for _, p in out], pa.string())], names=["path", "document", "problem"])

    return content.select("path", "content").mapInArrow(run, "path string, document string, problem string")


def links(root: str) -> list[str]:
    """Paths below a local or mounted root, and the root itself, that are links: what a governed folder must not have."""
    found = [root] if os.path.islink(root) else []
    for at, folders, names in os.walk(root):
        found += [path for n in (*folders, *names) if os.path.islink(path := os.path.join(at, n))]
    return sorted(found)


def lines(spark: SparkSession, folder: str, header: Sequence[str], pattern: str = "*.csv") -> DataFrame:
    """(path, raw_line): the records of delimited files whose records are lines, for ``malformed.classify``.

    The text reader splits large files, so a file is read by as many tasks as it needs. Lines that equal
    the header, blank lines, and a byte order mark are left out; ``first_lines`` tells of other headers.
    A record that holds a line break comes out as its lines, which ``classify`` finds malformed; read such
    files with ``strict_rows``.
    """
    return _lines(spark, folder, pattern).filter((F.col("raw_line") != ",".join(header)) & (F.trim("raw_line") != "")).select("path", "raw_line")


def first_lines(spark: SparkSession, folder: str, header: Sequence[str], pattern: str = "*.csv") -> DataFrame:
    """(path, first): files whose first line is not the header, with what it is. One row a task is shuffled."""
    at = F.struct("start", "at")
    first = _lines(spark, folder, pattern).groupBy("path").agg(F.min_by("raw_line", at).alias("first"))
    return first.filter(F.col("first") != ",".join(header))


def _lines(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder)
    return read.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\\A\ufeff|\r\\z", "").alias("raw_line"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))


def not_objects(texts: DataFrame, column: str) -> DataFrame:
    """Rows whose text is no JSON object: malformed, or of another kind."""
    kind = F.schema_of_variant(F.try_parse_json(F.col(column)))
    return texts.filter(~F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False)))


def entries(documents: DataFrame, array: str) -> DataFrame:
    """The entries of a catalog document, one row each, with their place."""
    return documents.select("path", F.posexplode(array).alias("place", "entry")).select("path", "place", "entry.*")


def misplaced(listing: DataFrame, pattern: str) -> DataFrame:
    """Files of a governed folder whose name does not match."""
    return listing.filter(~F.col("name").rlike(pattern))
