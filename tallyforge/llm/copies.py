"""Records that are the same but for formatting, by dictionary encoding.

Each field has a dictionary: every distinct raw value a task meets is canonicalised once (letters and
digits only, without case) and gets an integer identifier. Identifiers are made from the canonical
value (64 bits of hash), so all tasks give a value the same integer without exchanging dictionaries, and
no value's text is ever shuffled. Records become tuples of the integers of their fields in a fixed field
order, whatever order they were written in, with one more integer from a second hash of every field,
so that 128 bits keep different records apart; the tuples are grouped.

Defined results
---------------
* Null text, text that lacks one of the labels, and a null id make no record to compare: left out.
* A value that is empty, or has no letters or digits, is the empty value, equal to other empty ones.
* Combining marks are neither letters nor digits. Backslash escapes of records written as JSON are undone.
* Repeated rows (same id and text) count once; very long texts are compared whole.
* Other columns of the input are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import skew
from tallyforge.session import durable

#: Label patterns of the fields, by name.
LABELS: Mapping[str, str] = {
    "entity_code": r"entity[\s_\-]*code",
    "account_code": r"account[\s_\-]*code",
    "description": r"description",
}
#: Entries of a task's dictionary of one field; beyond it the task starts a new one.
ENTRIES = 500_000
#: Groups of copies that are broadcast (40 bytes each); more meet their records in a shuffle.
BROADCAST_GROUPS = 200_000

_OTHER = re.compile(r"[^a-z0-9]+")
_ESCAPE = re.compile(r"\\[nrtbf]")


def canonical(value: str) -> str:
    """Letters and digits in order, case folded (upper first: it also folds letters that folding alone keeps)."""
    if value.isascii():
        return _OTHER.sub("", value.lower())
    return "".join(c for c in value.upper().casefold() if unicodedata.category(c)[0] in "LN")


class _Dictionary(dict):
    """Raw values of one field, each with its integer; ``check`` has the second hash."""

    def __init__(self) -> None:
        super().__init__()
        self.check: dict[str, int] = {}

    def __missing__(self, raw: str) -> int:
        plain = canonical(raw).encode()
        if len(self) >= ENTRIES:
            self.clear()
            self.check.clear()
        self[raw] = v = xxhash.xxh3_64_intdigest(plain)
        self.check[raw] = xxhash.xxh64_intdigest(plain, 11)
        return v

    def encode(self, raw: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The integers of values, and their second hashes."""
        if len(self) + len(raw) > ENTRIES:  # so that none is forgotten between the two reads
            self.clear()
            self.check.clear()
        v = np.fromiter(map(self.__getitem__, raw), np.uint64, len(raw))
        return v, np.fromiter(map(self.check.__getitem__, raw), np.uint64, len(raw))


def reader(labels: Mapping[str, str]) -> Callable[[str], list[str] | None]:
    """A function from a record's text to its raw values in the labels' order, each what stands between its
    label and the next label or the end; None where a label is missing. Of a repeated label the first counts.
    """
    cut = re.compile("|".join(f"({p})" for p in labels.values()), re.I | re.A).split
    n = len(labels)
    step = n + 1

    def read(text: str) -> list[str] | None:
        if "\\" in text:
            text = _undone(text)
        parts = cut(text)
        if len(parts) < step * n + 1:  # fewer labels than there must be
            return None
        out: list = [None] * n
        for i in range(1, len(parts), step):
            for k in range(n):
                if parts[i + k] is not None:
                    if out[k] is None:
                        out[k] = parts[i + n]
                    break
        return None if None in out else out

    return read


def _undone(text: str) -> str:
    """A record written with escapes: a JSON object as its pairs, any other text without its escapes' letters."""
    try:
        pairs = json.loads(text, strict=False)
    except ValueError:
        pairs = None
    if not isinstance(pairs, dict) or not pairs:
        return _ESCAPE.sub(" ", text)
    shown = lambda v: v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False)
    return " | ".join(f"{k}: {shown(v)}" for k, v in pairs.items())


def _complete(df: DataFrame, record_id: str, text: str) -> DataFrame:
    line, number = F.col(f"`{text}`"), F.col(f"`{record_id}`")
    return df.filter(line.isNotNull() & number.isNotNull()).select(number.cast("bigint").alias("id"), line.alias("text"))


def encoded(df: DataFrame, record_id: str, text: str, labels: Mapping[str, str] = LABELS) -> DataFrame:
    """(id, v0, v1, ..., v): each record as the integers of its fields and their common check, kept in the
    checkpoint folder. One pass, without a shuffle."""
    names = [*[f"v{i}" for i in range(len(labels))], "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader(labels)
        known = [_Dictionary() for _ in labels]
        for batch in batches:
            raw = list(map(read, batch.column(1).to_pylist()))
            whole = np.fromiter((r is not None for r in raw), bool, len(raw))
            columns = list(zip(*[r for r in raw if r is not None], strict=True)) or [()] * len(labels)
            check = np.zeros(int(whole.sum()), np.uint64)
            out = []
            for field, values in zip(known, columns, strict=True):
                v, second = field.encode(list(values))
                out.append(v.view(np.int64))
                check = (check ^ second) * np.uint64(0x9E3779B97F4A7C15) + (check >> np.uint64(29))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(whole)), *map(pa.array, out), pa.array(check.view(np.int64))], names=["id", *names])

    return durable(_complete(df, record_id, text).mapInArrow(run, "id bigint, " + ", ".join(f"{n} bigint" for n in names)))


def dictionary(df: DataFrame, record_id: str, text: str, labels: Mapping[str, str] = LABELS) -> DataFrame:
    """(field, v, value, spellings, records): the fields' dictionaries, one row for each canonical value.

    Tasks count within their own dictionaries before anything is shuffled; spellings are raw values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader(labels)
        counts = [Counter() for _ in labels]

        def entries() -> pa.RecordBatch:
            rows = [(f, raw, n) for f, c in zip(labels, counts, strict=True) for raw, n in c.items()]
            plain = [canonical(raw) for _, raw, _ in rows]
            v = np.fromiter((xxhash.xxh3_64_intdigest(p.encode()) for p in plain), np.uint64, len(rows)).view(np.int64)
            spelled = np.fromiter((xxhash.xxh3_64_intdigest(raw.encode("utf-8", "surrogatepass")) for _, raw, _ in rows), np.uint64, len(rows)).view(np.int64)
            columns = [pa.array([f for f, *_ in rows], pa.string()), pa.array(v), pa.array(plain, pa.string()), pa.array(spelled), pa.array([n for *_, n in rows], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["field", "v", "value", "spelling", "records"])

        for batch in batches:
            for r in map(read, batch.column(1).to_pylist()):
                if r is not None:
                    for c, value in zip(counts, r, strict=True):
                        c[value] += 1
            if sum(map(len, counts)) > ENTRIES:
                yield entries()
                for c in counts:
                    c.clear()
        yield entries()

    rows = _complete(df, record_id, text).distinct().mapInArrow(run, "field string, v bigint, value string, spelling bigint, records bigint")
    by_spelling = rows.groupBy("field", "v", "value", "spelling").agg(F.sum("records").alias("records"))
    return by_spelling.groupBy("field", "v", "value").agg(F.count(F.lit(1)).alias("spellings"), F.sum("records").alias("records"))


def groups(tuples: DataFrame) -> DataFrame:
    """(tuple..., keep_id, n): one row for each distinct record, with its smallest id and its copies."""
    keys = [c for c in tuples.columns if c != "id"]
    return tuples.groupBy(*keys).agg(F.min("id").alias("keep_id"), F.count_distinct("id").alias("n"))


def copies(tuples: DataFrame) -> DataFrame:
    """(keep_id, copy_id): the smallest id of each group with each of the others.

    Groups are counted with a map-side combine, so a group of a third of all rows is one row a task;
    those of one row are dropped before the records are read again.
    """
    keys = [c for c in tuples.columns if c != "id"]
    many = durable(tuples.groupBy(*keys).agg(F.min("id").alias("keep_id"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).filter("last > keep_id").drop("last"))
    if many.count() <= BROADCAST_GROUPS:
        met = tuples.join(F.broadcast(many.drop("n")), keys)
    else:
        met = skew.look_up(tuples, many, keys, "n")
    return met.filter("id > keep_id").select("keep_id", F.col("id").alias("copy_id")).distinct()
