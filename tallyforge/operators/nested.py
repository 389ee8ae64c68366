"""Deeply nested records as related flat tables.

Each text of JSON is read through a structural index of its whole batch (functions.structure); the
rows of all flat tables come out of one pass without a shuffle, tagged by kind and linked to their
record and their parent's place in it.

Defined results
---------------
* Null, blank and malformed texts give no rows but one of kind ``malformed`` (asked for separately).
* An absent, null or empty part gives no rows; null elements keep their place but give no row.
* A value that stands where an array is expected is that array's only element.
* A field repeated within one object counts once, with its last value.
* Very long texts are indexed alone; nothing is cut. Equal texts under several ids give rows for each.
* Columns of the input named in ``carry`` come along; all others are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.structure import Index, index

#: Bytes of text indexed at once. An index holds about ten times its texts.
BATCH_BYTES = 4_000_000


@dataclass(frozen=True)
class Child:
    """Children of a parent object.

    kind: its table. path: the field that holds them. key: the field that is a child's key.
    bare: a text in a child's place is its key. by_field: the children are the fields of one object,
    and the field's name completes the kind.
    """

    kind: str
    path: str
    key: str
    bare: bool = False
    by_field: bool = False


@dataclass(frozen=True)
class Layout:
    """One array of parents in each record, and their children.

    attributes: fields that a row of any kind shows of its own object. inherit: fields of the parent that
    all its rows show, as ``parent_`` and the field, so that children need no join to their parent.
    """

    parents: str
    parent_kind: str
    parent_key: str
    children: Sequence[Child]
    attributes: Sequence[str] = field(default=())
    inherit: Sequence[str] = field(default=())

    @property
    def columns(self) -> list[str]:
        return [*self.attributes, *(f"parent_{a}" for a in self.inherit)]


PROFILE = Layout(
    "templates",
    "template",
    "template_id",
    (
        Child("foundation_card", "foundation_cards", "card_id"),
        Child("blueprint", "blueprint", "blueprint_id"),
        Child("release", "release", "release_id"),
        Child("native_asset", "native_assets", "path", bare=True),
        Child("evidence.", "evidence", "sha256", by_field=True),
    ),
    ("version", "path", "sha256"),
)


def _rows(ix: Index, layout: Layout) -> Iterator[tuple[np.ndarray, np.ndarray, str | list[str], np.ndarray, list[str | None], list[list[str | None]]]]:
    """For each kind: record, parent's place, kind, child's place, keys, attributes and inherited ones."""

    def attributes(objects: np.ndarray) -> list[list[str | None]]:
        return [ix.texts(ix.find(objects, a)) for a in layout.attributes]

    records = np.flatnonzero(ix.root >= 0)
    roots = ix.root[records]
    keep = ~ix.is_array[roots] if len(roots) else np.zeros(0, bool)
    records, roots = records[keep], roots[keep]
    source, parent_place, element = ix.spread(ix.find(roots, layout.parents))
    parent_object = ix.object_in(element)
    keep = parent_object >= 0
    record, parent_place, parent = records[source[keep]], parent_place[keep], parent_object[keep]
    handed = [ix.texts(ix.find(parent, a)) for a in layout.inherit]
    yield record, parent_place, layout.parent_kind, parent_place, ix.texts(ix.find(parent, layout.parent_key)), attributes(parent) + handed
    for c in layout.children:
        held = ix.find(parent, c.path)
        if c.by_field:
            which, member = ix.members_of(held)
            last = ix.last_of_key(member)
            which, member = which[last], member[last]
            kinds: str | list[str] = [c.kind + k for k in ix.keys(member)]
            place = np.zeros(len(member), np.int64)
        else:
            which, place, member = ix.spread(held)
            kinds = c.kind
        child = ix.object_in(member)
        key = ix.find(child, c.key)
        if c.bare:
            key = np.where((key < 0) & (child < 0) & ix.is_text(member), member, key)
        yield record[which], parent_place[which], kinds, place, ix.texts(key), attributes(child) + [[h[w] for w in which.tolist()] for h in handed]


def flatten(df: DataFrame, text: str, carry: Sequence[str], layout: Layout = PROFILE, malformed: bool = False) -> DataFrame:
    """(carry..., parent_pos long, kind, child_pos long, child_key, the layout's attributes, inherited ones).

    Every child comes out, also one without a key. malformed: rows of kind ``malformed`` too.
    """
    made = {"parent_pos", "kind", "child_pos", "child_key", *layout.columns}
    if made & set(carry):
        raise ValueError(f"carried columns clash with what is made: {sorted(made & set(carry))}")
    types = dict(df.dtypes)
    plain = df.select(*[F.col(f"`{c}`") for c in carry], F.encode(F.col(f"`{text}`"), "utf-8").alias("__tf_text"))
    schema = ", ".join(f"`{c}` {types[c]}" for c in carry) + ", parent_pos long, kind string, child_pos long, child_key string"
    schema += "".join(f", `{a}` string" for a in layout.columns)

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ix = index(batch.column(len(carry)).to_pylist())
        parts = list(_rows(ix, layout))
        if malformed:
            bad = np.flatnonzero(ix.bad)
            none = [None] * len(bad)
            parts.append((bad, np.zeros(len(bad), np.int64), "malformed", np.zeros(len(bad), np.int64), none, [none for _ in layout.columns]))
        for record, parent_place, kinds, place, keys, attributes in parts:
            if not len(record):
                continue
            chosen = batch.take(pa.array(record))
            yield pa.RecordBatch.from_arrays(
                [
                    *chosen.columns[:-1],
                    pa.array(parent_place, pa.int64()),
                    pa.array(kinds if isinstance(kinds, list) else [kinds] * len(record), pa.string()),
                    pa.array(place, pa.int64()),
                    pa.array(keys, pa.string()),
                    *[pa.array(a, pa.string()) for a in attributes],
                ],
                names=[*carry, "parent_pos", "kind", "child_pos", "child_key", *layout.columns],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x) if x is not None else 0 for x in batch.column(len(carry)).to_pylist()]
            start, held = 0, 0
            for i, n in enumerate(sizes):
                if held and held + n > BATCH_BYTES:
                    yield from one(batch.slice(start, i - start))
                    start, held = i, 0
                held += n
            if start < len(sizes):
                yield from one(batch.slice(start))

    return plain.mapInArrow(run, schema)


def children(df: DataFrame, kind: str) -> DataFrame:
    """One flat table out of what flatten gave."""
    return df.filter(F.col("kind") == kind) if not kind.endswith(".") else df.filter(F.col("kind").startswith(kind))
