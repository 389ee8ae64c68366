"""Passages of held-out items within a corpus, by a distributed positional inverted index.

The index is cut by documents into shards of bounded size: each shard holds, for every term it indexes,
the sorted places where the term stands. Items are searched in blocks of a bounded number of words, as
many as there are: a block's windows (runs of consecutive words) are ordered by their rarest term, as
counted over all shards. A shard visits only windows whose rarest term it holds; the places of that
term, shifted by its offset in the window, are intersected with the shifted places of the next rarest
term, and so on through all terms of the window. What is left are exact phrases.

Terms are known by 64 bits of hash, so no vocabulary is kept anywhere; a filter of fixed size says
which terms the items may hold, and only those are indexed. Postings are never shuffled: shards are
searched where they are kept. Items with equal texts are searched once.

Proximity matches are windows whose rarest terms stand close together in a document, in any order,
without the exact phrase.

Defined results
---------------
* Null and empty texts, documents or items, match nothing; items of fewer words than a window neither.
  Rows without an id cannot be named and are left out.
* Equal texts under several ids are each found. Repeated rows give the same cases once.
* Very long texts are indexed whole, in a shard of their own; an item is searched whole, so a block is at
  least as large as its longest text. Empty tables give no rows.
* Other columns of the tables are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import skew
from tallyforge.session import durable, width

#: Words a shared passage has at least.
WINDOW = 13
#: Characters of text in a shard, and of items in a block (a block's windows take about ten bytes for each).
SHARD_CHARS, BLOCK_CHARS = 3_000_000, 4_000_000
#: The filter of terms has two to this power bits. Candidates looked at together, for memory.
FILTER_BITS, TOGETHER = 23, 2_000_000

WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Unbroken runs of letters or digits, without case."""
    return WORD.findall(text.casefold())


def term(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) or 1


def terms(text: str) -> np.ndarray:
    w = words(text)
    return np.fromiter(map(term, w), np.uint64, len(w))


class _Known(dict):
    """Each word's term, or 0 where the filter says that no item holds it."""

    def __init__(self, bits: bytes) -> None:
        super().__init__()
        self.bits = bits

    def __missing__(self, word: str) -> int:
        t = term(word)
        slot = t >> (64 - FILTER_BITS)
        if len(self) > 1_000_000:
            self.clear()
        self[word] = t = t if self.bits[slot >> 3] >> (slot & 7) & 1 else 0
        return t


def term_filter(texts: DataFrame) -> bytes:
    """The filter of all terms in column ``t``: one bit map from each of a few partitions, joined here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            for t in batch.column(0):
                flags[(terms(t.as_py()) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["bits"])

    maps = [np.frombuffer(r.bits, np.uint8) for r in texts.select("t").coalesce(32).mapInArrow(run, "bits binary").collect()]
    return reduce(np.bitwise_or, maps, np.zeros((1 << FILTER_BITS) // 8, np.uint8)).tobytes()


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpack(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def build(documents: DataFrame, doc_id: str, text: str, bits: bytes) -> DataFrame:
    """The index: one row a shard, with its documents, its terms and their postings, kept in the checkpoint folder.

    (ids: documents; starts: each document's first place in the shard; terms, ends: the terms that
    occur, in order, and where their postings end; places: gaps between the sorted places of each term.)
    """
    shared = documents.sparkSession.sparkContext.broadcast(bits)

    def shard(ids: list[int], texts: list[str], known: _Known) -> pa.RecordBatch:
        found, lengths = [], []
        for t in texts:
            w = words(t)
            found.append(np.fromiter(map(known.__getitem__, w), np.uint64, len(w)))
            lengths.append(len(w) + WINDOW)  # documents stand apart, so that no window spans two
        starts = np.cumsum([0, *lengths[:-1]])
        all_terms = np.concatenate(found)
        place = np.concatenate([np.arange(len(f)) + s for f, s in zip(found, starts, strict=True)])
        kept = all_terms != 0
        all_terms, place = all_terms[kept], place[kept]
        order = np.argsort(all_terms, kind="stable")
        all_terms, place = all_terms[order], place[order]
        ends = np.flatnonzero(np.append(all_terms[1:] != all_terms[:-1], True)) + 1 if len(all_terms) else np.zeros(0, np.int64)
        gaps = np.diff(place, prepend=0).astype(np.int32)
        row = [np.array(ids, np.int64), np.asarray(starts, np.int32), all_terms[ends - 1], ends.astype(np.int32), gaps]
        return pa.RecordBatch.from_arrays([pa.array([_pack(a)], pa.binary()) for a in row], names=["ids", "starts", "terms", "ends", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(shared.value)
        ids: list[int] = []
        texts: list[str] = []
        n = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = t.as_py()
                if ids and n + len(s) > SHARD_CHARS:
                    yield shard(ids, texts, known)
                    ids, texts, n = [], [], 0
                ids.append(i)
                texts.append(s)
                n += len(s)
        if ids:
            yield shard(ids, texts, known)

    whole = documents.filter((F.length(F.col(f"`{text}`")) > 0) & F.col(f"`{doc_id}`").isNotNull()).select(F.col(f"`{doc_id}`").cast("bigint").alias("i"), F.col(f"`{text}`").alias("t"))
    return durable(whole.mapInArrow(run, "ids binary, starts binary, terms binary, ends binary, places binary"))


def frequencies(index: DataFrame, of: np.ndarray) -> np.ndarray:
    """How often each of some terms (sorted, distinct) occurs in the whole corpus."""
    shared = index.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for t, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held, count = _unpack(t, np.uint64), np.diff(_unpack(e, np.int32), prepend=0)
                at, known = _find(wanted, held)
                total[at[known]] += count[known]
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(total[place])], names=["place", "n"])

    out = np.zeros(len(of), np.int64)
    for place, n in index.select("terms", "ends").mapInArrow(run, "place int, n bigint").groupBy("place").agg(F.sum("n")).collect():
        out[place] = n
    return out


def _find(among: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``what`` stands in the sorted ``among``, and whether it does."""
    at = np.minimum(np.searchsorted(among, what), max(len(among) - 1, 0))
    return at, (among[at] == what if len(among) else np.zeros(len(what), bool))


@dataclass
class _Block:
    """Texts of items, one after another, and their windows, ordered by rarest term."""

    size: int
    terms: np.ndarray  # of all texts
    start: np.ndarray  # by window: its first term
    text: np.ndarray  # by window: which text
    order: np.ndarray  # by window: offsets of its terms, rarest first
    rarest: np.ndarray  # distinct rarest terms, sorted
    upto: np.ndarray  # by rarest term: where its windows begin; one more at the end
    keys: np.ndarray  # by text: two numbers that name it

    def of(self, window: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k-th rarest term of windows, and its offset."""
        offset = self.order[window, k].astype(np.int64)
        return self.terms[self.start[window] + offset], offset


def _block(index: DataFrame, texts: list[tuple[int, int, str]], size: int) -> _Block | None:
    each = [terms(t) for _, _, t in texts]
    lengths = np.array([len(e) for e in each], np.int64)
    windows = np.maximum(lengths - size + 1, 0)
    if not windows.sum():
        return None
    flat = np.concatenate(each)
    first = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(each)), windows)
    start = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    distinct, number = np.unique(flat, return_inverse=True)
    often = frequencies(index, distinct)[number]
    order = np.empty((len(start), size), np.int16)
    for i in range(0, len(start), 200_000):
        order[i : i + 200_000] = np.argsort(often[start[i : i + 200_000, None] + np.arange(size)], axis=1, kind="stable")
    first_term = flat[start + order[:, 0]]
    by = np.argsort(first_term, kind="stable")
    rarest, upto = np.unique(first_term[by], return_index=True)
    return _Block(size, flat, start[by], text[by], order[by], rarest, np.append(upto, len(by)), np.array([k[:2] for k in texts], np.int64))


_MATCH = "doc_id bigint, k1 bigint, k2 bigint, kind string, windows int, first_word int"


def search(index: DataFrame, block: _Block, proximity: bool = False, near: int = 3 * WINDOW) -> DataFrame:
    """(doc_id, k1, k2, kind, windows, first_word): pairs of a document and a text of the block found in it.

    kind ``phrase``: ``windows`` windows of the text stand in the document, the first at word
    ``first_word``. kind ``proximity`` (only if asked for, and no phrase): the four rarest terms of a
    window stand within ``near`` words of the rarest one.
    """
    shared = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from _Shard(r).search(shared.value, proximity, near)

    return index.mapInArrow(run, _MATCH)


class _Shard:
    """One shard's postings, as one sorted array of term and place."""

    def __init__(self, r: dict) -> None:
        self.ids, self.starts = _unpack(r["ids"], np.int64), _unpack(r["starts"], np.int32)
        self.terms, ends = _unpack(r["terms"], np.uint64), _unpack(r["ends"], np.int32).astype(np.int64)
        self.places = np.cumsum(_unpack(r["places"], np.int32), dtype=np.int64)
        self.count = np.diff(ends, prepend=0)
        self.first = ends - self.count
        self.wide = int(self.places.max(initial=0)) + 1
        self.keys = np.repeat(np.arange(len(self.terms)), self.count) * self.wide + self.places

    def candidates(self, block: _Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows whose rarest term stands here, with every place of it, a bounded number together."""
        at, known = _find(block.rarest, self.terms)
        local, at = np.flatnonzero(known), at[known]
        n_windows = block.upto[at + 1] - block.upto[at]
        local = np.repeat(local, n_windows)
        window = np.repeat(block.upto[at], n_windows) + np.arange(len(local)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        n = self.count[local]
        for part in np.split(np.arange(len(window)), np.flatnonzero(np.diff(np.cumsum(n) // TOGETHER)) + 1) if len(window) else ():
            m = n[part]
            w = np.repeat(window[part], m)
            place = self.places[np.repeat(self.first[local[part]], m) + np.arange(len(w)) - np.repeat(np.cumsum(m) - m, m)]
            yield w, place

    def search(self, block: _Block, proximity: bool, near: int) -> Iterator[pa.RecordBatch]:
        hits, close = [], []
        for w, place in self.candidates(block):
            if proximity:
                close.append(self.near(block, w, place, near))
            start = place - block.of(w, 0)[1]
            for k in range(1, block.size):
                if not len(w):
                    break
                t, offset = block.of(w, k)
                local, known = _find(self.terms, t)
                where = start + offset
                known &= (start >= 0) & (where < self.wide)
                known[known] = _find(self.keys, local[known] * self.wide + where[known])[1]
                w, start = w[known], start[known]
            hits.append((w, start))
        out = [self.pairs(block, hits, "phrase")]
        if proximity:
            out.append(self.pairs(block, close, "proximity"))
            seen = {(d, t) for d, t, *_ in zip(*out[0], strict=True)}
            fresh = [i for i, pair in enumerate(zip(*out[1][:2], strict=True)) if pair not in seen]
            out[1] = tuple(c[fresh] for c in out[1])
        for (doc, text, windows, word), kind in zip(out, ("phrase", "proximity"), strict=False):
            if len(doc):
                arrays = [self.ids[doc], block.keys[text, 0], block.keys[text, 1], [kind] * len(doc), windows.astype(np.int32), word.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["doc_id", "k1", "k2", "kind", "windows", "first_word"])

    def near(self, block: _Block, w: np.ndarray, place: np.ndarray, near: int, rare: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Of candidates, those around whose place the window's other rarest terms stand, in the same document."""
        doc = np.searchsorted(self.starts, place, side="right")
        for k in range(1, min(rare, block.size)):
            if not len(w):
                break
            local, known = _find(self.terms, block.of(w, k)[0])
            at = np.searchsorted(self.keys, local * self.wide + place)
            good = np.zeros(len(w), bool)
            for j in (np.maximum(at - 1, 0), np.minimum(at, len(self.keys) - 1)):  # the nearest before and after
                there = self.keys[j] - local * self.wide
                good |= known & (np.abs(there - place) <= near) & (there >= 0) & (there < self.wide) & (np.searchsorted(self.starts, there, side="right") == doc)
            w, place, doc = w[good], place[good], doc[good]
        return w, place

    def pairs(self, block: _Block, hits: list[tuple[np.ndarray, np.ndarray]], kind: str) -> tuple[np.ndarray, ...]:
        """(document, text, windows, first word) of hits, gathered by document and text."""
        w = np.concatenate([h[0] for h in hits]) if hits else np.zeros(0, np.int64)
        place = np.concatenate([h[1] for h in hits]) if hits else np.zeros(0, np.int64)
        doc = np.searchsorted(self.starts, place, side="right") - 1
        text = block.text[w]
        order = np.lexsort((w, text, doc))
        doc, text, w, word = doc[order], text[order], w[order], (place - self.starts[doc])[order]
        if not len(w):
            return doc, text, w, word
        change = np.append(True, (np.diff(doc) != 0) | (np.diff(text) != 0))
        new = np.flatnonzero(change)
        windows = np.add.reduceat((change | np.append(True, np.diff(w) != 0)).astype(np.int64), new)
        return doc[new], text[new], windows, np.minimum.reduceat(word, new)


def leaks(documents: DataFrame, items: DataFrame, size: int = WINDOW, proximity: bool = False) -> DataFrame:
    """(doc_id, item_id, kind, windows, first_word): what search gives, over all documents and all items."""
    filled = items.filter((F.length("text") > 0) & F.col("item_id").isNotNull())
    keys = [F.xxhash64(F.lit(1), "text").alias("k1"), F.xxhash64(F.lit(2), "text").alias("k2")]
    held = durable(filled.select(F.col("item_id").cast("bigint").alias("item_id"), *keys, F.col("text").alias("t")).distinct())
    distinct = durable(held.groupBy("k1", "k2").agg(F.first("t").alias("t")))
    chars = distinct.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    names = held.select("item_id", "k1", "k2")
    index = build(documents, "doc_id", "text", term_filter(distinct))
    found = []
    for b in range(blocks):  # each over the one index; a block's texts are a bounded share of the items
        mine = distinct.filter(F.pmod("k1", F.lit(blocks)) == b)
        block = _block(index, sorted((r.k1, r.k2, r.t) for r in mine.collect()), size)
        if block is not None:
            found.append(search(index, block, proximity))
    if not found:
        return names.limit(0).select(F.lit(0).cast("bigint").alias("doc_id"), "item_id", F.lit("").alias("kind"), F.lit(0).alias("windows"), F.lit(0).alias("first_word"))
    matches = reduce(DataFrame.unionByName, found)
    if blocks == 1 and names.count() <= skew.HOT_ENTRIES:
        named = matches.join(F.broadcast(names), ["k1", "k2"])  # a counted few
    else:  # a text may be in very many documents, and under very many ids
        matches = durable(matches)
        hot = durable(skew.hot_keys(matches, ["k1", "k2"], 1 / (2 * width(documents.sparkSession))))
        salted = skew.salted(matches, hot, ["k1", "k2"], F.struct("doc_id"))
        named = salted.join(skew.replicated(names, hot, ["k1", "k2"]), ["k1", "k2", "__tf_salt"])
    return named.select("doc_id", "item_id", "kind", "windows", "first_word")
