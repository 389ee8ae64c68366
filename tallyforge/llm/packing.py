"""Filling containers of fixed capacity with items, by hierarchical residual packing.

Every partition packs its items best-fit, largest first. Containers filled to within ``slack`` of the
capacity are final; the others go on as items of the next round, which has a fraction of the
partitions, until one partition is left. An item larger than the capacity is cut into full pieces,
each a container of its own, and a rest that is packed like any item. Nothing else is ever cut.

What goes on is bounded without loss. Two containers above half the capacity never fit together, so
each joint container holds at most one of them and at least one of the k that are not above half; of
those above half, the k smallest can take part wherever others could, and all others are final. A
partition leaves at most one container not above half (best-fit would have joined two), so a round
passes on at most twice as many containers as it had parts, and the last partition is small.

A container going on carries the list of what it holds: at most ``capacity`` members, since every item
has at least one token.

Defined results
---------------
* Null and empty texts (and items of size 0 or without an id) are in no container.
* Ties are broken by size, then id, so that a repeated run over the same partitions packs alike.
* Repeated rows are items of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import tokens
from tallyforge.session import durable, width

CAPACITY = 2048
#: A container with no more than this share of its capacity unused is final before the last round.
SLACK = 1 / 256
#: How many partitions of a round become one of the next, and items best-fit holds at once.
FAN_IN, CHUNK = 8, 200_000

_STATE = "size int, members array<struct<id:bigint,piece:int,n:int>>"


def sizes(df: DataFrame, item_id: str, text: str, path: str | None = None) -> DataFrame:
    """(id, n): each non-empty text's size in tokens, in one pass without a shuffle."""
    where = path or f"{tokens.FOLDER}/{tokens.VOCABULARY}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokens.counter(where)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t.as_py()) for t in batch.column(1)], pa.int64())], names=["id", "n"])

    whole = df.filter((F.length(F.col(f"`{text}`")) > 0) & F.col(f"`{item_id}`").isNotNull()).select(F.col(f"`{item_id}`").cast("bigint").alias("id"), F.col(f"`{text}`"))
    return whole.mapInArrow(run, "id bigint, n bigint")


def best_fit(loads: list[int], capacity: int) -> list[list[int]]:
    """Bins of the places of loads, best-fit over the loads as ordered.

    Open bins are kept by free space; a bit mask says which free spaces occur, so the tightest bin
    that fits is found without a search.
    """
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, load in enumerate(loads):
        fitting = mask >> load
        if fitting:
            free = load + (fitting & -fitting).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask &= ~(1 << free)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        left = free - load
        if left:
            by_free[left].append(b)
            mask |= 1 << left
    return bins


def _round(states: DataFrame, capacity: int, allowed: int) -> DataFrame:
    """One round: (final, size, members); each partition is packed in chunks of bounded size."""

    def pack(held: list[tuple[int, list]]) -> Iterator[pa.RecordBatch]:
        # largest first; ties by the first member, so a repeated run packs alike
        held.sort(key=lambda s: (-s[0], s[1][0]["id"], s[1][0]["piece"]))
        bins = best_fit([s for s, _ in held], capacity)
        total = [sum(held[i][0] for i in b) for b in bins]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([capacity - t <= allowed for t in total], pa.bool_()),
                pa.array(total, pa.int32()),
                pa.array(
                    [[m for i in b for m in held[i][1]] for b in bins],
                    pa.list_(pa.struct([("id", pa.int64()), ("piece", pa.int32()), ("n", pa.int32())])),
                ),
            ],
            names=["final", "size", "members"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list]] = []
        n = 0
        for batch in batches:
            for size, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((size, members))
                n += len(members)
                if n >= CHUNK:
                    yield from pack(held)
                    held, n = [], 0
        if held:
            yield from pack(held)

    return states.select("size", "members").mapInArrow(run, f"final boolean, {_STATE}")


def _joinable(left: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Of the containers left, those that can still be joined with others (see above), and how many.

    Read off how many there are of each size, which is at most ``capacity`` numbers.
    """
    by_size = sorted((r["size"], r["count"]) for r in left.groupBy("size").count().collect())
    small = [(s, n) for s, n in by_size if 2 * s <= capacity]
    k, smallest = sum(n for _, n in small), small[0][0] if small else 0
    if not k or (k == 1 and all(s + smallest > capacity for s, _ in by_size if (s, 1) != small[0])):
        return left.limit(0), 0
    most, free = k, 0  # containers above half: all below size ``most``, and ``free`` of that size
    taken = 0
    for s, n in by_size:
        if 2 * s <= capacity or s + smallest > capacity:
            continue
        if taken + n > k:
            most, free = s, k - taken
            taken = k
            break
        taken, most, free = taken + n, s + 1, 0
    whole = left.filter((2 * F.col("size") <= capacity) | (F.col("size") < (most if taken else 0)))
    tied = left.filter((2 * F.col("size") > capacity) & (F.col("size") == most)).orderBy("container").limit(free) if free else None
    return (whole.unionByName(tied) if tied is not None else whole), k + taken


def pack(items: DataFrame, capacity: int = CAPACITY, slack: float = SLACK) -> DataFrame:
    """(id, piece, n, container, filled) from items (id, n): piece is 0 unless the item was cut.

    Rounds are kept in the checkpoint folder, so containers stay what they are when executors go.
    """
    spark = items.sparkSession
    items = durable(items.filter("n > 0 and id is not null").select(F.col("id").cast("bigint").alias("id"), F.col("n").cast("bigint").alias("n")))
    cap = F.lit(capacity)
    pieces = items.select("id", F.posexplode(F.expr(f"transform(sequence(0, cast((n - 1) div {capacity} as int)), i -> cast(least({capacity}, n - i * {capacity}) as int))")).alias("piece", "n"))
    member = F.array(F.struct("id", "piece", "n"))
    # a container is named by its round and its place among the round's rows, which are kept
    name = lambda of: F.concat_ws("-", F.lit(of), F.monotonically_increasing_id().cast("string")).alias("container")
    full = pieces.filter(F.col("n") == cap).select(F.col("n").alias("size"), member.alias("members"), name("full"))
    states = pieces.filter(F.col("n") < cap).select(F.col("n").alias("size"), member.alias("members"))
    done = [full]
    partitions = max(1, min(width(spark), items.count() // 2000 or 1))
    states = states.repartition(partitions, F.xxhash64(F.element_at("members", 1)["id"]))
    allowed = int(capacity * slack)
    while True:
        out = durable(_round(states, capacity, capacity if partitions == 1 else allowed).select("*", name(f"round{len(done)}")))
        left = out.filter(~F.col("final"))
        kept, n = _joinable(left, capacity)
        done.append(out.filter("final").drop("final"))
        if not n:
            done.append(left.drop("final"))
            break
        kept = durable(kept)
        done.append(left.join(kept.select("container"), "container", "left_anti").select("size", "members", "container"))
        # few containers meet at once; many over a tree
        partitions = max(1, min(partitions // FAN_IN, n // 1000))
        states = kept.select("size", "members").repartition(partitions, F.xxhash64(F.element_at("members", 1)["id"], F.element_at("members", 1)["piece"]))
    bins = done[0]
    for part in done[1:]:
        bins = bins.unionByName(part)
    return bins.select("container", F.col("size").alias("filled"), F.explode("members").alias("m")).select("m.id", "m.piece", "m.n", "container", "filled")


def quality(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least possible containers, share of capacity unused."""
    return packed.agg(
        F.count_distinct("container").alias("containers"), F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("pieces")
    ).select("containers", "pieces", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_containers"), (1 - F.col("tokens") / (F.col("containers") * capacity)).alias("unused"))
