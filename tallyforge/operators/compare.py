"""Differences between two copies of a dataset, row by row and field by field.

Keys are laid out on a line by a 64-bit hash. The line is cut into wide ranges, and both sides' rows are
summed up by range, one side added and the other taken away: rows, xor and two sums of row hashes. Ranges
that come to nothing hold the same rows. Only rows of the others are summed up again, by narrower
ranges, down to the smallest, and only in those are rows and fields compared. Sums combine map-side, so
two copies that are alike cost a scan of each and a few thousand numbers.

A copy delivered again makes its range differ, which costs a comparison there and changes no result.
Checksums carry 128 bits beside the row count.

Defined results
---------------
* A key's copies within one side count once; where one side holds several versions of a key, a field
  differs when the sets of its values differ.
* Null equals null and differs from everything else. A null key is a key of its own.
* Columns outside ``fields`` are ignored. Two empty sides give no rows; one empty side gives all keys of
  the other. Very long values are compared whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.session import durable

#: Rows that a smallest range holds on average; the bits of the wider ranges; and the ranges whose numbers
#: (8 bytes each) may be broadcast: beyond it they meet the rows in a shuffled join.
LEAF_ROWS, WIDER, BROADCAST_RANGES = 8, (12, 24), 100_000


def _range(key_hash: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key_hash, 64 - bits)


def _hashes(df: DataFrame, key: str, fields: Sequence[str], side: int) -> DataFrame:
    """The key's hash and two hashes of the whole row, for side 1 or -1. Nulls are marked, since hashes skip them."""
    marked = [x for c in (key, *fields) for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return df.select(F.xxhash64(F.col(f"`{key}`").isNull(), F.col(f"`{key}`")).alias("h"), F.xxhash64(F.lit(7), *marked).alias("f1"), F.xxhash64(F.lit(11), *reversed(marked)).alias("f2"), F.lit(side).alias("side"))


def _differing(rows: DataFrame, bits: int) -> DataFrame:
    """(r): ranges in which the two sides' checksums are not the same."""
    low, high = F.col("f2").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("f2", 32)  # halves, so that no sum can overflow
    sums = rows.groupBy(_range(F.col("h"), bits).alias("r")).agg(F.sum("side").alias("n"), F.bit_xor("f1").alias("x"), F.sum(low * F.col("side")).alias("s"), F.sum(high * F.col("side")).alias("t"))
    return sums.filter("n <> 0 or x <> 0 or s <> 0 or t <> 0").select("r")


def _restricted(rows: DataFrame, at: Column, ranges: DataFrame, n: int) -> DataFrame:
    """Rows whose range is among some."""
    few = F.broadcast(ranges) if n <= BROADCAST_RANGES else ranges
    return rows.withColumn("__tf_r", at).join(few.withColumnRenamed("r", "__tf_r"), "__tf_r", "left_semi").drop("__tf_r")


def mismatched_ranges(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> tuple[DataFrame, int, int]:
    """The smallest ranges whose checksums differ, as (r), how many there are, and how many bits number a range.

    Where most wide ranges differ, no narrower ones are looked at before the smallest.
    """
    size = max(left.count(), right.count(), 1)
    bits = min(40, max(6, ceil(log2(max(size / LEAF_ROWS, 2)))))
    rows = both = _hashes(left, key, fields, 1).unionByName(_hashes(right, key, fields, -1))
    for level in (w for w in WIDER if w + 3 < bits):
        live = durable(_differing(rows, level))
        n = live.count()
        if not n:
            return live, 0, level
        if 2 * n > 1 << level:
            break
        rows = _restricted(both, _range(F.col("h"), level), live, n)
    leaves = durable(_differing(rows, bits))
    return leaves, leaves.count(), bits


def differences(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str], types: Mapping[str, str] | None = None, names: tuple[str, str] = ("only_source", "only_mirror")) -> DataFrame:
    """(key, difference): names[0], names[1] or, for keys on both sides, a differing field; each once.

    types: the type under which a field is compared, for fields whose types differ between the sides.
    """
    cast = lambda df: df.select(F.col(f"`{key}`").alias(key), *[F.col(f"`{c}`").cast((types or {}).get(c, dict(df.dtypes)[c])).alias(c) for c in fields])
    left, right = cast(left), cast(right)
    ranges, n_ranges, bits = mismatched_ranges(left, right, key, fields)
    at = _range(F.xxhash64(F.col(f"`{key}`").isNull(), F.col(f"`{key}`")), bits)
    sides = [_restricted(df, at, ranges, n_ranges).withColumn("__tf_side", F.lit(side)) for df, side in ((left, 1), (right, 2))]
    rows = sides[0].unionByName(sides[1]).groupBy(key, *fields).agg(F.bit_or("__tf_side").alias("__tf_m"))
    whole = F.struct(*fields)
    on = lambda s: F.col("__tf_m").bitwiseAND(F.lit(s)) != 0
    per_key = rows.groupBy(key).agg(
        F.count_if(on(1)).alias("__tf_n1"), F.count_if(on(2)).alias("__tf_n2"), F.max(F.when(on(1), whole)).alias("__tf_a"), F.max(F.when(on(2), whole)).alias("__tf_b")
    )
    alone = F.when(F.col("__tf_n2") == 0, F.array(F.lit(names[0]))).when(F.col("__tf_n1") == 0, F.array(F.lit(names[1])))
    unequal = F.filter(F.array(*[F.when(~F.col(f"__tf_a.`{c}`").eqNullSafe(F.col(f"__tf_b.`{c}`")), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    single = per_key.filter("__tf_n1 <= 1 and __tf_n2 <= 1 or __tf_n1 = 0 or __tf_n2 = 0").select(key, F.explode(F.coalesce(alone, unequal)).alias("difference"))
    # several versions of a key on a side: a field differs when some value of it is on one side only
    versions = per_key.filter("__tf_n1 > 0 and __tf_n2 > 0 and (__tf_n1 > 1 or __tf_n2 > 1)").select(F.col(key).alias("__tf_key"))
    many = rows.join(versions, rows[key].eqNullSafe(versions["__tf_key"]), "left_semi")
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.to_json(F.struct(F.col(c)), {"ignoreNullFields": "false"}).alias("value")) for c in fields]))
    several = (
        many.select(key, "__tf_m", values.alias("__tf_v"))
        .groupBy(key, F.col("__tf_v.field").alias("difference"), "__tf_v.value")
        .agg(F.bit_or("__tf_m").alias("__tf_m"))
        .filter("__tf_m <> 3")
        .select(key, "difference")
        .distinct()
    )
    return single.unionByName(several)
