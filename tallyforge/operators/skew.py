"""Joins and partitionings that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.session import durable, width


def hot_keys(df: DataFrame, keys: Sequence[str], share: float | None = None) -> DataFrame:
    """(keys..., n, fan): keys with more than ``share`` of all rows, and into how many parts to split.

    With share = 1 / (2 * shuffle partitions), the default, there can be at most 2 * shuffle partitions
    such keys, whatever the data: the result may be broadcast. Counting combines before its shuffle.
    """
    share = share or 1.0 / (2 * width(df.sparkSession))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__tf_total"))
    return (
        counts.join(F.broadcast(total), F.col("n") > F.col("__tf_total") * F.lit(share))
        .withColumn("fan", F.ceil(F.col("n") / (F.col("__tf_total") * F.lit(share))).cast("int"))
        .drop("__tf_total")
    )


def salted(df: DataFrame, hot: DataFrame, keys: Sequence[str], by: Column, salt: str = "__tf_salt") -> DataFrame:
    """df with a salt: 0 but for rows of hot keys, which spread over the key's fan by ``by``'s hash."""
    marked = df.join(F.broadcast(hot.select(*keys, "fan")), list(keys), "left")
    return marked.withColumn(salt, F.when(F.col("fan").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(by), F.col("fan")).cast("int"))).drop("fan")


def replicated(df: DataFrame, hot: DataFrame, keys: Sequence[str], salt: str = "__tf_salt") -> DataFrame:
    """df with a row for each salt of its key: the side that salted rows meet."""
    marked = df.join(F.broadcast(hot.select(*keys, "fan")), list(keys), "left")
    return marked.withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("fan"), F.lit(1)) - 1))).drop("fan")


#: Entries that look_up broadcasts at most.
HOT_ENTRIES = 4096


def look_up(df: DataFrame, entries: DataFrame, keys: Sequence[str], count: str, how: str = "inner", limit: int = HOT_ENTRIES) -> DataFrame:
    """df joined with ``entries`` (one row a key, ``count`` its number of rows in df).

    The ``limit`` entries with the most rows are broadcast. Every other key has at most a
    ``limit``-th of all rows, whatever the data, so the shuffled join of the rest has no hot key.
    Rows with a null key have no entry. ``how``: inner or left.
    """
    hot = entries.orderBy(F.col(count).desc(), *keys).limit(limit).drop(count)
    marked = df.join(F.broadcast(hot.withColumn("__tf_hot", F.lit(True))), list(keys), "left")
    of_hot = marked.filter(F.col("__tf_hot")).drop("__tf_hot")
    values = [c for c in entries.columns if c not in keys and c != count]
    of_cold = marked.filter(F.col("__tf_hot").isNull()).drop("__tf_hot", *values).join(entries.drop(count), list(keys), how)
    return of_hot.unionByName(of_cold)


def ranked(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """df in a total order, with each row's place from 1; sorted over all tasks, never in one.

    Rows are sorted into ranges and kept; a row's place is its place in its range after the rows of the
    ranges before, of which there is one number a partition.
    """
    kept = durable(df.orderBy(*order)).withColumn("__tf_part", F.spark_partition_id()).withColumn("__tf_row", F.monotonically_increasing_id())
    before, starts = 0, []
    for part, n in sorted(kept.groupBy("__tf_part").count().collect()):
        starts.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "__tf_part int, __tf_before bigint")
    within = F.col("__tf_row").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(offsets), "__tf_part").withColumn(name, F.col("__tf_before") + within + 1).drop("__tf_part", "__tf_row", "__tf_before")
