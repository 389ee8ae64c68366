"""References to records that do not exist.

References and parents' validity events go into one stream, partitioned by referenced key and sorted
by day within it, parents first. One linear pass keeps the number of open validity intervals; a
reference that finds none open is an orphan. Keys with very many references are split over salts, and
their (few) events are repeated for each salt, so no partition holds more than its share.

Statuses
--------
``missing``: no such key at any time. ``late``: the key's first validity begins after the reference's
day. ``deleted``: the key was valid before that day but no longer is.

Defined results
---------------
* A null reference is none; a reference without a day cannot be judged and is left out.
* A parent key with several intervals is valid in each of them; repeated parent rows change nothing.
* An interval without a start, or that ends at or before it, is never open, yet its key is known.
* Repeated references come out once each time they occur; take ``distinct`` for cases.
* Empty tables: no references give no rows; no parents make every reference missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.operators import skew
from tallyforge.session import durable


def canonical_key(key: Column) -> Column:
    """Keys are compared without spaces around them and without regard to case."""
    return F.upper(F.trim(key))


def references(df: DataFrame, ref_table: str | Column, key: Column, day: Column, record: Column) -> DataFrame:
    """(ref_table, ref_key, day, record_key) of one referring column; its table is named or a column."""
    return df.select(
        (ref_table if isinstance(ref_table, Column) else F.lit(ref_table)).alias("ref_table"), canonical_key(key).alias("ref_key"), day.alias("day"), record.cast("string").alias("record_key")
    ).filter(F.col("ref_key").isNotNull() & F.col("day").isNotNull())


def validity(df: DataFrame, ref_table: str, key: Column, start: Column, end: Column) -> DataFrame:
    """(ref_table, ref_key, since, until) of a parent table; until is exclusive, null while it lasts."""
    return df.select(
        F.lit(ref_table).alias("ref_table"), canonical_key(key).alias("ref_key"), start.alias("since"), end.alias("until")
    ).filter(F.col("ref_key").isNotNull())


def judged(refs: DataFrame, parents: DataFrame, spread: bool = True) -> DataFrame:
    """(ref_table, ref_key, day, record_key, status) with status ``present`` or one of the orphans'.

    spread: look for keys with very many references and split them (a second pass over the keys).
    """
    keys = ["ref_table", "ref_key"]
    real = F.col("since").isNotNull() & (F.col("until").isNull() | (F.col("until") > F.col("since")))
    known = parents.groupBy(*keys).agg(F.min(F.when(real, F.col("since"))).alias("first_since"))
    spans = parents.filter(real)
    events = (
        spans.select(*keys, F.col("since").alias("day"), F.lit(1).alias("change"))
        .unionByName(spans.filter(F.col("until").isNotNull()).select(*keys, F.col("until").alias("day"), F.lit(-1).alias("change")))
        .groupBy(*keys, "day")
        .agg(F.sum("change").alias("change"))
        .filter("change <> 0")
        .withColumn("first_since", F.lit(None).cast("date"))
        .withColumn("known", F.lit(None).cast("boolean"))
        .unionByName(known.select(*keys, F.lit(None).cast("date").alias("day"), F.lit(0).cast("bigint").alias("change"), "first_since", F.lit(True).alias("known")))
    )
    if spread:
        hot = durable(skew.hot_keys(refs, keys))  # few rows, for both sides
        refs = skew.salted(refs, hot, keys, F.struct("record_key", "day"))
        events = skew.replicated(events, hot, keys)
    else:
        refs, events = refs.withColumn("__tf_salt", F.lit(0)), events.withColumn("__tf_salt", F.lit(0))
    stream = refs.select(
        *keys, "__tf_salt", "day", F.lit(1).alias("is_ref"), "record_key", F.lit(0).cast("bigint").alias("change"), F.lit(None).cast("date").alias("first_since"), F.lit(None).cast("boolean").alias("known")
    ).unionByName(events.select(*keys, "__tf_salt", "day", F.lit(0).alias("is_ref"), F.lit(None).cast("string").alias("record_key"), "change", "first_since", "known"))
    # the row that says a key is known has no day and so sorts first
    merge = Window.partitionBy(*keys, "__tf_salt").orderBy(F.col("day").asc_nulls_first(), "is_ref").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    status = (
        F.when(F.col("open") > 0, "present")
        .when(F.col("is_known").isNull(), "missing")
        .when(F.col("first_day").isNull() | (F.col("first_day") > F.col("day")), "late")
        .otherwise("deleted")
    )
    return (
        stream.withColumn("open", F.sum("change").over(merge))
        .withColumn("first_day", F.max("first_since").over(merge))
        .withColumn("is_known", F.max("known").over(merge))
        .filter("is_ref = 1")
        .select(*keys, "day", "record_key", status.alias("status"))
    )


def orphans(refs: DataFrame, parents: DataFrame, spread: bool = True) -> DataFrame:
    """The references that do not hold, each (table, record, key, day) once."""
    return judged(refs, parents, spread).filter("status <> 'present'").distinct()


def report(found: DataFrame) -> DataFrame:
    """Orphans counted per referenced table, month and status."""
    return found.groupBy("ref_table", F.date_format("day", "yyyy-MM").alias("period"), "status").agg(
        F.count(F.lit(1)).alias("orphan_refs"), F.count_distinct("ref_key").alias("orphan_keys")
    )
