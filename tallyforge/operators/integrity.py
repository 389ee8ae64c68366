"""Referential and structural integrity across tables of records: small composable rules.

Every rule is an equi-join or a grouped count, so it shuffles on its keys only, with map-side combine
where it counts; none collects a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.scalars import identity


def unmatched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of left without a partner; keys of right are made distinct first."""
    return left.join(right.select(*on).distinct(), list(on), "left_anti")


def bound_references(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(refs..., defect): references (path, sha256) whose file is missing or has another hash."""
    held = files.select("path", F.col("sha256").alias("__tf_actual")).distinct()
    joined = refs.join(held, "path", "left")
    defect = F.when(F.col("__tf_actual").isNull(), "missing").when(~F.col("sha256").eqNullSafe(F.col("__tf_actual")), "hash_differs")
    return joined.withColumn("defect", defect).filter(F.col("defect").isNotNull()).drop("__tf_actual")


def not_exactly_once(wanted: DataFrame, have: DataFrame, on: Sequence[str]) -> DataFrame:
    """(key..., n): wanted keys that ``have`` does not hold exactly once."""
    counts = have.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    joined = wanted.select(*on).distinct().join(counts, list(on), "left")
    return joined.select(*on, F.coalesce("n", F.lit(0)).alias("n")).filter("n <> 1")


def broken_dependency(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n): keys with more than one value. Pairs are made distinct first, so hot keys shrink."""
    return df.select(key, value).distinct().groupBy(key).agg(F.count(value).alias("n")).filter("n > 1")


def shared_identities(df: DataFrame, subject: str, lane: str, actor: str) -> DataFrame:
    """(subject, actor, n): actors that, as identities, stand in more than one lane of a subject."""
    named = df.select(subject, lane, identity(F.col(actor)).alias("actor")).filter("actor is not null").distinct()
    return named.groupBy(subject, "actor").agg(F.count(lane).alias("n")).filter("n > 1")


def list_differences(expected: DataFrame, actual: DataFrame, key: str, seq: str, item: str) -> DataFrame:
    """(key, seq, expected, actual): places at which two ordered lists differ; no list is gathered."""
    a = expected.select(key, seq, F.col(item).alias("expected"), F.lit(True).alias("a"))
    b = actual.select(key, seq, F.col(item).alias("actual"), F.lit(True).alias("b"))
    both = a.join(b, [key, seq], "full")
    return both.filter(F.col("a").isNull() | F.col("b").isNull() | ~F.col("expected").eqNullSafe(F.col("actual"))).drop("a", "b")


def registry_differences(used: DataFrame, registry: DataFrame, on: Sequence[str]) -> DataFrame:
    """(key..., side): entries of one side only; both empty means an exact match."""
    one = lambda df, bit: df.select(*on).distinct().withColumn("bit", F.lit(bit))
    sides = one(used, 1).unionByName(one(registry, 2)).groupBy(*on).agg(F.bit_or("bit").alias("m"))
    return sides.filter("m <> 3").select(*on, F.when(F.col("m") == 1, "unregistered").otherwise("unused").alias("side"))


def field_differences(left: DataFrame, right: DataFrame, on: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(key..., field, expected, actual): fields that differ between two records of the same key."""
    renamed = right.select(*on, *[F.col(f).alias(f"__tf_{f}") for f in fields])
    pairs = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"__tf_{f}")), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("expected"), F.col(f"__tf_{f}").cast("string").alias("actual"))) for f in fields]))
    return left.join(renamed, list(on)).select(*on, F.explode(pairs).alias("d")).select(*on, "d.*")


def converging(df: DataFrame, package: str, item: str, fingerprint: str, share: float = 0.75, least: int = 3) -> DataFrame:
    """(package, items, largest, share): packages most of whose items have the same fingerprint."""
    sizes = df.groupBy(package, fingerprint).agg(F.count(item).alias("n"))
    out = sizes.groupBy(package).agg(F.sum("n").alias("items"), F.max("n").alias("largest")).withColumn("share", F.col("largest") / F.col("items"))
    return out.filter((F.col("items") >= least) & (F.col("share") >= share))


def layers_valid(layers: Column) -> Column:
    """The first layer is ``core``, layers are unique and in the fixed order of their numbers."""
    names = F.transform(layers, lambda x: x["name"])
    places = F.transform(layers, lambda x: x["place"])
    return F.coalesce((F.get(names, F.lit(0)) == "core") & (F.size(F.array_distinct(names)) == F.size(names)) & (F.array_sort(places) == places), F.lit(False))
