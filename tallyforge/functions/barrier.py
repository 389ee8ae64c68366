"""Columns that are computed once, however often they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once, however often they are used above.

    Projections that are merged and filters that are pushed down copy the expressions of the columns
    they use. Nothing is merged with, or pushed below, a generator, so they come out of one here.
    """
    made = F.explode_outer(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))
    return df.select("*", made.alias("__tf_made")).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"__tf_made.{k}").alias(k) for k in columns])
