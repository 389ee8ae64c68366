"""The one schema of all audits: (rule, severity, subject, ordinal, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("rule", "severity", "subject", "ordinal", "detail")


def finding(df: DataFrame, rule: str, subject: Column, detail: Column, ordinal: Column | None = None, severity: str = "error") -> DataFrame:
    """A finding for each row of df."""
    return df.select(
        F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"),
        subject.cast("string").alias("subject"),
        (ordinal if ordinal is not None else F.lit(None)).cast("bigint").alias("ordinal"),
        detail.cast("string").alias("detail"),
    )


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def status(findings: DataFrame) -> DataFrame:
    """One row: PASS without findings, else FAIL, with their number."""
    return findings.agg(F.count(F.lit(1)).alias("findings")).select(F.when(F.col("findings") == 0, "PASS").otherwise("FAIL").alias("status"), "findings")
