"""Constraints on row carriers (tables of text cells) and between them, as findings.

Defined results: nulls are empty cells; identifiers, statuses and keys are compared trimmed, duplicate
rows untrimmed; an empty carrier fails ``minimum_rows`` and a reconciliation with an empty side.
Columns not named in a rule are read only by the duplicate-row rule.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.scalars import cell, has_token
from tallyforge.operators.findings import finding, together


@dataclass(frozen=True)
class Lifecycle:
    status: str
    resolution: str
    allowed: Sequence[str] = ()
    required: Sequence[str] = ()
    requires_resolution: Sequence[str] = ()
    forbids_resolution: Sequence[str] = ()


@dataclass(frozen=True)
class Rules:
    required_columns: Sequence[str] = ()
    minimum_rows: int = 1
    id_column: str | None = None
    minimum_unique: Mapping[str, int] = field(default_factory=dict)
    lifecycle: Lifecycle | None = None
    ordinal: str | None = None


def _single(df: DataFrame, rule: str, name: str, detail: str) -> DataFrame:
    return finding(df.sparkSession.range(1), rule, F.lit(name), F.lit(detail))


def id_defects(df: DataFrame, column: str) -> DataFrame:
    """(value, n): identifiers that are blank or repeated."""
    return df.groupBy(cell(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | (F.col("value") == ""))


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that occur more than once, with how often (n)."""
    return df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n): distinct nonblank values of several columns, in one pass.

    Columns are unpivoted and pre-aggregated, so no task holds a column's set of values.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), cell(c).alias("value")) for c in columns]))
    seen = df.select(pairs.alias("p")).select("p.*").filter(F.col("value") != "").distinct()
    counts = seen.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return named.join(counts, "column", "left").select("column", F.coalesce("n", F.lit(0)).alias("n"))


def mode_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rows, top, share): how much of a column its most frequent value makes up."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), cell(c).alias("value")) for c in columns]))
    counts = df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(F.sum("n").alias("rows"), F.max("n").alias("top")).withColumn("share", F.col("top") / F.col("rows"))


def lifecycle_findings(df: DataFrame, name: str, rule: Lifecycle, ordinal: str | None = None) -> DataFrame:
    status, resolution = cell(rule.status), cell(rule.resolution)
    at = F.col(ordinal) if ordinal else None
    parts = [
        finding(df.filter(status.isin(*rule.requires_resolution) & (resolution == "")), "resolution_required", F.lit(name), status, at),
        finding(df.filter(status.isin(*rule.forbids_resolution) & (resolution != "")), "resolution_forbidden", F.lit(name), status, at),
    ]
    seen = df.select(status.alias("s")).distinct()
    if rule.allowed:
        parts.append(finding(seen.filter(~F.col("s").isin(*rule.allowed)), "status_not_allowed", F.lit(name), F.col("s")))
    if rule.required:
        wanted = df.sparkSession.createDataFrame([(s,) for s in rule.required], "s string")
        parts.append(finding(wanted.join(seen, "s", "left_anti"), "status_missing", F.lit(name), F.col("s")))
    return together(parts)


def audit(df: DataFrame, name: str, rules: Rules) -> DataFrame:
    """All findings on one carrier."""
    missing = [c for c in rules.required_columns if c not in df.columns]
    parts = [_single(df, "column_missing", name, c) for c in missing]
    text = [c for c, t in df.dtypes if t == "string"]
    if text:
        any_token = F.exists(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in text]), has_token)
        parts.append(finding(df.filter(any_token).limit(1), "unresolved_token", F.lit(name), F.lit("a cell holds an unresolved token")))
    rows = df.agg(F.count(F.lit(1)).alias("n"))
    parts.append(finding(rows.filter(F.col("n") < rules.minimum_rows), "too_few_rows", F.lit(name), F.col("n")))
    if rules.id_column:
        parts.append(_single(df, "column_missing", name, rules.id_column) if rules.id_column not in df.columns else finding(id_defects(df, rules.id_column), "id_not_unique", F.lit(name), F.col("value")))
    present = {c: n for c, n in rules.minimum_unique.items() if c in df.columns}
    parts += [_single(df, "column_missing", name, c) for c in rules.minimum_unique if c not in present]
    if present:
        least = df.sparkSession.createDataFrame(list(present.items()), "column string, least int")
        few = distinct_values(df, list(present)).join(least, "column").filter("n < least")
        parts.append(finding(few, "too_few_values", F.lit(name), F.format_string("%s has %d of %d", "column", "n", "least")))
    if rules.lifecycle:
        # a column that is not there reads as empty cells
        there = df.withColumns({c: F.lit("") for c in (rules.lifecycle.status, rules.lifecycle.resolution) if c not in df.columns})
        parts.append(lifecycle_findings(there, name, rules.lifecycle, rules.ordinal))
    compared = [c for c in df.columns if c != rules.ordinal]
    parts.append(finding(duplicate_rows(df, compared), "duplicate_row", F.lit(name), F.col("n")))
    return together(parts)


def key_differences(left: DataFrame, left_column: str, right: DataFrame, right_column: str) -> DataFrame:
    """(key, side): trimmed nonblank keys of one side only. Keys are made distinct before they are shuffled on."""
    one = lambda df, c, bit: df.select(cell(c).alias("key")).filter(F.col("key") != "").distinct().withColumn("bit", F.lit(bit))
    sides = one(left, left_column, 1).unionByName(one(right, right_column, 2)).groupBy("key").agg(F.bit_or("bit").alias("m"))
    return sides.filter("m <> 3").select("key", F.when(F.col("m") == 1, "left").otherwise("right").alias("side"))


def reconcile(left: DataFrame, left_column: str, right: DataFrame, right_column: str, relationship: str, name: str) -> DataFrame:
    """Findings on two carriers' keys, which must be ``equal`` or ``left_subset_of_right``."""
    if relationship not in ("equal", "left_subset_of_right"):
        return _single(left, "unknown_relationship", name, relationship)
    absent = [c for df, c in ((left, left_column), (right, right_column)) if c not in df.columns]
    if absent:
        return together([_single(left, "column_missing", name, c) for c in absent])
    differing = key_differences(left, left_column, right, right_column)
    if relationship != "equal":
        differing = differing.filter("side = 'left'")
    empty = together([finding(df.agg(F.count_if(cell(c) != "").alias("n")).filter("n = 0"), "empty_operand", F.lit(name), F.lit(s)) for df, c, s in ((left, left_column, "left"), (right, right_column, "right"))])
    return finding(differing, f"keys_not_{relationship}", F.lit(name), F.concat_ws(": ", "side", "key")).unionByName(empty)
