"""Rules over a library of linked records: templates, releases, descriptors, cards, blueprints, evidence.

Every rule is a relation: an equi-join, a grouped count, or a comparison of fields. Groups are counted,
never gathered, so a key with a third of all rows is one row a task. Null keys match nothing and are
left out where a rule says so.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.scalars import canonical_json, safe_path


def as_list(value: object) -> list:
    """What stands where a list is expected: itself if it is one, else nothing."""
    return value if isinstance(value, list) else []


def as_dict(value: object) -> dict:
    """What stands where an object is expected: itself if it is one, else nothing."""
    return value if isinstance(value, dict) else {}


def entry_key(template_id: Column, version: Column) -> Column:
    """``id@version``; null where either is."""
    return F.concat(template_id, F.lit("@"), version)


def not_one(refs: DataFrame, held: DataFrame, on: Sequence[str]) -> DataFrame:
    """(refs..., n): references whose record is held not exactly once; repeated equal rows of ``held`` count once."""
    counts = held.distinct().groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    return refs.join(counts, list(on), "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n <> 1")


def incomplete(subjects: DataFrame, items: DataFrame, by: Sequence[str], item: str, wanted: Sequence[str]) -> DataFrame:
    """(by..., item, n): wanted items that a subject does not have exactly once. One count for each, no list."""
    rows = items.select(*by, F.col(item).alias("__tf_item")).unionByName(subjects.select(*by, F.lit(None).cast("string").alias("__tf_item")))
    counts = rows.groupBy(*by).agg(*[F.count_if(F.col("__tf_item") == w).alias(f"__tf_{i}") for i, w in enumerate(wanted)])
    each = F.explode(F.array(*[F.struct(F.lit(w).alias(item), F.col(f"__tf_{i}").alias("n")) for i, w in enumerate(wanted)]))
    return counts.select(*by, each.alias("e")).select(*by, "e.*").filter("n <> 1")


def conflicts(df: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(key..., field, n): fields that have several values under one key; nulls are no value."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    values = df.select(*key, each.alias("e")).select(*key, "e.field", "e.value").filter("value is not null").distinct()
    return values.groupBy(*key, "field").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def owned(path: Column, root: Column) -> Column:
    """Whether a path is safe and lies below a root folder."""
    return safe_path(path) & F.coalesce(F.startswith(path, F.concat(root, F.lit("/"))), F.lit(False))


def elements(refs: DataFrame, holders: DataFrame, on: Sequence[str], index: str, array: str) -> DataFrame:
    """(refs..., element, defect): what each reference's index finds in its holder's array.

    defect: ``no_holder``, ``no_element`` or null. Indexes are from 0; holders are one row a key.
    """
    joined = refs.join(holders.select(*on, F.col(array).alias("__tf_a")), list(on), "left")
    element = F.when(F.col(index) >= 0, F.get("__tf_a", F.col(index)))
    defect = F.when(F.col("__tf_a").isNull(), "no_holder").when(element.isNull(), "no_element")
    return joined.select(*refs.columns, element.alias("element"), defect.alias("defect"))


def descriptor_findings(tables: DataFrame) -> DataFrame:
    """(descriptor, name, problem) of declared tables (descriptor, name, min_rows, max_rows, reference_rows, expanded_rows).

    Names are unique within a descriptor; least is not above most; a reference population lies within
    the bounds' least and below the expanded one.
    """
    rule = lambda condition, name: F.when(F.coalesce(condition, F.lit(False)), F.lit(name))
    problems = F.array_compact(
        F.array(
            rule(F.col("min_rows") > F.col("max_rows"), "bounds_reversed"),
            rule(F.col("reference_rows") < F.col("min_rows"), "reference_below_minimum"),
            rule(F.col("reference_rows") >= F.col("expanded_rows"), "reference_not_below_expanded"),
            rule(F.col("expanded_rows") > F.col("max_rows"), "expanded_beyond_capacity"),
        )
    )
    repeated = tables.groupBy("descriptor", "name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("descriptor", "name", F.lit("name_repeated").alias("problem"))
    return tables.select("descriptor", "name", F.explode(problems).alias("problem")).unionByName(repeated)


def table_differences(declared: DataFrame, native: DataFrame, on: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(key..., field, declared, native): tables on one side only (field ``table``) and fields that differ."""
    a = declared.select(*on, F.lit(True).alias("__tf_a"), *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    b = native.select(*on, F.lit(True).alias("__tf_b"), *[F.col(f).cast("string").alias(f"b_{f}") for f in fields])
    both = a.join(b, list(on), "full")
    lone = F.when(F.col("__tf_a").isNull() | F.col("__tf_b").isNull(), F.struct(F.lit("table").alias("field"), F.col("__tf_a").cast("string").alias("declared"), F.col("__tf_b").cast("string").alias("native")))
    each = [F.when(lone.isNull() & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("declared"), F.col(f"b_{f}").alias("native"))) for f in fields]
    return both.select(*on, F.explode(F.array_compact(F.array(lone, *each))).alias("d")).select(*on, "d.*")


def records(df: DataFrame, name: Column, fields: Mapping[str, Column]) -> DataFrame:
    """(df's columns, name, content, sha256): each row as a record of sorted keys, with the hash of its bytes."""
    content = canonical_json(fields)
    return df.select("*", name.alias("name"), content.alias("content")).withColumn("sha256", F.sha2("content", 256))


def publication(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(name, sha256, state) of records (name, sha256) against those that exist: ``missing`` there, ``identical`` or ``different``.

    A publication that creates once refuses all where any is different.
    """
    named = existing.select("name", F.lit(True).alias("__tf_named")).distinct()
    same = existing.select("name", "sha256", F.lit(True).alias("__tf_same")).distinct()
    state = F.when(F.col("__tf_named").isNull(), "missing").when(F.col("__tf_same"), "identical").otherwise("different")
    return new.select("name", "sha256").distinct().join(named, "name", "left").join(same, ["name", "sha256"], "left").select("name", "sha256", state.alias("state"))


def instantiation(assets: DataFrame, target: str, authorized: Mapping[str, bool], provenance: str | None) -> DataFrame:
    """(source, target, sha256): the copies that make one release's assets (path, sha256) in a target folder.

    Refused (ValueError) unless everything is authorized, a provenance is named, the target is a safe
    relative folder, and every asset is safe, bound by one hash, and copied to a name of its own.
    """
    refused = [k for k, v in sorted(authorized.items()) if not v]
    if refused or not authorized:
        raise ValueError(f"not authorized: {', '.join(refused) or 'nothing is'}")
    if not (provenance or "").strip():
        raise ValueError("no provenance is named")
    plan = assets.select("path", "sha256").distinct().withColumn("target", F.concat(F.lit(f"{target}/"), F.substring_index("path", "/", -1)))
    bad = plan.filter(~safe_path(F.col("path")) | ~safe_path(F.col("target")) | F.col("sha256").isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"asset {bad[0].path!r} is not bound safely")
    twice = plan.groupBy("target").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several assets would be {twice[0].target!r}")
    return plan.select(F.col("path").alias("source"), "target", "sha256")


def gate(findings: DataFrame) -> None:
    """Raises ValueError with a count by rule if there is any finding: what stands before every use of a library."""
    found = findings.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).orderBy("rule").limit(50).collect()
    if found:
        raise ValueError("; ".join(f"{r.rule}: {r.n}" for r in found))


def measured(df: DataFrame, **metrics: Column) -> DataFrame:
    """(metric, value) of several aggregates of df, in one pass."""
    one = df.agg(*[c.cast("string").alias(k) for k, c in metrics.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics])).alias("m")).select("m.*")


def verified(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(metric, expected, observed) of metrics (metric, value) that differ or are on one side only."""
    both = expected.select("metric", F.col("value").alias("expected")).join(observed.select("metric", F.col("value").alias("observed")), "metric", "full")
    return both.filter(~F.col("expected").eqNullSafe(F.col("observed")))


#: Severities of a check's states, the gravest last.
STATES = ("PASS", "CANNOT_CHECK", "INCOMPATIBLE")


def folded(df: DataFrame, by: Sequence[str], state: str, states: Sequence[str] = STATES) -> DataFrame:
    """(by..., state): the gravest state of each group; an unknown state is the gravest of all but one, CANNOT_CHECK."""
    grave = reduce(lambda out, i: F.when(F.col(state) == states[i], i).otherwise(out), range(len(states)), F.lit(len(states) - 2))
    most = df.groupBy(*by).agg(F.max(grave).alias("__tf_g"))
    return most.select(*by, F.get(F.array(*map(F.lit, states)), F.col("__tf_g")).alias("state"))


def version_state(actual: Column, wanted: Column, exact: bool = True) -> Column:
    """PASS where a version equals (or, if not exact, begins like) the wanted one; CANNOT_CHECK where there is none."""
    holds = actual == wanted if exact else (actual == wanted) | F.startswith(actual, F.concat(wanted, F.lit(".")))
    return F.when(actual.isNull() | (F.trim(actual) == ""), "CANNOT_CHECK").when(holds, "PASS").otherwise("INCOMPATIBLE")
