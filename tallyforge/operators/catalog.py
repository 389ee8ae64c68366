"""Discovery, exact selection and history-aware recommendation over a catalog of entries.

A request is a small document, checked on the driver; the catalog, profiles and history are tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions.scalars import identity, superset
from tallyforge.operators import skew
from tallyforge.operators.findings import finding, together

SELECTABLE = ("deprecated", "released")
#: Labels that name no exact version; the last three are ours.
FLOATING = ("latest", "current", "stable", "head", "main", "master")
#: Why an entry is recommended, and why none is.
REVIEWED, COMPATIBLE, NOT_RECENT, REUSE_PLANNED = "reviewed_profile", "profile_compatible", "exact_not_recent", "exact_reuse_material_transformation_planned"
FACET_PLANNED, LINEAGE_REPEATED, FINGERPRINT_REPEATED = "facet_applicability_material_transformation_planned", "submission_lineage_repeated", "diversity_fingerprint_repeated"
BLOCKED, NOTHING = "reuse_policy_blocked_all_candidates", "no_compatible_profiled_template"


def selectable(df: DataFrame, status: str = "release_status") -> DataFrame:
    return df.filter(F.col(status).isin(*SELECTABLE))


def discover(
    catalog: DataFrame,
    equal: Mapping[str, object] | None = None,
    supersets: Mapping[str, Sequence[str]] | None = None,
    same_text: Mapping[str, str] | None = None,
    order: Sequence[str] = ("template_id", "version"),
) -> DataFrame:
    """Entries that meet every condition given, in a fixed order.

    equal: columns with exact values (None asks nothing). supersets: array columns that must hold all
    values. same_text: columns equal as identities (compatibility forms, case, invisible characters).
    Plain equalities reach the scan; the identity comparison comes last.
    """
    out = catalog
    for c, v in (equal or {}).items():
        if v is not None:
            out = out.filter(F.col(c) == F.lit(v))
    for c, wanted in (supersets or {}).items():
        out = out.filter(superset(F.col(c), wanted))
    for c, v in (same_text or {}).items():
        if v is not None:
            out = out.filter(identity(F.col(c)) == identity(F.lit(v)))
    return out.orderBy(*order)


def select_exact(catalog: DataFrame, template_id: str, version: str, **conditions: object) -> DataFrame:
    """The one entry of an id and version, or none; floating version labels are refused."""
    if not version or version.strip().lower() in FLOATING or any(c in version for c in "*^~><= "):
        raise ValueError(f"version {version!r} names no exact version")
    return discover(catalog, {"template_id": template_id, "version": version}, **conditions).limit(1)  # type: ignore[arg-type]


def key_defects(catalog: DataFrame, keys: Sequence[str] = ("template_id", "version")) -> DataFrame:
    """Selectable keys that occur more than once."""
    return catalog.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def entry_findings(catalog: DataFrame, required: Sequence[str], domains: Mapping[str, Sequence[str]], consumers: DataFrame | None = None) -> DataFrame:
    """Entries with blank required fields, values outside their domain, or consumers not registered."""
    who = F.concat_ws("@", "template_id", "version")
    parts = [finding(catalog.filter(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""), "field_blank", who, F.lit(c)) for c in required]
    parts += [finding(catalog.filter(~F.coalesce(F.col(c).isin(*vs), F.lit(False))), "value_not_allowed", who, F.concat_ws("=", F.lit(c), F.col(c).cast("string"))) for c, vs in domains.items()]
    if consumers is not None:
        each = catalog.select(who.alias("who"), F.explode("supported_consumers").alias("consumer_id"))
        parts.append(finding(each.join(consumers.select("consumer_id").distinct(), "consumer_id", "left_anti"), "consumer_unknown", F.col("who"), F.col("consumer_id")))
    return together(parts)


def facets_match(facets: Column, wanted: Mapping[str, str]) -> Column:
    """Every wanted value is among the facet's values (facets: a map of arrays)."""
    out = F.lit(True)
    for name, value in sorted(wanted.items()):
        out = out & F.coalesce(F.array_contains(F.try_element_at(facets, F.lit(name)), F.lit(value)), F.lit(False))
    return out


def qualified_kinds(qualified: Column, wanted: Mapping[str, str]) -> Column:
    """Change kinds that the wanted values need (qualified: an array of facet, value, change_kind)."""
    asked = F.array(*[F.struct(F.lit(k).alias("facet"), F.lit(v).alias("value")) for k, v in sorted(wanted.items())])
    hits = F.filter(F.coalesce(qualified, F.array().cast("array<struct<facet:string,value:string,change_kind:string>>")), lambda q: F.array_contains(asked, F.struct(q["facet"].alias("facet"), q["value"].alias("value"))))
    return F.array_sort(F.array_distinct(F.transform(hits, lambda q: q["change_kind"])))


@dataclass(frozen=True)
class Plan:
    """A planned transformation of one entry and its kinds of change."""

    template_id: str
    version: str
    change_kinds: Sequence[str] = ()


@dataclass(frozen=True)
class Request:
    consumer: str | None = None
    equal: Mapping[str, object] = field(default_factory=dict)
    capabilities: Sequence[str] = ()
    facets: Mapping[str, str] = field(default_factory=dict)
    window: int = 5
    plan: Plan | None = None

    def check(self) -> None:
        for a, b in (("authority", "authority_class"), ("artifact_type", "medium")):
            if self.equal.get(a) is not None and self.facets.get(b) is not None and self.equal[a] != self.facets[b]:
                raise ValueError(f"{a} conflicts with the facet {b}")
        if not 1 <= self.window <= 50:
            raise ValueError("window is from 1 to 50")


def last_uses(history: DataFrame, n: int, by: Sequence[str], seq: str, keys: Sequence[str]) -> DataFrame:
    """The last n uses of each group, with their place from the end (1 is the last).

    Ordered within groups; only the n best of each group are kept from each partition before the
    shuffle (the planner's window group limit), so a hot group does not gather in one task.
    """
    w = Window.partitionBy(*by).orderBy(F.col(seq).desc(), *[F.col(k).desc() for k in keys])
    return history.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)


def window_counts(uses: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """(by..., key, exact, consecutive): uses of each key within the window, and whether it is the last one."""
    return uses.groupBy(*by, key).agg(F.count(F.lit(1)).alias("exact"), F.max(F.col("back") == 1).alias("consecutive"))


def recommend(profiles: DataFrame, catalog: DataFrame, history: DataFrame, request: Request) -> DataFrame:
    """Ranked candidates: one row each with reuse counts, reasons and rank.

    profiles: (template_id, version, submission_profile_id, status, fingerprint, facets, qualified,
    material_kinds). catalog: (template_id, version, release_status, supported_consumers, capabilities,
    ...). history: (seq, template_id, version), oldest first.

    Only reviewed profiles of selectable entries take part. The window is the end of the whole history,
    before any filter. Exact reuse within it is dropped unless the plan targets that entry with a kind
    of change that is material to it; the very last use is always dropped.
    """
    request.check()
    key = ["template_id", "version"]
    unknown = history.join(selectable(catalog).select(*key), key, "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"history has an unknown entry: {unknown[0].template_id}@{unknown[0].version}")
    reviewed = profiles.filter("status = 'reviewed'")
    plan = request.plan
    planned = F.lit(False)
    if plan is not None:
        target = reviewed.filter((F.col("template_id") == plan.template_id) & (F.col("version") == plan.version)).limit(1).collect()
        if not target:
            raise ValueError("the plan's target has no reviewed profile")
        material = sorted(set(plan.change_kinds) & set(target[0].material_kinds or []))
        planned = (F.col("template_id") == plan.template_id) & (F.col("version") == plan.version) & F.lit(bool(material))
    else:
        material = []
    entries = selectable(catalog)
    if request.consumer:
        entries = entries.filter(superset(F.col("supported_consumers"), [request.consumer]))
    for c, v in request.equal.items():
        if v is not None:
            entries = entries.filter(F.col(c) == F.lit(v))
    entries = entries.filter(superset(F.col("capabilities"), list(request.capabilities)))
    gated = {k: v for k, v in request.facets.items() if k in ("producer_role", "lifecycle")}
    needs = qualified_kinds(F.col("qualified"), gated) if gated else F.array().cast("array<string>")
    met = (F.size("needs") == 0) | (planned & (F.size(F.array_except("needs", F.array(*map(F.lit, material)).cast("array<string>"))) == 0))
    candidates = reviewed.filter(facets_match(F.col("facets"), request.facets)).withColumn("needs", needs).filter(met).join(entries.select(*key, "release_status"), key)

    # the window is bounded by the request (at most 50 rows), and so are its counts
    window = history.orderBy(F.col("seq").desc()).limit(request.window).withColumn("back", F.row_number().over(Window.orderBy(F.col("seq").desc())))
    known = window.join(reviewed.select(*key, "submission_profile_id", "fingerprint"), key, "left")
    exact = window.groupBy(*key).agg(F.count(F.lit(1)).alias("exact"), F.max(F.col("back") == 1).alias("consecutive"))
    lineage = known.filter("submission_profile_id is not null").groupBy("submission_profile_id").agg(F.count(F.lit(1)).alias("lineage"))
    alike = known.filter("fingerprint is not null").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("alike"))
    counted = (
        candidates.join(F.broadcast(exact), key, "left")
        .join(F.broadcast(lineage), "submission_profile_id", "left")
        .join(F.broadcast(alike), "fingerprint", "left")
        .fillna(0, ["exact", "lineage", "alike"])
        .fillna(False, ["consecutive"])
        .filter(~F.col("consecutive") & ((F.col("exact") == 0) | planned))
    )
    order = [F.col("release_status") == "deprecated", F.col("exact") > 0, F.col("lineage"), F.col("alike"), F.col("submission_profile_id"), F.col("template_id"), F.col("version")]
    reasons = F.array_compact(
        F.array(
            F.lit(REVIEWED),
            F.lit(COMPATIBLE),
            F.when(F.col("exact") > 0, REUSE_PLANNED).otherwise(NOT_RECENT),
            F.when(F.size("needs") > 0, FACET_PLANNED),
            F.when(F.col("lineage") > 0, LINEAGE_REPEATED),
            F.when(F.col("alike") > 0, FINGERPRINT_REPEATED),
        )
    )
    return skew.ranked(counted, order).select("rank", *key, "release_status", "submission_profile_id", "fingerprint", "exact", "lineage", "alike", reasons.alias("reasons"))


def no_match_reason(profiles: DataFrame, catalog: DataFrame, request: Request) -> str:
    """Why a recommendation is empty: the history blocked all, or nothing was compatible."""
    empty = profiles.sparkSession.createDataFrame([], "seq bigint, template_id string, version string")
    return BLOCKED if recommend(profiles, catalog, empty, request).limit(1).collect() else NOTHING
