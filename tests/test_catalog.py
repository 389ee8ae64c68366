from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import scalars
from tallyforge.operators import catalog as c
from tallyforge.operators.catalog import Plan, Request

PROFILES = "template_id string, version string, submission_profile_id string, status string, fingerprint string, facets map<string,array<string>>, qualified array<struct<facet:string,value:string,change_kind:string>>, material_kinds array<string>"
CATALOG = "template_id string, version string, release_status string, supported_consumers array<string>, capabilities array<string>, artifact_type string, authority string"


def profiles(spark):
    rows = [
        ("T1", "1.0.0", "P1", "reviewed", "f1", {"industry": ["retail"], "producer_role": ["clerk", "auditor"]}, [("producer_role", "auditor", "producer_workflow")], ["producer_workflow"]),
        ("T2", "1.0.0", "P1", "reviewed", "f2", {"industry": ["retail"]}, None, []),
        ("T3", "1.0.0", "P2", "reviewed", "f2", {"industry": ["retail", "energy"]}, [], ["calculation_model"]),
        ("T4", "1.0.0", "P3", "draft", "f4", {"industry": ["retail"]}, [], []),
    ]
    return spark.createDataFrame(rows, PROFILES)


def entries(spark):
    return spark.createDataFrame([(t, "1.0.0", s, ["app"], ["sum"], "xlsx", "supporting") for t, s in (("T1", "released"), ("T2", "released"), ("T3", "deprecated"), ("T4", "released"), ("T5", "candidate"))], CATALOG)


def ranked(spark, history=(), **request):
    uses = spark.createDataFrame([(i, t, "1.0.0") for i, t in enumerate(history)], "seq bigint, template_id string, version string")
    got = c.recommend(profiles(spark), entries(spark), uses, Request(**request)).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
    return [r.template_id for r in got], {r.template_id: r for r in got}


def test_order_without_history(spark):
    assert ranked(spark)[0] == ["T1", "T2", "T3"]  # deprecated last, drafts never


def test_lineage_and_fingerprint_lower_a_candidate(spark):
    # the last use is dropped; its profile mate and its fingerprint's mate are counted
    order, rows = ranked(spark, ["T2"])
    assert order == ["T1", "T3"] and rows["T1"].lineage == 1 and rows["T3"].alike == 1
    assert "diversity_fingerprint_repeated" in rows["T3"].reasons and "submission_lineage_repeated" in rows["T1"].reasons


def test_exact_reuse_needs_a_material_plan(spark):
    history = ["T1", "T3"]
    assert ranked(spark, history)[0] == ["T2"]
    order, rows = ranked(spark, history, plan=Plan("T1", "1.0.0", ["producer_workflow"]))
    assert order == ["T2", "T1"] and rows["T1"].exact == 1
    assert ranked(spark, history, plan=Plan("T1", "1.0.0", ["cosmetic"]))[0] == ["T2"]


def test_consecutive_reuse_stays_blocked(spark):
    assert "T1" not in ranked(spark, ["T2", "T1"], plan=Plan("T1", "1.0.0", ["producer_workflow"]))[0]


def test_window_is_the_end_of_the_whole_history(spark):
    assert ranked(spark, ["T1", "T5".replace("5", "4"), "T4"], window=2)[0] == ["T1", "T2", "T3"]


def test_qualified_facet_needs_its_kind(spark):
    assert ranked(spark, facets={"producer_role": "auditor"})[0] == []
    assert ranked(spark, facets={"producer_role": "clerk"})[0] == ["T1"]
    order, rows = ranked(spark, facets={"producer_role": "auditor"}, plan=Plan("T1", "1.0.0", ["producer_workflow"]))
    assert order == ["T1"] and "facet_applicability_material_transformation_planned" in rows["T1"].reasons


def test_refusals(spark):
    with pytest.raises(ValueError, match="unknown entry"):
        ranked(spark, ["T9"])
    with pytest.raises(ValueError, match="conflicts"):
        Request(equal={"authority": "a"}, facets={"authority_class": "b"}).check()
    with pytest.raises(ValueError, match="no reviewed profile"):
        ranked(spark, plan=Plan("T4", "1.0.0", ["x"]))
    with pytest.raises(ValueError, match="exact version"):
        c.select_exact(entries(spark), "T1", "latest")
    assert c.no_match_reason(profiles(spark), entries(spark), Request(equal={"artifact_type": "pdf"})) == "no_compatible_profiled_template"
    assert c.no_match_reason(profiles(spark), entries(spark), Request()) == "reuse_policy_blocked_all_candidates"


def test_discover(spark):
    e = entries(spark)
    ids = lambda df: [r.template_id for r in df.collect()]
    assert ids(c.discover(c.selectable(e))) == ["T1", "T2", "T3", "T4"]
    assert ids(c.discover(e, {"release_status": "deprecated"}, {"capabilities": []}, {"authority": " SUPPORTING\u200b"})) == ["T3"]
    assert ids(c.discover(e, supersets={"capabilities": ["sum", "other"]})) == []
    assert ids(c.select_exact(e, "T2", "1.0.0")) == ["T2"] and c.key_defects(e).count() == 0
    found = c.entry_findings(e, ["artifact_type"], {"release_status": ["released", "deprecated"]}, spark.createDataFrame([("other",)], "consumer_id string"))
    assert {(r.rule, r.subject) for r in found.collect()} == {("value_not_allowed", "T5@1.0.0")} | {("consumer_unknown", f"T{i}@1.0.0") for i in range(1, 6)}


def test_fingerprint_ignores_order_and_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "x", None, ["b", "a", "b"]), (2, "x", None, ["a", "b"])], "i int, d1 string, d2 string, ids array<string>")
    got = {r.i: r.f for r in df.select("i", scalars.fingerprint({"d2": F.col("d2"), "d1": F.col("d1")}, F.col("ids")).alias("f")).collect()}
    payload = {"diversity_dimensions": {"d1": "x", "d2": None}, "semantic_pattern_ids": ["a", "b"]}
    assert got[1] == got[2] == hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
