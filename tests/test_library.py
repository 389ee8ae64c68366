from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import documents, scalars
from tallyforge.operators import findings, library, skew


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_not_one(spark):
    refs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, k string")
    held = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "k string, v int")
    assert rows(library.not_one(refs, held, ["k"]).select("id", "n")) == [(2, 2), (3, 0), (4, 0)]
    assert library.not_one(refs.limit(0), held, ["k"]).count() == 0
    assert library.not_one(refs, held.limit(0), ["k"]).count() == 4


def test_incomplete(spark):
    subjects = spark.createDataFrame([(1,), (2,), (3,)], "s int")
    items = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "x"), (2, "other"), (2, None)], "s int, item string")
    assert rows(library.incomplete(subjects, items, ["s"], "item", ["x", "y"])) == [(2, "x", 2), (2, "y", 0), (3, "x", 0), (3, "y", 0)]


def test_conflicts(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 1, None), ("k", 2, "a"), (None, 1, "a"), (None, 1, "b")], "k string, n int, t string")
    assert rows(library.conflicts(df, ["k"], ["n", "t"])) == [("k", "n", 2), (None, "t", 2)]


def test_owned(spark):
    df = spark.createDataFrame([("r/a", "r"), ("r/../a", "r"), ("ra/a", "r"), ("r", "r"), (None, "r"), ("r/a", None)], "p string, r string")
    assert [r.x for r in df.select(library.owned(F.col("p"), F.col("r")).alias("x")).collect()] == [True, False, False, False, False, False]


def test_elements(spark):
    refs = spark.createDataFrame([("a", 0), ("a", 2), ("a", -1), ("b", 0), ("c", 0)], "k string, i int")
    held = spark.createDataFrame([("a", ["x", "y"]), ("b", [None])], "k string, v array<string>")
    assert rows(library.elements(refs, held, ["k"], "i", "v")) == [("a", -1, None, "no_element"), ("a", 0, "x", None), ("a", 2, None, "no_element"), ("b", 0, None, "no_element"), ("c", 0, None, "no_holder")]


def test_descriptor_findings(spark):
    t = spark.createDataFrame([("d", "a", 1, 5, 2, 3), ("d", "b", 6, 5, 9, 9), ("d", "c", 1, 5, 0, 6), ("e", "x", None, None, None, None), ("e", "x", 1, 2, 1, 2)], "descriptor string, name string, min_rows int, max_rows int, reference_rows int, expanded_rows int")
    assert rows(library.descriptor_findings(t)) == [("d", "b", "bounds_reversed"), ("d", "b", "expanded_beyond_capacity"), ("d", "b", "reference_not_below_expanded"), ("d", "c", "expanded_beyond_capacity"), ("d", "c", "reference_below_minimum"), ("e", "x", "name_repeated")]


def test_table_differences(spark):
    a = spark.createDataFrame([("S", "T", "A1:B2", 5), ("S", "U", "A1", 1)], "sheet string, name string, ref string, capacity int")
    b = spark.createDataFrame([("S", "T", "A1:B3", 5), ("S", "V", "A1", 1)], "sheet string, name string, ref string, capacity int")
    assert rows(library.table_differences(a, b, ["sheet", "name"], ["ref", "capacity"])) == [("S", "T", "ref", "A1:B2", "A1:B3"), ("S", "U", "table", "true", None), ("S", "V", "table", None, "true")]
    assert library.table_differences(a, a, ["sheet", "name"], ["ref", "capacity"]).count() == 0


def test_records_and_publication(spark):
    df = spark.createDataFrame([("r1", 1, None), ("r2", 2, "x")], "id string, b int, a string")
    made = library.records(df, F.col("id"), {"b": F.col("b"), "a": F.col("a")})
    by = {r.name: r for r in made.collect()}
    assert by["r1"].content == '{"a":null,"b":1}' and by["r2"].sha256 == hashlib.sha256(json.dumps({"a": "x", "b": 2}, separators=(",", ":")).encode()).hexdigest()
    held = spark.createDataFrame([("r2", by["r2"].sha256), ("r1", "other")], "name string, sha256 string")
    state = lambda h: rows(library.publication(made, h).select("name", "state"))
    assert state(held) == [("r1", "different"), ("r2", "identical")] and state(held.limit(0)) == [("r1", "missing"), ("r2", "missing")]
    assert state(held.union(spark.createDataFrame([("r2", "older"), ("r1", "older")], held.schema))) == [("r1", "different"), ("r2", "identical")]


def test_instantiation_gates(spark):
    good = spark.createDataFrame([("a/x.csv", "1"), ("a/y.csv", "2"), ("a/x.csv", "1")], "path string, sha256 string")
    yes = {"synthetic": True, "copy": True}
    assert rows(library.instantiation(good, "out", yes, "p")) == [("a/x.csv", "out/x.csv", "1"), ("a/y.csv", "out/y.csv", "2")]
    for assets, target, allowed, provenance in (
        (good, "out", {"synthetic": False, "copy": True}, "p"),
        (good, "out", {}, "p"),
        (good, "out", yes, " "),
        (good, "../out", yes, "p"),
        (good.union(spark.createDataFrame([("b/x.csv", "3")], good.schema)), "out", yes, "p"),
        (good.union(spark.createDataFrame([("a/../z", "3")], good.schema)), "out", yes, "p"),
        (good.union(spark.createDataFrame([("a/z", None)], good.schema)), "out", yes, "p"),
    ):
        with pytest.raises(ValueError):
            library.instantiation(assets, target, allowed, provenance)


def test_gate(spark):
    some = findings.finding(spark.range(2), "rule_a", F.col("id"), F.lit("x"))
    library.gate(some.limit(0))
    with pytest.raises(ValueError, match="rule_a: 2"):
        library.gate(some)


def test_measured_and_verified(spark):
    df = spark.range(5)
    a = library.measured(df, n=F.count(F.lit(1)), s=F.sum("id"))
    b = library.measured(df.filter("id > 0"), n=F.count(F.lit(1)), s=F.sum("id"), more=F.max("id"))
    assert rows(library.verified(a, b)) == [("more", None, "4"), ("n", "5", "4")]


def test_states(spark):
    df = spark.createDataFrame([("a", "PASS"), ("a", "odd"), ("b", "PASS"), ("c", "INCOMPATIBLE"), ("c", "CANNOT_CHECK"), ("d", None)], "k string, s string")
    assert rows(library.folded(df, ["k"], "s")) == [("a", "CANNOT_CHECK"), ("b", "PASS"), ("c", "INCOMPATIBLE"), ("d", "CANNOT_CHECK")]
    v = spark.createDataFrame([("1.2.3", "1.2"), ("1.20", "1.2"), ("1.2", "1.2"), (None, "1"), (" ", "1")], "a string, w string")
    got = [tuple(r) for r in v.select(library.version_state(F.col("a"), F.col("w")), library.version_state(F.col("a"), F.col("w"), exact=False)).collect()]
    assert got == [("INCOMPATIBLE", "PASS"), ("INCOMPATIBLE", "INCOMPATIBLE"), ("PASS", "PASS"), ("CANNOT_CHECK", "CANNOT_CHECK"), ("CANNOT_CHECK", "CANNOT_CHECK")]


def test_coercion_and_keys(spark):
    assert library.as_list([1]) == [1] and library.as_list({"a": 1}) == [] and library.as_dict({"a": 1}) == {"a": 1} and library.as_dict(None) == {}
    assert [r[0] for r in spark.createDataFrame([("a", "1"), (None, "1")], "t string, v string").select(library.entry_key(F.col("t"), F.col("v"))).collect()] == ["a@1", None]


def test_pointed_and_object_flags(spark):
    texts = [(1, '{"a": [1, {"b/c": "x"}], "n": null}'), (2, "[1]"), (3, "{oops"), (4, None), (5, "")]
    df = spark.createDataFrame(texts, "i int, t string")
    got = {(r.i, r.pointer): r.value for r in documents.pointed(df, "t", ["i"], ["/a/1/b~1c", "/a/0", "/n", "/0", ""]).collect()}
    assert got[1, "/a/1/b~1c"] == "x" and got[1, "/a/0"] == "1" and got[1, "/n"] is None and got[2, "/0"] == "1" and got[3, ""] is None and got[2, ""] == "[1]"
    assert [r.is_object for r in documents.object_flags(df, "t").orderBy("i").collect()] == [True, False, False, False, False]


def test_ranked_numbers_a_total_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit(1).alias("tie"))
    got = skew.ranked(df, ["tie", "v"]).collect()
    assert sorted((r["rank"], r.v) for r in got) == [(i + 1, i) for i in range(1000)]
    assert skew.ranked(df.limit(0), ["v"]).count() == 0


def test_manifests_stream_over_packages(spark):
    members = [("p", "b", "2"), ("p", "a", "1"), (None, "x", "9"), ("q", "z", "5"), ("q", None, "5")] + [("big", f"{i:05}", "d") for i in range(20_000)]
    got = {r.pkg: r.manifest for r in scalars.manifests(spark.createDataFrame(members, "pkg string, n string, d string"), "pkg", "n", "d").collect()}
    want = lambda lines: hashlib.sha256("".join(f"{n}\0{d}\n" for n, d in sorted(lines)).encode()).hexdigest()
    assert got == {"p": want([("a", "1"), ("b", "2")]), None: want([("x", "9")]), "q": want([("z", "5")]), "big": want([(f"{i:05}", "d") for i in range(20_000)])}
