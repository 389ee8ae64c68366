from __future__ import annotations

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.functions.structure import index
from tallyforge.operators import nested


def brute(body: str | None) -> set[tuple]:
    """The same rows from the standard library's parser."""
    try:
        d = json.loads(body)
    except (TypeError, ValueError):
        return set()
    each = lambda x: [] if x is None else x if isinstance(x, list) else [x]
    text = lambda v: v if isinstance(v, str) else json.dumps(v)
    out = []
    for tp, t in enumerate(each(d.get("templates")) if isinstance(d, dict) else []):
        if not isinstance(t, dict):
            continue
        out.append((tp, "template", tp, t.get("template_id")))
        for c in nested.PROFILE.children:
            if c.by_field:
                for k, v in (t.get(c.path) if isinstance(t.get(c.path), dict) else {}).items():
                    out.append((tp, c.kind + k, 0, v.get(c.key) if isinstance(v, dict) else None))
                continue
            for i, v in enumerate(each(t.get(c.path))):
                key = v.get(c.key) if isinstance(v, dict) else v if c.bare and isinstance(v, str) else None
                out.append((tp, c.kind, i, key))
    return {(a, b, c, text(k)) for a, b, c, k in out if k is not None}


def rows(bodies: list[str | None]) -> list[set[tuple]]:
    ix = index([b.encode("utf-8", "surrogatepass") if b is not None else None for b in bodies])
    got: list[set[tuple]] = [set() for _ in bodies]
    for record, parent, kinds, place, keys, _ in nested._rows(ix, nested.PROFILE):
        for i, r in enumerate(record.tolist()):
            if keys[i] is not None:
                got[r].add((int(parent[i]), kinds if isinstance(kinds, str) else kinds[i], int(place[i]), keys[i]))
    return got


leaf = st.one_of(st.none(), st.booleans(), st.integers(-99, 99), st.text(alphabet='ab"\\{}[],: é\n', max_size=6))
child = st.one_of(leaf, st.dictionaries(st.sampled_from(["card_id", "path", "sha256", "blueprint_id", "x"]), leaf, max_size=3))
part = st.one_of(child, st.lists(child, max_size=3))
template = st.one_of(leaf, st.dictionaries(st.sampled_from(["template_id", "foundation_cards", "blueprint", "native_assets", "release"]), part, max_size=4).flatmap(lambda d: st.dictionaries(st.sampled_from(["render", "a.b", 'q"x']), child, max_size=2).map(lambda e: d | {"evidence": e})))
profile = st.one_of(leaf, st.lists(leaf, max_size=2), st.dictionaries(st.sampled_from(["status", "x"]), part, max_size=2).flatmap(lambda d: st.one_of(template, st.lists(template, max_size=3)).map(lambda t: d | {"templates": t})))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(profile, st.sampled_from([None, 1]), st.booleans()), min_size=1, max_size=6))
def test_well_formed(docs):
    bodies = [json.dumps(d, indent=i, ensure_ascii=a) for d, i, a in docs]

    def same(k: str) -> str:
        """A key that is neither text nor null comes out as its text, in whatever spacing and escapes."""
        try:
            return json.dumps(json.loads(k)) if k[:1] in "{[" else k
        except ValueError:
            return k

    squeeze = lambda s: {(a, b, c, same(k)) for a, b, c, k in s}
    assert [squeeze(x) for x in rows(bodies)] == [squeeze(brute(b)) for b in bodies]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet='{}[]":,a1\\ ', max_size=25), min_size=1, max_size=8))
def test_malformed_never_hurts_its_neighbours(texts):
    good = '{"templates": [{"template_id": "T", "blueprint": {"blueprint_id": "B"}}]}'
    bodies = [x for t in texts for x in (t, good)]
    got = rows(bodies)
    assert all(got[i] == brute(good) for i in range(1, len(bodies), 2))


@pytest.mark.parametrize("bad", ["", " ", "{", "}", '{"a"}', '{"a":1,}', "[1,]", '{"a":[1}', '{"a" "b"}', '{"a":"b}', "{}{}", '{"a":x}', '{"a":1 2:3}', "{1:2}", '{"t":[1 2]}', '{"t":[]} garbage', 'garbage {"a":1}', '{"x": nope}', '{"a":12abc}', '{"a":"\x01"}', '{"a":"b\nc"}', '{"a":"\\x"}', '{"a":"\\u12g4"}', '{"a":01}', '{"a":1.}', '{"a":-}', '{"a":.5}', '{"a":+1}', '{"a":1e}', '{"a":nul}', '{"a":nullx}', '{"a":True}', '{"a":NaN}', '{"a":"\\', '"text"', "12", "null", '{"a":1}\x0b', '{"a":' + "1" * 80 + "x}"])
def test_malformed_is_flagged(bad):
    assert index([bad.encode(), b'{"a": [1, {"b": "c"}]}']).bad.tolist() == [True, False]


@pytest.mark.parametrize("good", ['{"a":-0.5e+10}', '{"a":0}', '{"a":[true,false,null,1E5,-1]}', ' \t\r\n{"a" : 10 } \n', '{"a":"\\u00e9\\/\\b"}', '{"a":' + "1" * 80 + ".5}", "[]", "[ ]", "{ }", '{"a":"\\\\"}', '{"\\"":1}'])
def test_well_formed_is_not_flagged(good):
    json.loads(good)
    assert index([good.encode(), b"{", good.encode()]).bad.tolist() == [False, True, False]


def strict(text: str) -> bool:
    """Whether the standard library's parser takes the text for an object or array."""

    def no(name: str) -> None:
        raise ValueError(name)

    try:
        return isinstance(json.loads(text, parse_constant=no), (dict, list))
    except ValueError:
        return False


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(profile, st.integers(0, 400), st.integers(0, 3), st.sampled_from(["", " ", "x", "1", "-", "0", ".", "e", '"', "\\", "{", "}", "[", "]", ",", ":", "\x01", "\n", "null", "u12"])), min_size=1, max_size=6))
def test_mutated_profiles_are_judged_as_by_a_parser(cases):
    texts = []
    for doc, at, cut, put in cases:
        t = json.dumps(doc)
        at %= len(t) + 1
        texts.append(t[:at] + put + t[at + cut :])
    assert index([t.encode("utf-8", "surrogatepass") for t in texts]).bad.tolist() == [not strict(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='{}[]":,0.-e1tn\\ \n', max_size=14), min_size=1, max_size=8))
def test_any_text_is_judged_as_by_a_parser(texts):
    assert index([t.encode() for t in texts]).bad.tolist() == [not strict(t) for t in texts]


def test_a_malformed_record_gives_one_row(spark):
    bad = ['{"templates":[1 2]}', '{"templates":[{"template_id":"T"}]} x', 'x {"templates":[{"template_id":"T"}]}', '{"templates":[{"template_id":nope}]}', '{"templates":[{"template_id":12a}]}', '{"templates":[{"template_id":"a\x02"}]}']
    df = spark.createDataFrame(list(enumerate(bad)), "i long, body string")
    got = [(r.i, r.kind) for r in nested.flatten(df, "body", ["i"], malformed=True).collect()]
    assert sorted(got) == [(i, "malformed") for i in range(len(bad))]


def test_repeated_field_counts_once_with_its_last_value():
    assert rows(['{"templates": {"template_id": "x", "template_id": "y", "evidence": {"a": {"sha256": "1"}, "a": {"sha256": "2"}}}}']) == [{(0, "template", 0, "y"), (0, "evidence.a", 0, "2")}]


def test_long_and_escaped():
    body = json.dumps({"x": "\\\"{[" * 200_000, "templates": [{"native_assets": ["a" * 500_000, None, 'q"\\']}]})
    assert rows([body]) == [brute(body)]


def test_flatten_in_spark(spark):
    data = [(1, '{"templates": [null, {"foundation_cards": {"card_id": "C"}}]}', "x"), (2, None, "y"), (3, "{oops", "z"), (4, "[]", None)]
    df = spark.createDataFrame(data, "profile_seq long, body string, kind string")
    got = nested.flatten(df, "body", ["profile_seq"], malformed=True).filter("kind <> 'template'").collect()
    assert {(r.profile_seq, r.parent_pos, r.kind, r.child_pos, r.child_key) for r in got} == {(1, 1, "foundation_card", 0, "C"), (2, 0, "malformed", 0, None), (3, 0, "malformed", 0, None)}
    assert nested.flatten(df.limit(0), "body", ["profile_seq"]).count() == 0
    with pytest.raises(ValueError, match="clash"):
        nested.flatten(df, "body", ["profile_seq", "kind"])


def test_children_inherit_fields_of_their_parent(spark):
    layout = nested.Layout("templates", "template", "template_id", (nested.Child("asset", "assets", "path", bare=True),), ("path",), ("template_id", "facets"))
    body = '{"templates": [{"template_id": "A", "facets": {"m": [1]}, "assets": ["x", {"path": "y"}]}, {"assets": "z"}, {"template_id": null}]}'
    df = spark.createDataFrame([(1, body), (2, "{")], "i int, body string")
    got = {(r.parent_pos, r.kind, r.child_pos): (r.child_key, r.parent_template_id, r.parent_facets) for r in nested.flatten(df, "body", ["i"], layout).collect()}
    assert got[0, "asset", 0] == ("x", "A", '{"m": [1]}') and got[0, "asset", 1] == ("y", "A", '{"m": [1]}') and got[1, "asset", 0] == ("z", None, None)
    assert got[0, "template", 0] == ("A", "A", '{"m": [1]}') and got[2, "template", 2] == (None, None, None) and len(got) == 6
    with pytest.raises(ValueError, match="clash"):
        nested.flatten(df.withColumn("parent_facets", df.i), "body", ["parent_facets"], layout)


def test_empty_batch():
    assert len(index([]).bad) == 0 and not np.any(index([None]).root >= 0)
