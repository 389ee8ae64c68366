from __future__ import annotations

import json
import random
import re
from collections import defaultdict

import pytest

from tallyforge.llm import copies


def brute(rows):
    groups = defaultdict(set)
    for i, text in rows:
        if text is None or i is None:
            continue
        found = {}
        hits = list(re.finditer("(?i)" + "|".join(copies.LABELS.values()), text))
        for k, m in enumerate(hits):
            name = next(n for n, p in copies.LABELS.items() if re.fullmatch("(?i)" + p, m[0]))
            found.setdefault(name, text[m.end() : hits[k + 1].start() if k + 1 < len(hits) else len(text)])
        if len(found) == 3:
            groups[tuple("".join(c for c in found[n].upper().lower() if c.isalnum()) for n in copies.LABELS)].add(i)
    return {(min(g), i) for g in groups.values() for i in g if i != min(g)}, {(min(g), len(g)) for g in groups.values()}


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "capture_id long, record_text string, field string, v int")
    tuples = copies.encoded(df, "capture_id", "record_text")
    got = [tuple(r) for r in copies.copies(tuples).collect()]
    assert len(got) == len(set(got))
    pairs, sizes = brute(rows)
    assert set(got) == pairs
    assert {(r.keep_id, r.n) for r in copies.groups(tuples).collect()} == sizes


def layouts(r, values):
    e, a, d = (v if r.random() < 0.5 else v.upper() for v in values)
    d = d.replace(" ", r.choice([" ", "  ", "\t", "\xa0", "\n"])) + r.choice(["", ".", " "])
    named = [("entity_code", e), ("account_code", a), ("description", d)]
    r.shuffle(named)
    return r.choice(
        [
            lambda: " | ".join(f"{k.replace('_', ' ')}: {v}" for k, v in named),
            lambda: ";".join(f"{k} = {v} " for k, v in named),
            lambda: "{" + ", ".join(f'"{k.title().replace("_", "")}": "{v}"' for k, v in named) + "}",
        ]
    )()


@pytest.mark.parametrize("seed", [1, 2])
def test_layouts_and_hot_groups(spark, seed, monkeypatch):
    from tallyforge.operators import skew

    monkeypatch.setattr(skew.look_up, "__defaults__", ("inner", 20))
    r = random.Random(seed)
    base = [(f"ent-{r.randrange(9)}", str(r.randrange(30)), f"ref {r.randrange(40)} café note") for _ in range(60)]
    # one record makes up a third of all rows
    rows = [(i, layouts(r, base[0] if r.random() < 0.35 else r.choice(base))) for i in range(500)]
    check(spark, rows + rows[:10])


def test_edges(spark):
    same = "entity code: E-1 | account code: 2 | description: {}"
    rows = [
        (1, same.format("a b")),
        (2, same.format("A-B.")),
        (3, same.format("ab2")),
        (4, None),
        (5, ""),
        (6, "entity code: E-1 | description: ab"),
        (7, same.format("")),
        (8, same.format("--")),
        (9, same.format("x" * 1_000_000)),
        (10, same.format("X " * 1_000_000)),
        (None, same.format("a b")),
        (11, "nothing"),
    ]
    check(spark, rows)
    check(spark, [])


def test_json_escapes_are_undone(spark):
    rows = [(1, json.dumps({"entity_code": "E1", "account_code": "2", "description": 'café\t"x"'})), (2, "entity code: e1; account code: 2; description: CAFÉ x")]
    df = spark.createDataFrame(rows, "capture_id long, record_text string")
    assert [tuple(r) for r in copies.copies(copies.encoded(df, "capture_id", "record_text")).collect()] == [(1, 2)]


def test_dictionary_counts_spellings_and_records(spark, monkeypatch):
    rows = [(i, f"entity code: {e} | account code: 1 | description: {d}") for i, (e, d) in enumerate([("E-1", "a b"), ("e1", "A.B"), ("E 1", "a b"), ("E2", "c")])]
    df = spark.createDataFrame([*rows, rows[0], (9, None)], "capture_id long, record_text string")
    for entries in (copies.ENTRIES, 1):
        monkeypatch.setattr(copies, "ENTRIES", entries)
        got = {(r.field, r.value): (r.spellings, r.records) for r in copies.dictionary(df, "capture_id", "record_text").collect()}
        assert got == {("entity_code", "e1"): (3, 3), ("entity_code", "e2"): (1, 1), ("account_code", "1"): (1, 4), ("description", "ab"): (2, 3), ("description", "c"): (1, 1)}


def test_many_groups_meet_in_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(copies, "BROADCAST_GROUPS", 3)
    r = random.Random(5)
    base = [(f"e{r.randrange(9)}", str(i), "x y") for i in range(40)]
    check(spark, [(i, layouts(r, base[0] if r.random() < 0.35 else r.choice(base))) for i in range(400)])


@pytest.mark.parametrize(("a", "b"), [("Straße", "STRASSE"), ("ΟΔΟΣ", "οδος-"), ("ΟΔΟΣ 1", "οδοσ1"), ("İ", "i"), ("ﬁn", "FIN"), ("１２", "１-２"), ("é", "E")])
def test_case_is_ignored_in_any_script(a, b):
    assert copies.canonical(a) == copies.canonical(b)
