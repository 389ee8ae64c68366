from __future__ import annotations

import random
from collections import Counter

import pytest

from tallyforge.llm import leakage


def brute(docs, items, size):
    grams = {}
    for i, t in items:
        w = leakage.words(t or "")
        for k in range(len(w) - size + 1):
            grams.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = set()
    for d, t in docs:
        w = leakage.words(t or "")
        for k in range(len(w) - size + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + size]), ())}
    return {p for p in out if None not in p}


def found(spark, docs, items, size=leakage.WINDOW, **more):
    d = spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id long, text string, kind string")
    q = spark.createDataFrame([(i, t, "s") for i, t in items], "item_id long, text string, windows string")
    return leakage.leaks(d, q, size, **more).collect()


@pytest.mark.parametrize("seed", range(4))
def test_against_all_windows(spark, seed, monkeypatch):
    monkeypatch.setattr(leakage, "SHARD_CHARS", 3000)
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["é", "Ω", "9"]
    text = lambda n: r.choice([" ", ", ", "\n> "]).join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randrange(0, 25))) for i in range(15)]
    docs = []
    for i in range(120):
        t = text(r.randrange(0, 60))
        if r.random() < 0.4:
            w = leakage.words(r.choice(items)[1])
            a = r.randrange(0, max(1, len(w)))
            t += " -- " + "__".join(w[a : a + r.randrange(1, 20)]).upper() + " " + text(3)
        docs.append((i, t))
    for size in (3, 6, 13):
        got = found(spark, docs, items, size)
        assert {(x.doc_id, x.item_id) for x in got} == brute(docs, items, size)
        assert len({(x.doc_id, x.item_id) for x in got}) == len(got)


def test_edges(spark):
    item = " ".join(f"term{i}" for i in range(13))
    docs = [(1, item), (2, "x " * 300_000 + item.replace(" ", "-").upper()), (3, None), (4, ""), (5, item.rsplit(" ", 1)[0]), (None, item), (1, item)]
    got = found(spark, docs, [(7, item), (8, item), (9, "short"), (10, None), (None, item)])
    assert {(x.doc_id, x.item_id, x.first_word) for x in got} == {(1, 7, 0), (1, 8, 0), (2, 7, 300_000), (2, 8, 300_000)}
    assert found(spark, [], [(7, item)]) == [] and found(spark, docs, []) == [] and found(spark, docs, [(9, "short")]) == []


def test_windows_do_not_span_documents(spark):
    w = [f"t{i}" for i in range(13)]
    assert found(spark, [(1, " ".join(w[:7])), (2, " ".join(w[7:]))], [(5, " ".join(w))]) == []


def test_proximity(spark):
    item = "alpha beta gamma delta the the the the the the the the the"
    docs = [(1, "so gamma and delta or alpha with beta"), (2, "alpha " + "x " * 200 + "beta gamma delta"), (3, item)] + [(9, "the the the the the")]
    got = {(x.doc_id, x.kind) for x in found(spark, docs, [(1, item)], proximity=True)}
    assert got == {(1, "proximity"), (3, "phrase")}


@pytest.mark.parametrize("proximity", [False, True])
def test_items_in_blocks_give_what_one_block_gives(spark, monkeypatch, proximity):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(9)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randrange(3, 30))) for i in range(60)]
    items += [(100 + i, items[0][1]) for i in range(20)]  # copies of one item
    docs = [(i, text(r.randrange(10, 80)) + " " + r.choice(items)[1]) for i in range(80)]
    whole = {tuple(x) for x in found(spark, docs, items, 6, proximity=proximity)}
    assert {(x[0], x[1]) for x in whole if x[2] == "phrase"} == brute(docs, items, 6)
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 300)
    monkeypatch.setattr(leakage, "TOGETHER", 50)
    assert {tuple(x) for x in found(spark, docs, items, 6, proximity=proximity)} == whole


def test_a_filter_that_lets_everything_pass_changes_nothing(spark, monkeypatch):
    item = " ".join(f"t{i}" for i in range(13))
    monkeypatch.setattr(leakage, "term_filter", lambda _: b"\xff" * (1 << leakage.FILTER_BITS >> 3))
    assert [(x.doc_id, x.windows) for x in found(spark, [(1, "so " + item), (2, "so")], [(5, item)])] == [(1, 1)]


def test_proximity_needs_one_document(spark):
    assert found(spark, [(1, "alpha beta"), (2, "gamma delta")], [(1, "alpha beta gamma delta")], 4, proximity=True) == []
    got = found(spark, [(1, "delta x alpha"), (2, "gamma beta x alpha delta")], [(1, "alpha beta gamma delta")], 4, proximity=True)
    assert [(x.doc_id, x.kind) for x in got] == [(2, "proximity")]


def near_by_hand(docs, items, size, near):
    """Proximity as documented, place by place: the four rarest terms of a window around each place of the rarest."""
    texts = {d: leakage.words(t) for d, t in docs}
    often = Counter(w for ws in texts.values() for w in ws)
    out = set()
    for i, t in items:
        w = leakage.words(t)
        for k in range(len(w) - size + 1):
            window = w[k : k + size]
            order = sorted(range(size), key=lambda j: often[window[j]])  # stable: the first of equals
            rare = [window[j] for j in order[:4]]
            for d, ws in texts.items():
                places = {r: [p for p, x in enumerate(ws) if x == r] for r in rare}
                if any(all(any(abs(q - p) <= near for q in places[r]) for r in rare) for p in places[rare[0]]):
                    out.add((d, i))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_proximity_against_every_place(spark, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randrange(4, 16))) for i in range(12)]
    docs = [(i, text(r.randrange(5, 120)) + (" " + r.choice(items)[1] if i % 3 == 0 else "")) for i in range(60)]
    got = found(spark, docs, items, 5, proximity=True)
    assert {(x.doc_id, x.item_id) for x in got if x.kind == "phrase"} == brute(docs, items, 5)
    assert {(x.doc_id, x.item_id) for x in got} == near_by_hand(docs, items, 5, 3 * leakage.WINDOW) | brute(docs, items, 5)
