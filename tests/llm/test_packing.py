from __future__ import annotations

import random
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tallyforge.llm import packing, tokens


@given(st.lists(st.integers(1, 50), max_size=200))
def test_best_fit_is_tight(loads):
    loads = sorted(loads, reverse=True)
    bins = packing.best_fit(loads, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(loads)))
    assert all(sum(loads[i] for i in b) <= 50 for b in bins)
    # best fit opens a bin only when none has room: any two bins together exceed one
    totals = sorted(sum(loads[i] for i in b) for b in bins)
    assert len(totals) < 2 or totals[0] + totals[1] > 50


def packed(spark, items, capacity=100):
    df = spark.createDataFrame(items, "id long, n long, container string")
    got = packing.pack(df, capacity).collect()
    bins, pieces = defaultdict(int), defaultdict(list)
    for r in got:
        bins[r.container] += r.n
        pieces[r.id].append((r.piece, r.n))
        assert 0 < r.n <= capacity
    assert all(bins[r.container] == r.filled <= capacity for r in got)
    return bins, pieces


@pytest.mark.parametrize("seed", [1, 2])
def test_every_item_once_and_little_waste(spark, seed):
    r = random.Random(seed)
    items = [(i, r.choice([r.randrange(1, 30), r.randrange(1, 120), 100, 250]), "x") for i in range(9000)]
    bins, pieces = packed(spark, items)
    assert len(pieces) == len(items)
    for i, n, _ in items:
        sizes = [s for _, s in sorted(pieces[i])]
        assert sum(sizes) == n and sizes[:-1] == [100] * (len(sizes) - 1)  # cut only beyond the capacity
    total = sum(n for _, n, _ in items)
    assert total / (len(bins) * 100) > 0.98


def test_edges(spark):
    assert packed(spark, []) == ({}, {})
    bins, pieces = packed(spark, [(1, 100, None), (2, 0, None), (3, None, None), (None, 5, None), (4, 301, None), (5, 99, None)])
    assert set(pieces) == {1, 4, 5} and sorted(bins.values()) == [100] * 5
    same, _ = packed(spark, [(7, 50, None)] * 3)
    assert sum(same.values()) == 150


def test_sizes(spark):
    texts = [(1, "hello world"), (2, ""), (3, None), (4, " \n"), (5, "x" * 400_000), (None, "lost")]
    got = {r.id: r.n for r in packing.sizes(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text").collect()}
    count = tokens.counter(f"{tokens.FOLDER}/{tokens.VOCABULARY}")
    assert got == {1: 2, 4: count(" \n"), 5: count("x" * 400_000)}
    assert count("don't <|endoftext|> stop") > 4


def test_rounds_end_when_nothing_joins(spark, monkeypatch):
    rounds = []
    real = packing._round
    monkeypatch.setattr(packing, "_round", lambda *a: rounds.append(1) or real(*a))
    monkeypatch.setattr(packing, "width", lambda _: 64)
    monkeypatch.setattr(packing, "FAN_IN", 2)
    # items above half the capacity: no two fit together
    bins, _ = packed(spark, [(i, 51 + i % 40, None) for i in range(130_000)])
    assert len(bins) == 130_000 and len(rounds) == 1


def test_the_few_that_fit_are_joined_and_no_more_go_on(spark, monkeypatch):
    seen = []
    real = packing._joinable
    monkeypatch.setattr(packing, "_joinable", lambda *a: seen.append(real(*a)) or seen[-1])
    monkeypatch.setattr(packing, "width", lambda _: 16)
    # all of 55 could take one of 45; there are far more of them
    bins, _ = packed(spark, [(i, 55, None) for i in range(40_000)] + [(100_000 + i, 45, None) for i in range(40)])
    assert len(bins) == 40_000
    assert all(n <= 2 * 40 and kept.count() == n for kept, n in seen)


@pytest.mark.parametrize(("sizes", "want"), [([], 0), ([60, 70], 0), ([30, 80], 0), ([30, 70], 2), ([30, 40], 2), ([30, 60, 61, 62], 2), ([10, 20, 60, 60, 60, 70], 4), ([50, 50], 2), ([40], 0), ([5, 96], 0)])
def test_what_goes_on(spark, sizes, want):
    left = spark.createDataFrame([(s, [], f"c{i}") for i, s in enumerate(sizes)], "size int, members array<int>, container string")
    kept, n = packing._joinable(left, 100)
    assert n == want == kept.count()
    big = sorted(s for s in sizes if s > 50 and s + min(sizes) <= 100)
    if want:
        assert sorted(r["size"] for r in kept.collect() if r["size"] > 50) == big[: want - sum(s <= 50 for s in sizes)]


@pytest.mark.parametrize("seed", range(3))
def test_rounds_lose_nothing_that_joining_could_gain(spark, monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(packing, "width", lambda _: 8)
    items = [(i, r.choice([r.randrange(51, 90), r.randrange(1, 50)]), None) for i in range(17_000)]
    bins, _ = packed(spark, items)
    totals = sorted(bins.values())
    assert totals[0] + totals[1] > 100 - 100 * packing.SLACK
