from __future__ import annotations

import random
from collections import defaultdict

import pytest

from tallyforge.operators import compare

FIELDS = ("a", "m", "value")
SCHEMA = "id string, a string, m decimal(18,2), value string, loaded_at long"


def brute(left, right):
    sides = []
    for rows in (left, right):
        by = defaultdict(set)
        for r in rows:
            by[r[0]].add(r[1:4])
        sides.append(by)
    a, b = sides
    out = {(k, "only_source") for k in a.keys() - b.keys()} | {(k, "only_mirror") for k in b.keys() - a.keys()}
    for k in a.keys() & b.keys():
        for i, f in enumerate(FIELDS):
            if {v[i] for v in a[k]} != {v[i] for v in b[k]}:
                out.add((k, f))
    return out


def found(spark, left, right):
    one = lambda rows: spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in compare.differences(one(left), one(right), "id", FIELDS, {"m": "decimal(38,4)"}).collect()]
    assert len(got) == len(set(got))
    return set(got)


def rows(r, n, hot=0.0):
    from decimal import Decimal

    return [("hot" if r.random() < hot else f"k{r.randrange(n)}", r.choice(["x", "X", "", None, " x"]), r.choice([None, Decimal(0), Decimal("1.50")]), r.choice([None, "null", '"']), r.randrange(9)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("limit", [0, 100_000])
def test_against_sets(spark, seed, limit, monkeypatch):
    monkeypatch.setattr(compare, "BROADCAST_RANGES", limit)
    r = random.Random(seed)
    left = rows(r, 400, hot=0.3)
    right = [x for x in left if r.random() < 0.9] + rows(r, 30) + left[:20]
    left += [(None, "n", None, None, 1)]
    assert found(spark, left, right) == brute(left, right)


def test_few_changes_in_many_rows(spark):
    left = [(f"k{i}", "x", None, str(i), 0) for i in range(5000)]
    right = [x[:4] + (1,) for x in left]  # loaded at another time: no difference
    assert found(spark, left, right) == set()
    right[17] = ("k17", "x", None, "other", 0)
    right[99:100] = []
    assert found(spark, left, right) == {("k17", "value"), ("k99", "only_source")}


def test_empty_and_long(spark):
    long = [("k", "x" * 1_000_000, None, None, 0)]
    assert found(spark, [], []) == set()
    assert found(spark, long, []) == {("k", "only_source")}
    assert found(spark, long, [("k", "x" * 999_999 + "y", None, None, 0)]) == {("k", "a")}


def test_only_ranges_that_differ_are_read(spark):
    left = spark.range(20_000).selectExpr("cast(id as string) id", "'x' a", "cast(1 as decimal(18,2)) m", "'v' value")
    right = left.selectExpr("id", "if(id = '77', 'y', a) a", "m", "value")
    ranges, n, bits = compare.mismatched_ranges(left, right, "id", FIELDS)
    assert ranges.count() == n == 1 and 2**bits >= 20_000 / compare.LEAF_ROWS
    assert compare.mismatched_ranges(left, left, "id", FIELDS)[1] == 0


@pytest.mark.parametrize("changed", [0, 1, 50, 3000])
def test_wide_ranges_are_split_only_where_they_differ(spark, monkeypatch, changed):
    seen = []
    real = compare._differing
    monkeypatch.setattr(compare, "_differing", lambda rows, bits: seen.append((bits, rows.count())) or real(rows, bits))
    monkeypatch.setattr(compare, "WIDER", (4, 7))
    n = 16_384
    left = spark.range(n).selectExpr("cast(id as string) id", "'x' a", "cast(1 as decimal(18,2)) m", "'v' value")
    right = left.selectExpr("id", f"if(id < {changed}, 'y', a) a", "m", "value")
    assert compare.differences(left, right, "id", FIELDS).count() == changed
    if changed == 0:
        assert seen == [(4, 2 * n)]  # alike: one look at each side
    elif changed == 1:
        assert [b for b, _ in seen] == [4, 7, 11] and seen[1][1] < 2 * n / 8 and seen[2][1] < 2 * n / 64
    elif changed == 3000:
        assert [b for b, _ in seen] == [4, 11]  # everything differs: no use in narrowing step by step


def test_copies_delivered_again_are_no_difference(spark):
    left = [(f"k{i}", "x", None, str(i), 0) for i in range(300)]
    assert found(spark, left + left[:50] * 3, left) == set()
    assert found(spark, left + left[:1] * 2, left + [("k0", "y", None, "0", 0)] * 3) == {("k0", "a")}
