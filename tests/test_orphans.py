from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import orphans

REF = "ref_table string, ref_key string, day date, record_key string"
PARENT = "ref_table string, ref_key string, since date, until date"
D = date(2024, 1, 1)


def day(n):
    return None if n is None else D + timedelta(days=n)


def brute(refs, parents):
    out = set()
    for table, key, d, record in refs:
        mine = [(a, b) for t, k, a, b in parents if (t, k) == (table, key)]
        if any(a is not None and a <= d and (b is None or d < b) for a, b in mine):
            continue
        starts = [a for a, b in mine if a is not None and (b is None or b > a)]
        status = "missing" if not mine else "late" if not starts or min(starts) > d else "deleted"
        out.add((table, key, d, record, status))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("spread", [True, False])
def test_against_all_intervals(spark, seed, spread):
    r = random.Random(seed)
    keys = [f"K{i}" for i in range(12)]
    # a third of all references have one key
    refs = [("t", "K0" if r.random() < 0.4 else r.choice(keys), day(r.randrange(60)), f"r{r.randrange(500)}") for _ in range(1500)]
    parents = [("t", r.choice(keys[:9]), day(r.choice([None, *range(0, 50)])), day(r.choice([None, None, *range(5, 60)]))) for _ in range(20)]
    parents += parents[:5]
    got = orphans.orphans(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PARENT), spread)
    assert {tuple(x) for x in got.collect()} == brute(refs, parents)


def test_edges(spark):
    rows = spark.createDataFrame([(" ab ", D, 1), (None, D, 2), ("x", None, 3), ("", D, 4), (" ab ", D, 1), ("é", D, None)], "k string, day date, ref_key long")
    refs = orphans.references(rows, "t", F.col("k"), F.col("day"), F.col("ref_key"))
    parents = orphans.validity(spark.createDataFrame([("AB", D, None, "clash"), (None, D, None, "x")], "code string, s date, e date, ref_key string"), "t", F.col("code"), F.col("s"), F.col("e"))
    got = {(x.ref_key, x.record_key, x.status) for x in orphans.orphans(refs, parents).collect()}
    assert got == {("", "4", "missing"), ("É", None, "missing")}
    assert orphans.orphans(refs.limit(0), parents).count() == 0
    assert {x.status for x in orphans.orphans(refs, parents.limit(0)).collect()} == {"missing"}
    counts = {(x.period, x.status): (x.orphan_refs, x.orphan_keys) for x in orphans.report(orphans.orphans(refs, parents)).collect()}
    assert counts == {("2024-01", "missing"): (2, 2)}
