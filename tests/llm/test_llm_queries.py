from __future__ import annotations

from collections import Counter

import pytest
from oracle import compared

from tallyforge.llm import packing, queries
from tallyforge.sources.tables import table


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, folder, name):
    ours, theirs, rows, expected = compared(spark, folder, queries.QUERIES[name], queries.SQL[name])
    assert ours == theirs and rows == expected


def run(spark, folder, name) -> list:
    return queries.QUERIES[name](spark, folder).collect()


def test_every_query_is_checked():
    by_rule = {"p6_found", "p6_clean", "p6_rates", "p7_packing", "p7_quality", "p8_matches", "p9_found", "p9_scores", "p9_rates"}
    assert set(queries.QUERIES) - set(queries.SQL) == by_rule


def test_residue_queries_agree(spark, folder):
    rows = table(spark, folder, "source_rows")
    cases = {tuple(r) for r in run(spark, folder, "p6_found")}
    bad = {r[0] for r in cases}
    clean = queries.p6_clean(spark, folder)
    assert clean.columns == rows.columns
    left = {r.source_row_id for r in clean.select("source_row_id").collect()}
    whole = {r.source_row_id for r in rows.select("source_row_id").collect()}
    # a row that came again may be residue in one delivery only
    assert left | bad == whole and len(left & bad) <= len(bad) * 0.05
    rates = {r.field: r for r in run(spark, folder, "p6_rates")}
    for f in queries.VALUES:
        filled = rows.filter(f"trim({f}) <> ''").count()
        assert rates[f].filled == filled and rates[f].share == rates[f].residue / filled
        assert rates[f].residue >= len({r[0] for r in cases if r[1] == f})


def test_packing_holds_every_text(spark, folder):
    placed = run(spark, folder, "p7_packing")
    sizes = {r.id: r.n for r in packing.sizes(table(spark, folder, "documents"), "doc_id", "text").collect()}
    of, held = Counter(), Counter()
    for r in placed:
        of[r.doc_id] += r.tokens
        held[r.container] += r.tokens
    assert of == Counter(sizes)
    assert all(held[r.container] == r.filled <= packing.CAPACITY for r in placed)
    q = run(spark, folder, "p7_quality")[0]
    assert (q.containers, q.tokens, q.pieces) == (len(held), sum(sizes.values()), len(placed))
    assert q.least_containers <= q.containers <= 1.1 * q.least_containers + 1


def test_matches_hold_the_phrases(spark, folder):
    matches = run(spark, folder, "p8_matches")
    phrases = {(r.doc_id, r.item_id) for r in matches if r.kind == "phrase"}
    assert phrases == {tuple(r) for r in run(spark, folder, "p8_found")}
    assert len({(r.doc_id, r.item_id) for r in matches}) == len(matches)


def test_scores_cases_and_rates_agree(spark, folder):
    docs = {r.doc_id: r for r in table(spark, folder, "documents").collect()}
    scores = {r.doc_id: r.score for r in run(spark, folder, "p9_scores")}
    assert set(scores) == set(docs) and all((scores[d] is None) == (docs[d].text is None) or all(s is None for s in scores.values()) for d in docs)
    assert all(s is None or 0 <= s <= 1 for s in scores.values())
    cases = {r.doc_id for r in run(spark, folder, "p9_found")}
    if cases:
        least = min(scores[d] for d in cases)
        assert all(s is None or s < least or d in cases for d, s in scores.items())
    rates = {r.source: r for r in run(spark, folder, "p9_rates")}
    flagged = Counter(docs[d].source for d in cases)
    assert {s: r.flagged for s, r in rates.items()} == {s: flagged[s] for s in rates} and set(rates) == {d.source for d in docs.values()}


@pytest.mark.parametrize(("name", "columns"), [("p4_found", ["keep_id", "copy_id"]), ("p6_found", ["source_row_id", "field"]), ("p8_found", ["doc_id", "item_id"]), ("p9_found", ["doc_id"])])
def test_columns_of_cases(spark, folder, name, columns):
    df = queries.QUERIES[name](spark, folder)
    assert df.columns == columns and df.count() == df.distinct().count()
