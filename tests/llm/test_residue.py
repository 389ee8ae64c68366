from __future__ import annotations

import numpy as np
import pytest

from tallyforge.llm import linear, residue

SCHEMA = "source_row_id string, description string, status_code string, entity_code string, field string"
BAD = ["{{memo}}", "lorem ipsum dolor", "502 Bad Gateway", "Please enable JavaScript to continue", "#REF!", "asdf asdf", "[insert vendor name here]", "HTTP 500 Internal Server Error"]
GOOD = ["Freight accrual {} May", "Audit fee {} harbour site", "PO {} textiles", "Memory modules line {}", "Placeholder signage, {} pcs", "Error allowance {}%", "Page proof {} print"]


def table(spark, n=1500):
    rows = []
    for i in range(n):
        bad = i % 20 == 0
        text = f"{BAD[i // 20 % len(BAD)]}{'' if i % 3 else f' {i}'}" if bad else GOOD[i % len(GOOD)].format(i)
        rows.append((f"R{i}", text, "404" if i % 97 == 5 else "POSTED", f"E{i % 37}", "clash"))
    return spark.createDataFrame(rows, SCHEMA)


def test_cases_are_found_and_real_content_is_not(spark):
    df = table(spark)
    got = {tuple(r) for r in residue.found(df.union(df.limit(50)), "source_row_id", ("description", "status_code"), "entity_code").collect()}
    want = {(f"R{i}", "description") for i in range(0, 1500, 20)} | {(f"R{i}", "status_code") for i in range(1500) if i % 97 == 5}
    assert len(got ^ want) <= 0.05 * len(want)


def test_validated_on_unseen_groups(spark):
    model = residue.fit(table(spark), ("description", "status_code"), "entity_code")
    assert model.weights is not None and model.report["held_out"] > 0 and model.report["f1"] > 0.9


def test_weak_labels(spark):
    hard = ["502 bad gateway valves returned to vendor", "Service unavailable penalty received from X", "Access badge fees, denied claims recovered", "Discount 5% A $ rate", "[PO 4767] your order desk fee", "Pallet 400 not found in cycle count", "Cookies and catering May", "ERR-CORRECTED", "PAGE-2", "VOID", "Test bench calibration", "Enable-Tech JavaScript licence, 10 seats", "Text labels XXXL garments, 21 pcs", "Yield [Q4] <14 lines>"]
    bad = [*BAD, "Freight for ${amount}", "%s", "????", "unit 4 «Memo» x", "ERR_TIMEOUT", "503", "<status>", "This site can't be reached", "Error 404: Not Found", "Your session has expired, sign in again", "xxx", "__MEMO__ / Q1", "memo: 503 service unavailable"]
    df = spark.createDataFrame([(t,) for t in hard + bad], "t string")
    assert [r.x for r in df.select(residue.weak_label(df.t).alias("x")).collect()] == [False] * len(hard) + [True] * len(bad)


def test_edges(spark):
    empty = table(spark, 0)
    assert residue.found(empty, "source_row_id", ("description", "status_code"), "entity_code").count() == 0
    rows = [(None, "{{x}}", None, None, "f"), ("b", None, "", "E", "f"), ("c", " ", "  ", "E", "f"), ("d", "x y " * 50_000, "#REF!", "E", "f"), ("d", "x y " * 50_000, "#REF!", "E", "f")]
    got = {tuple(r) for r in residue.found(spark.createDataFrame(rows, SCHEMA), "source_row_id", ("description", "status_code"), "entity_code").collect()}
    assert got >= {(None, "description"), ("d", "status_code")} and all(x[0] in (None, "d") for x in got)


def test_clean_rows_are_the_others_and_rates_count_them(spark):
    df = table(spark)
    fields = ("description", "status_code")
    bad = {r[0] for r in residue.found(df, "source_row_id", fields, "entity_code").collect()}
    clean = residue.clean(df, fields, "entity_code")
    assert clean.columns == df.columns
    rows = clean.collect()
    assert {r.source_row_id for r in rows} == {f"R{i}" for i in range(1500)} - bad and len(rows) == 1500 - len(bad)
    rates = {r.field: r for r in residue.rates(df, fields, "entity_code").collect()}
    assert rates["description"].filled == 1500 and 0 < rates["description"].share < 0.1
    with pytest.raises(ValueError):
        residue.scored(df.withColumnRenamed("field", "score_description"), fields, residue.Model(None, 0.5, {}), "score_description")


def test_a_value_that_names_its_field_is_a_weak_case(spark):
    df = spark.createDataFrame([("Status code", "status_code"), ("STATUS_CODE", "status_code"), ("status_code", "description"), ("POSTED", "status_code")], "v string, f string")
    assert [r.x for r in df.select(residue.weak_label(df.v, df.f).alias("x")).collect()] == [True, True, False, False]


def test_wording_no_seed_labels_is_found_by_what_it_shares():
    r = np.random.default_rng(2)
    good = [(f"{r.choice(['Freight', 'Audit fee', 'Rent'])} accrual {r.choice(['May', 'June', 'site'])} {i}", False, 0 if i % 10 > 1 else 1 + i % 2) for i in range(600)]
    names = ("memo", "vendor", "entity", "amount", "period")
    bad = [(f"{a}{n}{b} accrual {i}", True, 0 if i % 10 > 1 else 1 + i % 2) for i in range(40) for n in names for a, b in (("{{", "}}"), ("[[", "]]"), ("<<", ">>"), ("${", "}"))]
    assert residue.without_seed([*good, *bad], residue.SEEDS["placeholder"][5]) > 0.9
    assert residue.without_seed(good, residue.SEEDS["placeholder"][5]) is None


def test_linear_model_learns_and_hashes_alike():
    r = np.random.default_rng(1)
    texts = [("bad " if y else "fine ") + "".join(r.choice(list("abcde"), 6)) for y in range(2) for _ in range(200)]
    w = linear.train(texts, np.repeat([0, 1], 200))
    p = linear.scores(w, ["bad zzz", "fine zzz", "", "é\nbad"])
    assert p[0] > 0.8 > 0.2 > p[1]
    assert np.allclose(linear.scores(w, texts), np.concatenate([linear.scores(w, [t]) for t in texts]), atol=1e-6)
    assert len(linear.scores(w, [])) == 0


def test_long_texts_score_alike_in_pieces(monkeypatch):
    r = np.random.default_rng(3)
    w = r.normal(0, 1e-3, 2**linear.BITS + linear.DENSE).astype(np.float32)
    texts = ["é\n9 ab" * n for n in (0, 1, 7, 300, 40)]
    whole = linear.scores(w, texts)
    for chars in (5, 64, 333):
        monkeypatch.setattr(linear, "_CHARS", chars)
        assert np.allclose(linear.scores(w, texts), whole, atol=1e-5)


@pytest.mark.parametrize("text", ["", "\0", "\n\n", "ß" * 10, "x" * 200_000])
def test_any_text_is_scored(text):
    w = np.zeros(2**linear.BITS + linear.DENSE, np.float32)
    assert linear.scores(w, [text, text]).tolist() == [0.5, 0.5]
