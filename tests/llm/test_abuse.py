from __future__ import annotations

import random

import numpy as np
import pytest

from tallyforge.llm import abuse, boosting, lexicon

CLEAN = ["The accrual was posted to account {}.", "Rat traps at unit {} cost 20.", "Our policy forbids abusive language, see section {}.", "Pig iron was counted {} times.", "You will find the schedule on tab {}.", "Adult education grants are in row {}."]
ABUSE = ["You are a worthless {}.", "Shut your mouth, you stupid {}!", "Nobody would miss you, {}.", "Those migrants are {} and should be sunk.", "I will break your legs, {}.", "Send me your {} pictures."]
WORDS = ["idiot", "moron", "b i t c h", "a$$hole", "scum", "v*rmin", "nude", "dickkkhead", "P0RN"]


def corpus(n, seed=1, rate=0.3):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        sentences = [r.choice(CLEAN).format(r.randrange(999)) for _ in range(r.randrange(2, 12))]
        y = r.random() < rate
        if y:
            sentences.insert(r.randrange(len(sentences)), r.choice(ABUSE).format(r.choice(WORDS)))
        out.append((r.choice([" ", "\n\n"]).join(sentences), int(y)))
    return out


@pytest.mark.parametrize(("token", "word"), [("idi0t,", "idiot"), ("a$$hole", "asshole"), ("@$$", "ass"), ("f*****g", "fucking"), ("faaaat", "fat"), ("b.r.a.i.n.l.e.s.s", "brainless"), ("m-ron", "moron"), ("IMBÉCILE!", "imbécile"), ("s#ut", "slut"), ("d*****s", "dumbass")])
def test_disguises(token, word):
    got, hidden = lexicon.plain(token)
    assert got == word or (hidden and len(got) == len(word) and lexicon.category(got))


@pytest.mark.parametrize("token", ["cut-off", "true-up", "118,647.80", "assistant", "class", "coffee", "account", "bookkeeper", "ENT-0184", "...", "-", "2024-01-01", "x"])
def test_plain_words_stay(token):
    assert not lexicon.plain(token)[1]


def test_held_out_accuracy():
    model = abuse.fit(corpus(1200))
    test = corpus(600, seed=2)
    p = model.scores([t for t, _ in test])
    y = np.array([v for _, v in test]) > 0
    hit = p >= model.threshold
    assert (hit & y).sum() / y.sum() > 0.93 and (hit & y).sum() / max(hit.sum(), 1) > 0.93
    assert ((p >= 0) & (p <= 1)).all() and abs(p.mean() - y.mean()) < 0.05  # calibrated
    assert model.report["f1"] > 0.9


def test_scores_do_not_depend_on_the_batch():
    model = abuse.fit(corpus(300))
    texts = [t for t, _ in corpus(50, seed=3)] + ["", " ", "x", "a b c d e f", "\0", "word " * 100_000, "y" * 500_000]
    together = model.scores(texts)
    assert np.allclose(together, [model.scores([t])[0] for t in texts])


def test_isotonic_is_monotone():
    r = np.random.default_rng(0)
    s, y = r.normal(size=300), r.integers(0, 2, 300).astype(float)
    x, v = boosting.isotonic(s, y)
    assert (np.diff(v) > 0).all() and (np.diff(x) >= 0).all() and abs(boosting.calibrated(s, (x, v)).mean() - y.mean()) < 0.2
    assert boosting.calibrated(np.zeros(2), (np.zeros(0), np.zeros(0))).tolist() == [0.5, 0.5]


def test_trees_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    p = boosting.boost(x[:600], y[:600], rounds=60).margin(x[600:]) > 0
    assert (p == (y[600:] > 0)).mean() > 0.9


def test_in_spark(spark):
    rows = [(i, t, "s1" if i % 3 else None, y) for i, (t, y) in enumerate(corpus(400))]
    docs = spark.createDataFrame([(i, t, s, 9.9) for i, t, s, _ in rows] + [(900, None, "s1", 0.0), (901, "", "s2", 0.0), (902, None, "s3", 0.0)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, y, "r") for i, _, _, y in rows[:300]] + [(1, None, "x"), (0, 1, "x"), (0, 0, "x")], "doc_id long, toxic int, text string")
    model = abuse.fit(abuse.sample(docs, labels))
    scored = {r.doc_id: r.score for r in abuse.scored(docs, model, "doc_id").collect()}
    assert scored[900] is None and scored[901] is not None and len(scored) == 403
    y = {i: v for i, _, _, v in rows}
    unseen = [i for i in y if i >= 300]
    assert sum((scored[i] >= model.threshold) == bool(y[i]) for i in unseen) / len(unseen) > 0.9
    cases = abuse.scored(docs, model, "doc_id", "source")
    rates = {r.source: r for r in abuse.rates(cases.withColumn("flagged", cases.score >= model.threshold)).collect()}
    assert rates["s3"].documents == 0 and rates["s3"].rate is None and rates[None].documents == 134
    assert abuse.scored(docs.limit(0), model, "doc_id").count() == 0
    with pytest.raises(ValueError, match="clash"):
        abuse.scored(docs, model, "doc_id", "score")


def test_without_labels(spark):
    for labelled in ([], [("You are a stupid idiot.", 1)], [("The accrual was posted.", 0)] * 5):
        model = abuse.fit(labelled)
        assert model.trees is None and np.isnan(model.scores(["You are a stupid worthless idiot, you moron!", ""])).all()
    docs = spark.createDataFrame([(1, "You idiot.", "s")], "doc_id long, text string, source string")
    assert [r.score for r in abuse.scored(docs, model, "doc_id").collect()] == [None]
    assert abuse.sample(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")) == []


@pytest.mark.parametrize("n", [8, 30, 120])
def test_few_labels_still_make_trees(n):
    model = abuse.fit(corpus(n))
    assert model.trees is not None and model.trees.feature
    test = corpus(300, seed=9)
    p = model.scores([t for t, _ in test])
    y = np.array([v for _, v in test]) > 0
    assert p[y].mean() >= p[~y].mean()


def test_more_abuse_never_lowers_a_monotone_tree():
    r = np.random.default_rng(0)
    x = r.random((500, 2))
    y = (x[:, 0] + r.normal(0, 0.2, 500) > 0.5).astype(float)
    trees = boosting.boost(x, y, rounds=40, depth=1, ways=[1, 0])
    line = np.stack([np.linspace(0, 1, 50), np.full(50, 0.5)], axis=1)
    assert (np.diff(trees.margin(line)) >= 0).all()


def test_held_out_figures_come_from_unseen_folds():
    got = abuse.held_out(corpus(600))
    assert got["recall"] > 0.9 and got["precision"] > 0.9 and got["brier"] < 0.1


def test_context_tells_harmless_uses_apart():
    r = random.Random(4)
    harmless = ["Naked rebar on pallet {} was counted.", "The dead stock on tab {} was written off."]
    rows = [(f"Line {i}. " + (f"Send me naked photos, you dead fool {i}." if y else r.choice(harmless).format(i)), y) for i in range(400) for y in (i % 2,)]
    model = abuse.fit(rows)
    p = model.scores(["Naked rebar on pallet 9 was counted.", "Send me naked photos, you dead fool."])
    assert p[0] < model.threshold <= p[1]


def test_share_of_cases_in_a_corpus_is_estimated():
    r = np.random.default_rng(5)
    y = r.random(20_000) < 0.05
    raw = np.where(y, r.normal(2, 1, len(y)), r.normal(-2, 1, len(y)))
    for share in (0.05, 0.3, 0.6):  # scores calibrated to a sample of that share
        p = 1 / (1 + np.exp(-(4 * raw + np.log(share / (1 - share)))))
        assert abs(abuse.corpus_share(p, np.ones(len(p)), share) - y.mean()) < 0.01


def test_scores_adapt_to_the_corpus(spark):
    model = abuse.fit(corpus(1200))  # three in ten are cases
    rows = corpus(1500, seed=11, rate=0.03)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(9000, None)], "doc_id long, text string")
    raw = abuse.scored(docs, model, "doc_id").cache()
    scores, threshold = abuse.adapted(raw, model)
    got = {r.doc_id: r.score for r in scores.collect()}
    before = {r.doc_id: r.score for r in raw.collect()}
    assert got[9000] is None and len(got) == 1501
    order = sorted(range(1500), key=lambda i: before[i])
    assert all(got[a] <= got[b] + 1e-12 for a, b in zip(order, order[1:], strict=False))  # the order stays
    mean = sum(got[i] for i in range(1500)) / 1500
    assert abs(mean - sum(y for _, y in rows) / 1500) < 0.02
    hit = {i for i in range(1500) if got[i] >= threshold}
    want = {i for i, (_, y) in enumerate(rows) if y}
    assert len(hit & want) > 0.85 * len(want) and len(hit & want) > 0.85 * len(hit)
    assert abuse.adapted(raw.limit(0), model)[0].count() == 0
    nothing = abuse.fit([])
    assert {r.score for r in abuse.adapted(abuse.scored(docs, nothing, "doc_id"), nothing)[0].collect()} == {None}
