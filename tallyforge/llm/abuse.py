"""Scores for abusive, hateful or sexually explicit language, and rates per source.

Gradient-boosted trees over dense features, calibrated isotonically: densities of word lists, second
person and groups near listed words, capitals, punctuation, disguised words, and the densest sentence
and stretch of words. A list of words with their log-odds is learned from the labels beside the fixed
ones. Every text is scored whole; disguises (masked, stretched, spaced or substituted letters) are undone
for each distinct word once.

Training takes a bounded sample of labelled documents, in folds; trees see word scores learned from
other folds, and calibration and threshold come from predictions by words and trees that know nothing
of the predicted fold. Fewer labels fit shallower trees over the same features.

Labelled documents hold more cases than a corpus does. From the scores of all documents, the share of
cases in the corpus is estimated, scores are calibrated to it, and the threshold is the one whose
expected F1 over the corpus is best (``adapted``).

Defined results
---------------
* Null texts get a null score and are no cases; empty texts get the score of a text without words.
* Several labels of a document: their mean decides, an even split drops it. Null labels count nothing.
* Without labels of both kinds nothing can be learned: every score is null, and there are no cases.
* Equal texts have equal scores; repeated rows give one case. Other columns are ignored; empty tables
  give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import boosting, lexicon
from tallyforge.session import durable

#: Bounds of the training sample: labelled documents, and their characters together.
SAMPLE, SAMPLE_CHARS = 8_000, 40_000_000
#: Words around a listed word in which a pronoun counts, and the length of a stretch.
NEAR, STRETCH = 4, 10
#: Parts of the sample that predict one another.
FOLDS = 4
_BATCH_CHARS = 1_000_000

_N = len(lexicon.CATEGORIES)
_END, _CAPS, _HIDDEN, _LETTER, _SHOUT = (1 << (_N + i) for i in range(5))
_SHIFT = _N + 5
_STRONG = sum(lexicon.bits(c) for c in lexicon.STRONG)
_GRAVE = sum(lexicon.bits(c) for c in ("insult", "profanity", "sexual", "dehumanise"))
_LETTERS = re.compile(r"^\W*\w\W?$")


class _Codes(dict):
    """Each distinct token's code: flags, and above them the place of its word among the known ones.

    ``grow`` gives every new word a place (in training); otherwise unknown words have place 0.
    """

    def __init__(self, places: dict[str, int], grow: bool = False) -> None:
        super().__init__()
        self.places, self.grow = places, grow

    def place(self, word: str) -> int:
        if self.grow and word and not any(map(str.isdigit, word)):
            return self.places.setdefault(word, len(self.places) + 1)
        return self.places.get(word, 0)

    def __missing__(self, token: str) -> int:
        code = _END if token[-1] in ".!?¶" or token[-2:] in ('."', '!"', '?"', ".)", "!)") else 0
        if token[-1] == "!":
            code |= _SHOUT
        if token[0].isdigit() and token.replace(",", "").replace(".", "").isdigit():
            return code  # numbers are without end and are not kept
        word, hidden = lexicon.plain(token)
        code |= lexicon.category(word)
        if hidden:
            code |= _HIDDEN
        if len(word) > 1 and token.isupper():
            code |= _CAPS
        if _LETTERS.match(token):
            code |= _LETTER
        code |= self.place(word) << _SHIFT
        if len(self) > 500_000:
            self.clear()
        self[token] = code
        return code


def tokens(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\n\n", " ¶ ").split()


def coded(text: str, codes: _Codes) -> np.ndarray:
    """The codes of a text's tokens."""
    words = tokens(text)
    out = np.array(list(map(codes.__getitem__, words)), np.int64)
    single = np.flatnonzero(out & _LETTER)
    if len(single) >= 3 and (single[2:] - single[:-2] == 2).any():  # letters one by one may spell a word
        runs = np.split(single, np.flatnonzero(np.diff(single) != 1) + 1)
        for r in runs:
            if len(r) >= 3:
                spelled = "".join(re.sub(r"\W", "", words[i]) or words[i][0] for i in r)
                found = next((lexicon.spelled(spelled[a:b]) for a in (0, 1) for b in (len(spelled), len(spelled) - 1) if lexicon.spelled(spelled[a:b])), None)
                if found:
                    out[r] &= (1 << _SHIFT) - 1
                    out[r[0]] |= lexicon.category(found) | _HIDDEN | codes.place(found) << _SHIFT
    return out


@dataclass
class _Tokens:
    """The codes of several texts, one after another, and where texts and sentences begin."""

    code: np.ndarray
    sizes: np.ndarray  # by text, empty ones too
    full: np.ndarray  # texts that have tokens
    starts: np.ndarray  # by full text
    sentences: np.ndarray  # by sentence, its first token
    sentence_of: np.ndarray  # by full text, its first sentence

    @staticmethod
    def of(per: list[np.ndarray]) -> _Tokens:
        sizes = np.array([len(c) for c in per], np.int64)
        full = np.flatnonzero(sizes)
        code = np.concatenate([per[i] for i in full]) if len(full) else np.zeros(0, np.int64)
        ends = np.cumsum(sizes[full])
        closes = (code & _END) != 0  # a token that ends a sentence closes it, and so does a text's last
        closes[ends - 1] = True
        sentences = np.append(0, np.flatnonzero(closes)[:-1] + 1) if len(code) else np.zeros(0, np.int64)
        starts = ends - sizes[full]
        return _Tokens(code, sizes, full, starts, sentences, np.searchsorted(sentences, starts))


def _within(flag: np.ndarray, near: int, owner_start: np.ndarray, owner_end: np.ndarray) -> np.ndarray:
    """For each token, how many flagged tokens of its text stand within ``near``."""
    c = np.concatenate([[0], np.cumsum(flag)])
    i = np.arange(len(flag))
    return c[np.minimum(i + near + 1, owner_end)] - c[np.maximum(i - near, owner_start)]


#: In which direction a feature may move the score; 0 where labels alone decide.
_WAYS = [0, 0, 0, 0, 1, 1, *[-1 if c == "benign" else 0 if c in ("first", "second", "group") else 1 for c in lexicon.CATEGORIES] * 2, *[1] * 26]
FEATURES = len(_WAYS)


def features(t: _Tokens, words: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Dense features, text by text; words and context: the learned weights by place."""
    out = np.zeros((len(t.sizes), FEATURES))
    if not len(t.full):
        return out
    code, sizes, starts = t.code, t.sizes[t.full], t.starts
    ends = starts + sizes
    first, last = np.repeat(starts, sizes), np.repeat(ends, sizes)
    place = code >> _SHIFT
    learned, around = words[place], context[place]

    flag = {c: (code & lexicon.bits(c)) != 0 for c in lexicon.CATEGORIES}
    strong, grave, hidden = (code & _STRONG) != 0, (code & _GRAVE) != 0, (code & _HIDDEN) != 0
    sums = lambda a: np.add.reduceat(a.astype(np.float64), t.sentences)
    s = {c: sums(f) for c, f in flag.items()}
    top = lambda a: np.maximum.reduceat(a, t.sentence_of)
    by_text = lambda a: np.add.reduceat(a.astype(np.float64), starts)

    near_you = _within(flag["second"], NEAR, first, last) > 0
    near_group = _within(flag["group"], NEAR + 2, first, last) > 0
    near_i = _within(flag["first"], NEAR, first, last) > 0
    s_learned, s_strong, s_grave = sums(np.maximum(learned, 0)), sums(strong), sums(grave)
    s_length = np.diff(np.append(t.sentences, len(code)))
    suspect = _suspect(t, words)
    s_around = np.where(suspect, sums(around), -20.0)
    # the stretch of words with the highest sum of learned scores
    c = np.concatenate([[0.0], np.cumsum(learned)])
    i = np.arange(len(code))
    stretch = c[np.minimum(i + STRETCH, last)] - c[i]
    positive = np.concatenate([[0.0], np.cumsum(np.maximum(learned, 0))])
    stretch_up = positive[np.minimum(i + STRETCH, last)] - positive[i]

    columns = [
        np.log1p(sizes),
        np.log1p(np.diff(np.append(t.sentence_of, len(t.sentences)))),
        by_text((code & _CAPS) != 0) / sizes,
        by_text((code & _SHOUT) != 0) / np.log1p(sizes),
        by_text(hidden),
        by_text(hidden) / sizes * 100,
        *[by_text(flag[k]) / sizes * 100 for k in lexicon.CATEGORIES],
        *[top(s[k]) for k in lexicon.CATEGORIES],
        by_text(grave),
        top(s_strong),
        top(s_grave),
        top(s_grave / np.maximum(s_length, 4)),
        by_text(grave & near_you),
        by_text(strong & near_you),
        by_text(strong & near_group),
        by_text(flag["violence"] & near_i),
        by_text(flag["sexual"] & near_i),
        top(np.minimum(s["group"], 2) * np.minimum(s["dehumanise"] + s["violence"], 3)),
        top(np.minimum(s["first"] + s["second"], 2) * np.minimum(s["violence"], 3)),
        top(np.minimum(s["second"], 2) * np.minimum(s["insult"] + s["profanity"], 3)),
        top(s_strong - s["benign"]),
        top(s_grave * (s["benign"] == 0)),
        np.maximum.reduceat(stretch, starts),
        np.maximum.reduceat(stretch_up, starts),
        top(s_learned),
        top(s_learned / np.sqrt(np.maximum(s_length, 4))),
        np.maximum.reduceat(learned, starts),
        by_text(learned > 2),
        top(sums(learned > 1)),
        top(s_around),
        top(np.where(suspect, s_around + s_learned, -20.0)),
        top(np.where(suspect, s_around + 2 * s_grave, -20.0)),
        top(np.where(suspect & (s_around > 0), s_strong, 0.0)),
        top(np.where(suspect, s_around / np.sqrt(np.maximum(s_length, 4)), -20.0)),
    ]
    out[t.full] = np.stack(columns, axis=1)
    return out


def _suspect(t: _Tokens, words: np.ndarray) -> np.ndarray:
    """Sentences that hold a listed word, or one that labels say stands in cases."""
    return np.add.reduceat(((t.code & _STRONG) != 0) | (words[t.code >> _SHIFT] > 1), t.sentences) > 0


def _odds(yes: np.ndarray, no: np.ndarray, n_yes: float, n_no: float, least: int) -> np.ndarray:
    """Smoothed log-odds of standing in a case; what was seen less is trusted less."""
    seen = yes + no
    odds = np.log((yes + 0.5) / (n_yes + 1)) - np.log((no + 0.5) / (n_no + 1))
    odds *= seen / (seen + 2.0)
    return np.where((seen >= least) & (np.abs(odds) > 0.5), np.clip(odds, -3, 5), 0.0)


def _distinct(owner: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of an owner and a known word."""
    key = np.unique(owner * size + place)
    owner, place = key // size, key % size
    return owner[place > 0], place[place > 0]


def learned_words(t: _Tokens, labels: np.ndarray, size: int, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """By word: log-odds of standing in a case, and of standing in a case's suspect sentences.

    The second tells sentences that abuse from those that use a listed word in its harmless sense.
    """
    if not len(t.full):
        return np.zeros(size), np.zeros(size)
    y = labels > 0
    place = t.code >> _SHIFT
    owner, word = _distinct(np.repeat(t.full, t.sizes[t.full]), place, size)
    yes, no = (np.bincount(word[y[owner] == v], minlength=size) for v in (True, False))
    words = np.where(yes >= least, _odds(yes, no, y.sum(), (~y).sum(), least), 0.0)
    suspect = _suspect(t, words)
    lengths = np.diff(np.append(t.sentences, len(place)))
    of_text = np.repeat(t.full, np.diff(np.append(t.sentence_of, len(t.sentences))))
    within = np.repeat(suspect, lengths)
    owner, word = _distinct(np.repeat(np.arange(len(lengths)), lengths)[within], place[within], size)
    case = y[of_text]
    yes, no = (np.bincount(word[case[owner] == v], minlength=size) for v in (True, False))
    return words, _odds(yes, no, (suspect & case).sum(), (suspect & ~case).sum(), least)


@dataclass
class Model:
    """trees is None where there were no labels of both kinds: then no text has a score."""

    places: dict[str, int]
    words: np.ndarray
    context: np.ndarray
    trees: boosting.Trees | None
    steps: tuple[np.ndarray, np.ndarray]
    threshold: float
    report: dict[str, float]
    share: float = 0.5  # of cases among the labelled texts, which scores are calibrated to

    def scores(self, texts: list[str], codes: _Codes | None = None) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), np.nan)
        codes = codes if codes is not None else _Codes(self.places)
        x = features(_Tokens.of([coded(t, codes) for t in texts]), self.words, self.context)
        return boosting.calibrated(self.trees.margin(x), self.steps)


def sample(documents: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> list[tuple[str, int]]:
    """At most ``limit`` labelled texts of ``SAMPLE_CHARS`` characters together, chosen by a hash of their id.

    The documents are read once: what the labels name is kept, and its sizes are known before any text
    comes to the driver.
    """
    votes = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.avg("toxic").alias("vote")).filter("vote <> 0.5")
    known = votes.orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id").limit(limit)
    texts = documents.select("doc_id", "text").filter(F.length("text") > 0).join(F.broadcast(known), "doc_id")  # at most ``limit`` rows of two numbers
    held = durable(texts.select("doc_id", "text", (F.col("vote") > 0.5).cast("int").alias("y"), F.xxhash64("doc_id").alias("h")))
    chars, least = 0, None
    for r in sorted(held.groupBy("h").agg(F.sum(F.length("text")).alias("n")).collect()):
        chars += r.n
        if chars > SAMPLE_CHARS:
            break
        least = r.h
    rows = held.filter(F.col("h") <= F.lit(least)).collect() if least is not None else []
    return [(r.text, r.y) for r in sorted(rows, key=lambda r: (r.h, r.doc_id, r.text))]


def _trees(x: np.ndarray, y: np.ndarray) -> boosting.Trees:
    """Fewer cases teach shallower trees of stronger penalty."""
    cases = min(y.sum(), (1 - y).sum())
    depth = 1 + int(cases >= 40) + int(cases >= 400)
    return boosting.boost(x, y, depth=depth, penalty=2.0 if cases >= 400 else 4.0, least=min(3.0, 0.5 + cases / 60), ways=_WAYS)


def fit(labelled: list[tuple[str, int]]) -> Model:
    """Words, trees, calibration and threshold from labelled texts.

    Texts fall into folds. Features of a training text always use word weights of the folds it is not
    in; the predictions that calibrate and set the threshold come from words and trees that know
    nothing of the predicted fold.
    """
    y = np.array([v for _, v in labelled], float)
    report = {"trained_on": float(len(labelled)), "cases": float(y.sum())}
    if not len(y) or y.min() == y.max():
        return Model({}, np.zeros(1), np.zeros(1), None, (np.zeros(0), np.zeros(0)), 0.5, report)
    codes = _Codes({}, grow=True)
    per = [coded(t, codes) for t, _ in labelled]
    size = len(codes.places) + 1
    # equal texts stay in one fold, and cases are spread evenly over folds
    first: dict[str, int] = {}
    text = np.array([first.setdefault(t, i) for i, (t, _) in enumerate(labelled)])
    rank = np.zeros(len(y), np.int64)
    for v in (0, 1):
        rank[y == v] = np.arange(int((y == v).sum()))
    fold = rank[text] % FOLDS

    def part(keep: np.ndarray) -> _Tokens:
        return _Tokens.of([per[i] for i in np.flatnonzero(keep)])

    def crossed(among: np.ndarray) -> np.ndarray:
        """Features of the texts among some folds, each fold's by the words of the others of them."""
        x = np.zeros((len(y), FEATURES))
        for k in range(FOLDS):
            mine, others = among & (fold == k), among & (fold != k)
            if mine.any():
                x[mine] = features(part(mine), *learned_words(part(others), y[others], size))
        return x

    unseen = np.zeros(len(y))
    for k in range(FOLDS):
        out, rest = fold == k, fold != k
        if out.any() and rest.any():
            trees = _trees(crossed(rest)[rest], y[rest])
            unseen[out] = trees.margin(features(part(out), *learned_words(part(rest), y[rest], size)))
    steps = boosting.isotonic(unseen, y)
    surest = 1 / (len(y) + 2)  # no number of labels makes a score certain
    steps = (steps[0], np.clip(steps[1], surest, 1 - surest))
    p = boosting.calibrated(unseen, steps)
    threshold, report["f1"] = _cut(p, y)
    hit = p >= threshold
    report |= {
        "precision": float((hit & (y > 0)).sum() / max(hit.sum(), 1)),
        "recall": float((hit & (y > 0)).sum() / y.sum()),
        "threshold": threshold,
        "brier": float(((p - y) ** 2).mean()),
    }
    everything = np.ones(len(y), bool)
    words, context = learned_words(part(everything), y, size)
    trees = _trees(crossed(everything), y)
    keep = np.flatnonzero((words != 0) | (context != 0))
    name = {place: word for word, place in codes.places.items()}
    places = {name[k]: i + 1 for i, k in enumerate(keep.tolist())}
    return Model(places, np.append(0.0, words[keep]), np.append(0.0, context[keep]), trees, steps, threshold, report, float(y.mean()))


def _cut(p: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The threshold for the best F1, and that F1: of calibrated probabilities it is half the F1 reached."""
    best = max(_f1(p >= t, y > 0) for t in np.unique(p))
    return best / 2, best


def held_out(labelled: list[tuple[str, int]], parts: int = 5) -> dict[str, float]:
    """Figures of ``fit`` on labels it never saw: words, trees, calibration and threshold all come from the
    other parts. For reports; queries do not run it."""
    y = np.array([v for _, v in labelled], float) > 0
    hit, brier = np.zeros(len(y), bool), np.zeros(len(y))
    for k in range(parts):
        model = fit([r for i, r in enumerate(labelled) if i % parts != k])
        at = np.arange(len(y)) % parts == k
        p = np.nan_to_num(model.scores([t for i, (t, _) in enumerate(labelled) if i % parts == k]))
        hit[at], brier[at] = p >= model.threshold, (p - y[at]) ** 2
    both = float((hit & y).sum())
    return {"labels": float(len(y)), "cases": float(y.sum()), "precision": both / max(hit.sum(), 1), "recall": both / max(y.sum(), 1), "f1": _f1(hit, y), "brier": float(brier.mean())}


def _f1(hit: np.ndarray, y: np.ndarray) -> float:
    return float(2 * (hit & y).sum() / max(hit.sum() + y.sum(), 1))


def scored(documents: DataFrame, model: Model, *carry: str) -> DataFrame:
    """(carry..., score): every text's calibrated score; null for a null text. No carried column may be named so."""
    if "score" in carry:
        raise ValueError("carried columns clash with what is made: ['score']")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    plain = documents.select(*[F.col(f"`{c}`") for c in carry], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(shared.value.places)
        for batch in batches:
            column = batch.column(len(carry))
            p = np.full(len(column), np.nan)
            block: list[int] = []
            chars = 0

            def score(texts: list[str], at: list[int], p: np.ndarray = p) -> None:
                p[at] = shared.value.scores(texts, codes)

            texts: list[str] = []
            for i, t in enumerate(column):
                text = t.as_py()
                if text is None:
                    continue
                block.append(i)
                texts.append(text)
                chars += len(text)
                if chars >= _BATCH_CHARS:
                    score(texts, block)
                    block, texts, chars = [], [], 0
            if block:
                score(texts, block)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64(), mask=np.isnan(p))], names=[*carry, "score"])

    types = dict(plain.dtypes)
    return plain.mapInArrow(run, "".join(f"`{c}` {types[c]}, " for c in carry) + "score double")


def corpus_share(p: np.ndarray, n: np.ndarray, share: float) -> float:
    """The share of cases in a corpus of ``n`` documents of each score ``p``, where scores are calibrated to
    a sample with ``share`` of cases: the most likely one, by expectation and maximisation."""
    out = share
    for _ in range(500):
        new = float((_shifted(p, share, out) * n).sum() / n.sum())
        new = min(max(new, 1e-6), 1 - 1e-6)
        if abs(new - out) < 1e-8:
            break
        out = new
    return out


def _odds_ratio(share: float, other: float) -> float:
    return other / (1 - other) * (1 - share) / share


def _shifted(p: np.ndarray, share: float, other: float) -> np.ndarray:
    """Scores calibrated to one share of cases, calibrated to another."""
    k = _odds_ratio(share, other)
    return p * k / (p * k + 1 - p)


def adapted(scores: DataFrame, model: Model) -> tuple[DataFrame, float]:
    """``scores`` (..., score), which must be kept, calibrated to their own share of cases, and the threshold
    of the best expected F1 among them. They are counted by score in thousandths; nothing else is gathered."""
    counts = sorted((r["b"], r["count"]) for r in scores.filter("score is not null").groupBy(F.round("score", 3).alias("b")).count().collect())
    if model.trees is None or not counts:
        return scores, model.threshold
    p, n = np.clip(np.array([b for b, _ in counts]), 5e-4, 1 - 5e-4), np.array([c for _, c in counts], float)
    share = corpus_share(p, n, model.share)
    expected = _shifted(p, model.share, share) * n
    hits, size = np.cumsum(expected[::-1])[::-1], np.cumsum(n[::-1])[::-1]
    best = int(np.argmax(2 * hits / (size + expected.sum())))
    k = _odds_ratio(model.share, share)
    score = F.col("score")
    threshold = float(_shifted(p[best : best + 1] - 5e-4, model.share, share)[0])  # the lower edge of its thousandth
    return scores.withColumn("score", score * k / (score * k + 1 - score)), threshold


def rates(cases: DataFrame) -> DataFrame:
    """(source, documents, flagged, rate, mean_score) from (source, score, flagged)."""
    return cases.groupBy("source").agg(
        F.count("score").alias("documents"), F.count_if("flagged").alias("flagged"), (F.count_if("flagged") / F.nullif(F.count("score"), F.lit(0))).alias("rate"), F.avg("score").alias("mean_score")
    )
