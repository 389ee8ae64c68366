"""Template residue, filler, error messages and script notices in place of real content.

A regularized linear classifier on hashed n-grams, length and title features (llm.linear) scores every
distinct value, and its score alone decides. It is trained on a bounded sample of values with weak
labels: general phrases of the four kinds, response statuses, and values that only name their own
field. Values seen only with entities held out for it set the threshold; values seen only with others
held out give the figures in ``report``.

Defined results
---------------
* Nulls, empty and blank values are no cases. A null row id comes out as it is.
* A value is scored as a whole; very long ones too. Equal values have equal scores.
* Repeated rows give one case. Other columns are ignored. An empty table gives no rows.
* Without weakly labelled values of both kinds nothing can be learned: the weak labels themselves decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import linear
from tallyforge.session import durable

#: The training sample's bounds: distinct values of either weak label, out of twelve times as many rows, and
#: the characters of a value to learn from. Values of any length are scored, and whole.
SAMPLE, SAMPLE_CHARS = 12_000, 2_000
#: Entities fall into this many parts; one sets the threshold, one gives the report.
PARTS = 10

#: Status codes of failed responses with their reason phrases, as the protocol registers them.
RESPONSES = {
    400: "bad request",
    401: "unauthorized",
    403: "forbidden",
    404: "not found",
    405: "method not allowed",
    408: "request timeout",
    410: "gone",
    429: "too many requests",
    500: "internal server error",
    501: "not implemented",
    502: "bad gateway",
    503: "service unavailable",
    504: "gateway timeout",
}
_SCRIPTS = "(javascript|java script|scripts?|scripting|cookies|js)"
#: Seeds of the weak labels, by kind; patterns without regard to case.
SEEDS = {
    "placeholder": (
        r"\{\{.*\}\}",
        r"[$#]\{[^}]*\}",
        r"<%.*%>",
        r"\{%.*%\}",
        r"\{[a-z0-9_][a-z0-9_ .]*\}",
        r"\[\[[^\]]*\]\]",
        r"<<[^>]+>>",
        r"@@[^@]+@@",
        r"\b__[a-z][a-z_ .]*__\b",
        r"%[a-z][a-z_ .]*%",
        r"\$[a-z][a-z_ .]*\$",
        r"%[sd]\b",
        r"«[^»]*»",
        r"[\[<(]\s*(insert|enter|your|add|type)\b[^\])>]*[\])>]",
        r"[\[<(][^\])>]* (goes )?here\s*[\])>]",
        r"^(insert|enter|type|add|your) \w+( here)?$",
        r"^[\[<(][a-z_ ]+[\])>]$",
    ),
    "filler": (
        r"\b(lorem|ipsum|dolor sit|sit amet|consectetur)\b",
        r"\b(asdf\w*|qwerty\w*|blah)\b",
        r"\bfoo\b.*\bba[rz]\b",
        r"^(\w{2,})( \1)+( \d+)?$",
        r"^(this is )?(some |a )?(dummy|placeholder|sample|filler|test)( text| description| value)+( (dummy|placeholder|sample|filler|test)( text| description| value))*( \d+)?$",
        r"\b(type|some|add) \w+ here\b",
        r"\bx{3,}\b",
        r"^[?.\-_*]{4,}( \d+)?$",
        r"^(tbd|tbc|todo|n/?a|none|null|nan|undefined)( \d+)?$",
    ),
    "error": (
        *(rf"\b{code}:? {reason}(?!\s+\w*[a-z])" for code, reason in RESPONSES.items()),
        r"^(http[ /.0-9]*|error )?[45]\d\d$",
        "^(" + "|".join(RESPONSES.values()) + ")$",
        r"</?(html|head|title|body|h\d|p|div|br)\b[^>]*>",
        r"#(ref|value|name|num|null)[!?]|#n/a|#div/0!?",
        r"\b(traceback|stack ?trace)\b",
        r"\b\w+exception\b|\b\w+error: |\bkeyerror\b",
        r"\b(fatal|sql|syntax|parse|runtime) error\b|\bsegmentation fault\b",
        r"^err_\w+$",
        r"\[object object\]",
        r"\bcould not connect\b|\bconnection (refused|reset)\b",
        r"\btimed out after\b",
        r"\btry again later\b",
        r"\bsomething went wrong\b",
        r"\bunexpected error occurred\b",
        r"\b(can't|cannot|could not) be (reached|found)\b",
        r"\brate limit exceeded\b",
        r"\bsession has expired\b",
        r"\b(access|permission) denied:|\bdo not have permission\b",
        r"\btemporarily unavailable\b",
        r"\bwill be back soon\b",
    ),
    "notice": (
        rf"\b(enable|activate|allow|requires?|support|turn on|switch on) {_SCRIPTS}\b",
        rf"\b{_SCRIPTS}( and {_SCRIPTS})? (is|are|must be|has been|have been|required|disabled)\b",
        r"</?noscript|\b(checking your browser|verify (that )?you are (a )?human)\b",
    ),
}


def weak_label(value: Column, field: Column | None = None, seeds: Mapping[str, Sequence[str]] = SEEDS) -> Column:
    """Whether a seed of any kind stands in the value, or the value is nothing but its field's own name."""
    hit = value.rlike("(?is)" + "|".join(f"(?:{p})" for p in _patterns(seeds)))
    return hit if field is None else hit | (F.regexp_replace(F.lower(F.trim(value)), r"[\s\-]+", "_") == field)


def _patterns(seeds: Mapping[str, Sequence[str]]) -> list[str]:
    """All patterns; those that refer back to a group come first, where groups are still numbered from 1."""
    return sorted((p for ps in seeds.values() for p in ps), key=lambda p: r"\1" not in p)


@dataclass
class Model:
    """weights is None where nothing could be learned; report has the held-out figures."""

    weights: np.ndarray | None
    threshold: float
    report: dict[str, float]


def _values(df: DataFrame, fields: Sequence[str], *extra: Column) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields]))
    return df.select(*extra, each.alias("v")).select("*", "v.field", "v.value").drop("v").filter(F.length(F.trim("value")) > 0)


def labelled(df: DataFrame, fields: Sequence[str], group: str, sample: int = SAMPLE, seeds: Mapping[str, Sequence[str]] = SEEDS) -> list[tuple[str, bool, int]]:
    """(value, weak label, part) of at most ``sample`` distinct values of either label.

    part 0: seen with entities to learn from. 1 and 2: seen only with held-out entities.
    """
    of = F.coalesce(F.pmod(F.xxhash64(F.col(f"`{group}`"), F.lit(3)), F.lit(PARTS)), F.lit(PARTS - 1))
    # rows are thinned by a hash, so that a value comes in by its frequency and the shuffle stays near the sample
    kept = min(1.0, 12 * sample / max(df.count(), 1))
    near = (F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns], F.lit(5)) / F.lit(2.0**63) + 1) / 2
    values = _values(df.filter(near <= kept), fields, of.alias("of")).filter(F.length("value") <= SAMPLE_CHARS)
    distinct = durable(
        values.groupBy("field", "value")
        # the larger part wins: learning over reporting over setting the threshold
        .agg(F.max(F.least("of", F.lit(2))).alias("at"), F.count(F.lit(1)).alias("n"))
        .withColumn("label", weak_label(F.col("value"), F.col("field"), seeds))
        .withColumn("u", (F.xxhash64("value", F.lit(9)) / F.lit(2.0**63) + 1) / 2)
    )
    picked = []
    for label in (True, False):
        for at, most in ((2, sample), (1, sample // 4), (0, sample // 4)):
            part = distinct.filter((F.col("label") == label) & (F.col("at") == at))
            by = part.orderBy(-F.log(F.col("u")) / F.col("n"), "value", "field").limit(most)
            picked += [(r.value, label, 2 - at) for r in by.select("value").collect()]
    return picked


def learn(picked: Sequence[tuple[str, bool, int]]) -> Model:
    """Train on part 0, set the threshold on part 2, report on part 1."""
    parts = [[(v, y) for v, y, at in picked if at == k] for k in (0, 1, 2)]
    if len({y for _, y in parts[0]}) < 2:
        return Model(None, 0.5, {"trained_on": len(parts[0])})
    weights = linear.train([v for v, _ in parts[0]], np.array([y for _, y in parts[0]]))
    seen = [(linear.scores(weights, [v for v, _ in part]), np.array([y for _, y in part], bool)) for part in parts]
    threshold, report = 0.5, {"trained_on": len(parts[0]), "held_out": len(parts[1])}
    p, y = seen[2]
    if y.any() and not y.all():
        threshold = float(max((_f1(p >= t, y), -abs(t - 0.5), t) for t in np.linspace(0.1, 0.9, 33))[2])
    p, y = seen[1]
    if y.any():
        hit = p >= threshold
        report |= {"f1": _f1(hit, y), "precision": float((hit & y).sum() / max(hit.sum(), 1)), "recall": float((hit & y).sum() / y.sum()), "threshold": threshold}
    return Model(weights, threshold, report)


def fit(df: DataFrame, fields: Sequence[str], group: str, sample: int = SAMPLE) -> Model:
    """The classifier of df's values, validated on groups it has not seen."""
    return learn(labelled(df, fields, group, sample))


def without_seed(picked: Sequence[tuple[str, bool, int]], pattern: str) -> float | None:
    """Recall on the values that only this seed labels, by a classifier that never saw any of them.

    For reports; queries do not run it. None where no value depends on the seed.
    """
    others = re.compile("|".join(f"(?:{p})" for p in _patterns(SEEDS) if p != pattern), re.I | re.S)
    mine = re.compile(pattern, re.I | re.S)
    alone = {v for v, y, _ in picked if y and mine.search(v) and not others.search(v)}
    if not alone:
        return None
    model = learn([r for r in picked if r[0] not in alone])
    if model.weights is None:
        return 0.0
    return float((linear.scores(model.weights, sorted(alone)) >= model.threshold).mean())


def _f1(hit: np.ndarray, y: np.ndarray) -> float:
    return float(2 * (hit & y).sum() / max(hit.sum() + y.sum(), 1))


def scored(df: DataFrame, fields: Sequence[str], model: Model, *carry: str) -> DataFrame:
    """(carry..., one score column a field, named ``score_`` and the field): null for a null or blank value.

    Each batch scores its distinct values once.
    """
    names = [f"score_{f}" for f in fields]
    if set(names) & set(carry):
        raise ValueError(f"carried columns clash with what is made: {sorted(set(names) & set(carry))}")
    text = [F.col(f"`{f}`").cast("string") for f in fields]
    filled = [F.when(F.length(F.trim(t)) > 0, t) for t in text]
    kept = [F.col(f"`{c}`") for c in carry]
    if model.weights is None:
        return df.select(*kept, *[F.when(weak_label(t, F.lit(f)), 1.0).when(t.isNotNull(), 0.0).alias(n) for t, f, n in zip(filled, fields, names, strict=True)])
    shared = df.sparkSession.sparkContext.broadcast(model.weights)
    rows = df.select(*kept, *[t.alias(n) for t, n in zip(filled, names, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for column in batch.columns[len(carry) :]:
                coded = column.dictionary_encode()
                p = pa.array(linear.scores(shared.value, coded.dictionary.to_pylist()), pa.float64())
                out.append(p.take(coded.indices))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *out], names=batch.schema.names)

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in carry], *[f"`{n}` double" for n in names]]))


def found(df: DataFrame, row_id: str, fields: Sequence[str], group: str) -> DataFrame:
    """(row id, field) of the values that are no real content, each once."""
    model = fit(df, fields, group)
    hit = F.filter(F.array(*[F.when(F.col(f"`score_{f}`") >= model.threshold, F.lit(f)) for f in fields]), lambda f: f.isNotNull())
    return scored(df, fields, model, row_id).select(F.col(f"`{row_id}`"), F.explode(hit).alias("field")).distinct()


def clean(df: DataFrame, fields: Sequence[str], group: str) -> DataFrame:
    """The rows of df, with all their columns, none of whose fields is such a value."""
    model = fit(df, fields, group)
    bad = F.exists(F.array(*[F.coalesce(F.col(f"`score_{f}`") >= model.threshold, F.lit(False)) for f in fields]), lambda x: x)
    return scored(df, fields, model, *df.columns).filter(~bad).drop(*[f"score_{f}" for f in fields])


def rates(df: DataFrame, fields: Sequence[str], group: str) -> DataFrame:
    """(field, filled, residue, share) of df, with the classifier's figures on groups it has not seen."""
    model = fit(df, fields, group)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`score_{f}`").alias("p")) for f in fields]))
    figures = [F.lit(float(model.report.get(k, 0.0))).alias(f"held_out_{k}") for k in ("precision", "recall", "f1")]
    counted = scored(df, fields, model).select(each.alias("v")).groupBy("v.field").agg(F.count("v.p").alias("filled"), F.count_if(F.col("v.p") >= model.threshold).alias("residue"))
    return counted.select("*", (F.col("residue") / F.nullif(F.col("filled"), F.lit(0))).alias("share"), *figures)
