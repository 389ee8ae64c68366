"""Rows that fail to parse: typed rows on one side, raw text with reasons on the other.

The text is read permissively under an explicit schema that retains the raw record of whatever the
reader could not fit. Records it calls corrupt, and records whose structure it is lenient about (any
quote, any line break), are reclassified: first quoting, then the number of fields, then the casts.

Defined results
---------------
* A null line is a record of no text: reason ``column_count`` (it has no fields).
* An empty line is one field: ``column_count``.
* Very long lines and any number of commas are handled; nothing is cut.
* An amount that is valid but that the amount type cannot hold exactly (too many digits before or after
  the point, zeros aside) is never rounded: its typed column is null and its text stands in the column
  named after it with ``_text``, which is null for all other rows.
* Lines are taken as rows of their own: repeated lines give repeated results.
* Columns of the input other than the line's are carried along; where their names clash with the
  record's, the input's come out with the prefix ``in_``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.barrier import once

#: Patterns a valid text matches whole. Java's ``$`` would let a final line break pass, hence ``\z``.
DATE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
AMOUNT = r"\A-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)\z"

#: The reader refuses records beyond this many columns outright, so such records skip it.
READER_COLUMNS = 20_000


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "string"  # string, date or amount


SOURCE_ROW = (
    Field("source_row_id"),
    Field("entity_code"),
    Field("account_code"),
    Field("transaction_date", "date"),
    Field("description"),
    Field("debit", "amount"),
    Field("credit", "amount"),
    Field("status_code"),
)


def _permissive(line: Column, fields: Sequence[Field]) -> Column:
    """The line under the explicit schema of texts, with ``_corrupt`` holding what did not fit."""
    schema = ", ".join(f"`{f.name}` string" for f in fields) + ", `_corrupt` string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "escape": '"', "quote": '"', "sep": ",", "maxColumns": str(READER_COLUMNS + 10)}
    return F.from_csv(line, F.lit(schema), options)


def _pieces(line: Column) -> Column:
    """The line cut at its quotes: pieces at even places are outside quotes, at odd places inside."""
    return F.split(line, '"', -1)


def quoting_broken(line: Column) -> Column:
    """A quote that never closes, stands in an unquoted field, or is followed by other than a comma.

    Between two quotes, a piece outside must be empty (a doubled quote) or both start and end with a
    comma; the first may be empty or end with one, the last may be empty or start with one.
    """
    pieces = _pieces(line)
    last = F.size(pieces) - 1
    bad = F.exists(
        F.transform(
            pieces,
            lambda p, i: (i % 2 == 0)
            & (p != "")
            & (((i > 0) & ~p.startswith(",")) | ((i < last) & ~p.endswith(","))),
        ),
        lambda x: x,
    )
    return (F.size(pieces) % 2 == 0) | bad


def split_quoted(line: Column) -> Column:
    """Fields of a line whose quoting holds, with quotes undone.

    Commas within quotes are written as %2C (and % as %25) before the pieces are joined and split,
    and turned back after, so that no character is reserved.
    """
    pieces = F.transform(
        _pieces(line),
        lambda p, i: F.when(i % 2 == 1, F.replace(F.replace(p, F.lit("%"), F.lit("%25")), F.lit(","), F.lit("%2C"))).otherwise(
            F.replace(p, F.lit("%"), F.lit("%25"))
        ),
    )
    last = F.size(pieces) - 1
    whole = F.array_join(
        F.transform(pieces, lambda p, i: F.when((i % 2 == 0) & (i > 0) & (i < last) & (p == ""), F.lit('"')).otherwise(p)), ""
    )
    return F.transform(F.split(whole, ",", -1), lambda p: F.replace(F.replace(p, F.lit("%2C"), F.lit(",")), F.lit("%25"), F.lit("%")))


def valid_date(text: Column) -> Column:
    """YYYY-MM-DD in ASCII digits, of a day that exists; the year 0000 does not."""
    return F.coalesce(text.rlike(DATE) & ~text.startswith("0000") & text.try_cast("date").isNotNull(), F.lit(False))


def valid_amount(text: Column) -> Column:
    return F.coalesce(text.rlike(AMOUNT), F.lit(False))


def fits(text: Column, amount_type: str) -> Column:
    """Whether a valid amount's number is held exactly by decimal(precision,scale)."""
    precision, scale = (int(x) for x in re.findall(r"\d+", amount_type))
    return text.rlike(rf"\A-?0*[0-9]{{0,{precision - scale}}}(?:\.[0-9]{{0,{scale}}}0*)?\z")


def classify(df: DataFrame, line: str, fields: Sequence[Field] = SOURCE_ROW, amount_type: str = "decimal(18,2)") -> DataFrame:
    """df with the record's typed columns, ``raw`` (the line) and ``reasons`` (empty: it loads).

    One pass without a shuffle; rows with reasons have null in all typed columns.
    """
    amounts = [f.name for f in fields if f.kind == "amount"]
    names = {f.name for f in fields} | {f"{a}_text" for a in amounts} | {"raw", "reasons"}
    keep = [F.col(f"`{c}`").alias(f"in_{c}" if c in names else c) for c in df.columns if c != line]
    text = F.col("raw")
    # the reader is lenient about quotes and stops at a line break: such records are looked at anew
    odd = text.rlike("[\"\r\n\0]")
    commas = F.length(text) - F.length(F.replace(text, F.lit(",")))
    base = df.select(*keep, F.col(f"`{line}`").alias("raw"))
    read = once(base, __tf_read=F.when(~odd & (text != "") & (commas < READER_COLUMNS), _permissive(text, fields)))
    loaded = F.col("__tf_read").isNotNull() & F.col("__tf_read._corrupt").isNull()
    quotes = text.contains('"')
    step = once(
        read,
        __tf_fields=F.when(loaded, F.array(*[F.coalesce(F.col(f"__tf_read.`{f.name}`"), F.lit("")) for f in fields]))
        .when(quotes & quoting_broken(text), F.lit(None))
        .when(quotes, split_quoted(text))
        .otherwise(F.split(text, ",", -1)),
    )
    value = {f.name: F.get(F.col("__tf_fields"), F.lit(i)) for i, f in enumerate(fields)}
    checks = {"date": valid_date, "amount": valid_amount}
    casts = F.filter(
        F.array(*[F.when(~checks[f.kind](value[f.name]), F.lit(f.name)) for f in fields if f.kind in checks]),
        lambda x: x.isNotNull(),
    )
    reasons = (
        F.when(text.isNull(), F.array(F.lit("column_count")))
        .when(F.col("__tf_fields").isNull(), F.array(F.lit("quoting")))
        .when(F.size("__tf_fields") != len(fields), F.array(F.lit("column_count")))
        .otherwise(casts)
    )
    step = step.withColumn("reasons", reasons)
    types = {"string": "string", "date": "date", "amount": amount_type}
    good = F.size("reasons") == 0
    outer = [*base.columns[:-1], "raw"]
    held = lambda f: good & fits(value[f.name], amount_type) if f.kind == "amount" else good
    return step.select(
        *[F.col(f"`{c}`") for c in outer],
        "reasons",
        *[F.when(held(f), value[f.name].try_cast(types[f.kind])).alias(f.name) for f in fields],
        *[F.when(good & ~fits(value[a], amount_type), value[a]).alias(f"{a}_text") for a in amounts],
    )


def rejected(df: DataFrame, line: str, fields: Sequence[Field] = SOURCE_ROW) -> DataFrame:
    """One row for each line and reason; the other columns of df and ``raw`` are carried."""
    done = classify(df, line, fields)
    keep = done.columns[: done.columns.index("reasons")]
    return done.select(*[F.col(f"`{c}`") for c in keep], F.explode_outer("reasons").alias("reason")).filter(F.col("reason").isNotNull())


def loaded(df: DataFrame, line: str, fields: Sequence[Field] = SOURCE_ROW) -> DataFrame:
    """The typed rows of the lines that load, with the texts of amounts that their type cannot hold."""
    return classify(df, line, fields).filter(F.size("reasons") == 0).drop("reasons", "raw")
