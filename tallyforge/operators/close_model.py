"""The close model: activity against ledger, coverage of mappings, nine controls and their rollup.

Amounts are exact decimals throughout; the tolerance of balance checks is a parameter. Accounts are
matched by exact text. Every control is one row (position, control, result, delta); each is a single
aggregation with map-side combine, so the table costs a few small shuffles at any size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.session import durable

TOLERANCE = "0.005"


def _filled(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)) for c in columns])


def _complete(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)) for c in columns])


def net_activity(source: DataFrame, account: str = "account_code", debit: str = "debit", credit: str = "credit") -> DataFrame:
    """(account, source_net): debits less credits; a null amount counts as nothing."""
    net = F.coalesce(F.col(debit), F.lit(0)) - F.coalesce(F.col(credit), F.lit(0))
    return source.filter(F.col(account).isNotNull()).groupBy(F.col(account).alias("account")).agg(F.sum(net).alias("source_net"))


def accounts(source: DataFrame) -> DataFrame:
    """All that the controls and the reconciliation need of the source, in one pass: a row for each account."""
    return source.groupBy(F.col("account_code").alias("account")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(_filled(SOURCE)).alias("active"),
        F.count_if(_complete(SOURCE)).alias("complete"),
        F.sum(F.abs(F.coalesce("debit", F.lit(0))) + F.abs(F.coalesce("credit", F.lit(0)))).alias("activity"),
        F.coalesce(F.sum("debit"), F.lit(0)).alias("debits"),
        F.coalesce(F.sum("credit"), F.lit(0)).alias("credits"),
    )


def reconcile_ledger(source: DataFrame, ledger: DataFrame) -> DataFrame:
    """(account, source_net, ledger_balance, difference, threshold, status) for each ledger account.

    source: rows, or what ``accounts`` made of them. ledger: (account, ledger_balance, threshold). An
    account without activity has a net of 0; without a balance or threshold it is NOT READY; a blank
    account has no status.
    """
    made = {"account", "debits", "credits"} <= set(source.columns)
    net = source.filter("account is not null").select("account", (F.col("debits") - F.col("credits")).alias("source_net")) if made else net_activity(source)
    joined = ledger.join(net, "account", "left").withColumn("source_net", F.coalesce("source_net", F.lit(0)))
    blank = F.coalesce(F.trim("account"), F.lit("")) == ""
    joined = joined.withColumn("difference", F.when(~blank, F.col("source_net") - F.coalesce("ledger_balance", F.lit(0))))
    status = (
        F.when(blank, F.lit(None))
        .when(F.col("ledger_balance").isNull() | F.col("threshold").isNull(), "NOT READY")
        .when(F.abs("difference") <= F.col("threshold"), "PASS")
        .otherwise("REVIEW")
    )
    return joined.select("account", "source_net", "ledger_balance", "difference", "threshold", status.alias("status"))


def period_change(source: DataFrame, period: Column) -> DataFrame:
    """(account, period, current, prior, change): each account's net beside its net of the month before."""
    net = F.coalesce(F.col("debit"), F.lit(0)) - F.coalesce(F.col("credit"), F.lit(0))
    by = source.groupBy("account_code", F.trunc(period, "month").alias("month")).agg(F.sum(net).alias("current"))
    prior = by.select("account_code", F.add_months("month", 1).alias("month"), F.col("current").alias("prior"))
    joined = by.join(prior, ["account_code", "month"], "left")
    return joined.select("account_code", F.date_format("month", "yyyy-MM").alias("period"), "current", "prior", (F.col("current") - F.col("prior")).alias("change"))


def active_maps(mapping: DataFrame, account: str = "account_code", active: str = "active") -> DataFrame:
    """(account, n): how many active map rows each account has."""
    return mapping.filter(F.col(active) == "Yes").groupBy(F.col(account).alias("account")).agg(F.count(F.lit(1)).alias("n"))


def coverage_defects(counts: DataFrame, reference: DataFrame, exactly_one: bool = True) -> DataFrame:
    """Accounts of ``counts`` (account, rows) with not exactly one (or no) row of ``reference`` (account, n)."""
    joined = counts.join(reference, "account", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.filter(F.col("n") != 1 if exactly_one else F.col("n") == 0)


def _control(df: DataFrame, position: int, name: str, result: Column, delta: Column) -> DataFrame:
    return df.select(F.lit(position).alias("position"), F.lit(name).alias("control"), result.alias("result"), delta.cast("decimal(38,2)").alias("delta"))


def _pass(delta: Column) -> Column:
    return F.when(delta == 0, "PASS").otherwise("FAIL")


#: The fields of each table's rows.
SOURCE = ("source_row_id", "entity_code", "account_code", "transaction_date", "description", "debit", "credit", "status_code")
MAP = ("account_code", "account_name", "statement_group", "reconciliation_owner_role", "active")
ENTRY = ("entry_id", "account_code", "description", "debit", "credit", "source_reference", "preparation_status")
EXCEPTION = ("exception_id", "detected_in", "question", "authority_class", "owner_role", "due_date", "status")


#: What a proposed entry's and an exception's fields may say.
PREPARATION = ("Draft", "Ready for review", "Hold")
AUTHORITY = ("supporting", "contextual", "question-only", "superseded")
EXCEPTION_STATUS = ("Open", "Resolved", "Retained")


def controls(
    by_account: DataFrame,
    mapping: DataFrame,
    reconciliation: DataFrame,
    entries: DataFrame | None = None,
    exceptions: DataFrame | None = None,
    identity: Sequence[str | None] = (),
    capacities: dict[str, int] | None = None,
    tolerance: str = TOLERANCE,
) -> DataFrame:
    """The nine controls.

    by_account is what ``accounts`` gives of the source, kept (it is read several times); reconciliation
    what reconcile_ledger gives; absent parts count as empty. capacities: the most rows that ``source``,
    ``map``, ``reconciliation``, ``entries`` and ``exceptions`` may have.
    """
    tol = F.lit(tolerance).cast("decimal(10,4)")
    spark = by_account.sparkSession
    reconciliation = durable(reconciliation.select("account", "status"))
    total_of = lambda c: F.coalesce(F.sum(c), F.lit(0))
    amounts = by_account.agg(
        total_of("active").alias("active"), total_of("complete").alias("complete"), total_of("activity").alias("activity"), (total_of("debits") - total_of("credits")).alias("balance")
    ).withColumn("delta", F.col("active") - F.col("complete"))
    first = F.when(F.col("active") == 0, "NOT READY").otherwise(_pass(F.col("delta")))
    gate = lambda c: F.when(first != "PASS", "NOT READY").otherwise(c)
    parts = [
        _control(amounts, 1, "source_rows_complete", first, F.col("delta")),
        _control(amounts, 2, "source_activity_nonzero", gate(F.when(F.col("activity") > 0, "PASS").otherwise("FAIL")), F.coalesce("activity", F.lit(0))),
        _control(amounts, 3, "debits_equal_credits", gate(F.when(F.abs("balance") < tol, "PASS").otherwise("FAIL")), F.col("balance")),
    ]
    used = by_account.filter(F.coalesce(F.trim("account"), F.lit("")) != "").select("account", "rows")
    maps = active_maps(mapping)
    total = lambda df, c: df.agg(F.coalesce(F.sum(c), F.lit(0)).alias("x"))
    map_rows = mapping.agg(F.count_if(_filled(MAP)).alias("active"), F.count_if(_complete(MAP) & F.col("active").isin("Yes", "No")).alias("complete"))
    unmapped = total(coverage_defects(used, maps), "rows")
    fourth = map_rows.crossJoin(unmapped).withColumn("delta", F.col("active") - F.col("complete") + F.col("x"))  # one row each
    parts.append(_control(fourth, 4, "mappings_complete", F.when(F.col("active") == 0, "NOT READY").otherwise(_pass(F.col("delta"))), F.col("delta")))
    listed = reconciliation.filter(F.coalesce(F.trim("account"), F.lit("")) != "").groupBy("account").agg(F.count(F.lit(1)).alias("n"))
    in_recon = listed.withColumnRenamed("n", "rows")
    recon_rows = reconciliation.agg(F.count(F.lit(1)).alias("active"), F.count_if(F.col("status") == "PASS").alias("complete"))
    defects = (
        total(coverage_defects(used, listed), "rows")
        .unionByName(total(coverage_defects(in_recon, maps), "rows"))
        .unionByName(total(coverage_defects(in_recon, used.withColumnRenamed("rows", "n"), exactly_one=False), "rows"))
        .agg(F.sum("x").alias("x"))
    )
    fifth = recon_rows.crossJoin(defects).withColumn("delta", F.col("active") - F.col("complete") + F.col("x"))  # one row each
    fifth_result = F.when(F.col("active") == 0, "NOT READY").otherwise(_pass(F.col("delta")))
    parts.append(_control(fifth, 5, "reconciliation_complete", fifth_result, F.col("delta")))
    if entries is None:
        parts.append(_control(spark.range(1), 6, "entries_balanced", F.lit("NOT APPLICABLE"), F.lit(0)))
    else:
        e = entries.agg(
            F.count_if(_filled(ENTRY)).alias("active"),
            F.count_if(_complete(ENTRY) & F.col("preparation_status").isin(*PREPARATION)).alias("complete"),
            (F.coalesce(F.sum("debit"), F.lit(0)) - F.coalesce(F.sum("credit"), F.lit(0))).alias("balance"),
        ).withColumn("delta", F.col("active") - F.col("complete") + F.when(F.abs("balance") < tol, 0).otherwise(1))
        parts.append(_control(e, 6, "entries_balanced", F.when(F.col("active") == 0, "NOT APPLICABLE").otherwise(_pass(F.col("delta"))), F.col("delta")))
    gate5 = fifth.select(fifth_result.alias("gate"))
    if exceptions is None:
        seventh = gate5.withColumn("delta", F.lit(0))
    else:
        known = F.col("authority_class").isin(*AUTHORITY) & F.col("status").isin(*EXCEPTION_STATUS)
        x = exceptions.agg((F.count_if(_filled(EXCEPTION)) - F.count_if(_complete(EXCEPTION) & known) + F.count_if(F.col("status") == "Open")).alias("delta"))
        seventh = gate5.crossJoin(x)  # one row each
    parts.append(_control(seventh, 7, "exceptions_closed", F.when(F.col("gate") != "PASS", "NOT READY").otherwise(_pass(F.col("delta"))), F.col("delta")))
    open_fields = sum(1 for v in identity if v is None or not v.strip() or v.startswith("{"))
    parts.append(_control(spark.range(1), 8, "identity_populated", F.lit("NOT READY" if open_fields or not identity else "PASS"), F.lit(int(bool(open_fields or not identity)))))
    size = {"source": (by_account, F.coalesce(F.sum("rows"), F.lit(0))), **{k: (df, F.count(F.lit(1))) for k, df in (("map", mapping), ("reconciliation", reconciliation), ("entries", entries), ("exceptions", exceptions)) if df is not None}}
    beyond = [size[k][0].agg(F.greatest(size[k][1] - F.lit(cap), F.lit(0)).alias("x")) for k, cap in (capacities or {}).items() if k in size]
    ninth = reduce(lambda a, b: a.unionByName(b), beyond).agg(F.sum("x").alias("x")) if beyond else spark.range(1).select(F.lit(0).alias("x"))
    parts.append(_control(ninth, 9, "within_capacity", _pass(F.col("x")), F.col("x")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def model_status(table: DataFrame) -> DataFrame:
    """FAIL if any control fails, else NOT READY if any is not ready, else PASS."""
    has = lambda r: F.bool_or(F.col("result") == r)
    return table.agg(F.when(has("FAIL"), "FAIL").when(has("NOT READY"), "NOT READY").otherwise("PASS").alias("status"))


def ledger_match(source: DataFrame, mapping: DataFrame, ledger: DataFrame) -> DataFrame:
    """(account, defect): exact reconciliation of source, map and ledger; empty when all tie.

    Defects: duplicate_map, duplicate_ledger, unmapped, not_in_ledger, not_in_source, balance.
    """
    repeated = lambda df, c, d: df.groupBy(F.col(c).alias("account")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("account", F.lit(d).alias("defect"))
    net = net_activity(source)
    balances = ledger.groupBy("account").agg(F.sum("ledger_balance").alias("ledger_balance"))
    both = net.join(balances, "account", "full")
    defect = (
        F.when(F.col("ledger_balance").isNull(), "not_in_ledger").when(F.col("source_net").isNull(), "not_in_source").when(F.col("source_net") != F.col("ledger_balance"), "balance")
    )
    unmapped = net.join(mapping.select(F.col("account_code").alias("account")).distinct(), "account", "left_anti").select("account", F.lit("unmapped").alias("defect"))
    return (
        both.select("account", defect.alias("defect"))
        .filter(F.col("defect").isNotNull())
        .unionByName(repeated(mapping, "account_code", "duplicate_map"))
        .unionByName(repeated(ledger, "account", "duplicate_ledger"))
        .unionByName(unmapped)
    )
