"""The slate of record-engine queries and the SQL they are checked against.

Each binds an operator to tables at hand: ``source_rows`` and ``source_rows_mirror`` as source and ledger
carriers, ``account_map`` as mapping, ``profiles``, ``foundation_cards`` and ``blueprints`` as documents, and
the star-schema tables where an operator needs no carrier. Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import scalars
from tallyforge.operators import carriers, catalog, close_model, findings, integrity, malformed, nested
from tallyforge.plans.records import _JSON, _LINES
from tallyforge.session import durable
from tallyforge.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """source_rows without redelivered copies."""
    return table(spark, folder, "source_rows").drop("loaded_at").distinct()


def _money(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


_CLEAN = "src AS (SELECT DISTINCT source_row_id, entity_code, account_code, transaction_date, description, debit, credit, status_code FROM source_rows)"
_NET = "sum(coalesce(debit, 0)) - sum(coalesce(credit, 0))"


# E: close model


def _ledger(spark: SparkSession, folder: str, threshold: str = "250.00") -> DataFrame:
    """The second system's balances as a ledger."""
    mirror = table(spark, folder, "source_rows_mirror").drop("loaded_at").distinct()
    net = close_model.net_activity(mirror)
    return net.select("account", F.col("source_net").alias("ledger_balance"), F.lit(threshold).cast("decimal(18,2)").alias("threshold"))


_LEDGER = "led AS (SELECT account_code AS account, " + _NET + " AS ledger_balance, 250.00 AS threshold FROM (SELECT DISTINCT source_row_id, entity_code, account_code, transaction_date, description, debit, credit, status_code FROM source_rows_mirror) WHERE account_code IS NOT NULL GROUP BY 1)"
_RECON = f"""{_CLEAN}, {_LEDGER}, net AS (SELECT account_code AS account, {_NET} AS source_net FROM src WHERE account_code IS NOT NULL GROUP BY 1),
recon AS (SELECT led.account, coalesce(source_net, 0) AS source_net, ledger_balance, threshold,
  CASE WHEN trim(led.account) = '' THEN NULL ELSE coalesce(source_net, 0) - ledger_balance END AS difference FROM led LEFT JOIN net USING (account)),
judged AS (SELECT *, CASE WHEN trim(account) = '' THEN NULL WHEN abs(difference) <= threshold THEN 'PASS' ELSE 'REVIEW' END AS status FROM recon)"""


@query(f"WITH {_RECON} SELECT account, source_net::DOUBLE AS source_net, ledger_balance::DOUBLE AS ledger_balance, difference::DOUBLE AS difference, threshold::DOUBLE AS threshold, status FROM judged")
def reconcile_ledger(spark: SparkSession, folder: str) -> DataFrame:
    done = close_model.reconcile_ledger(_rows(spark, folder), _ledger(spark, folder))
    return _money(done, "source_net", "ledger_balance", "difference", "threshold")


@query(
    f"""WITH {_CLEAN}, m AS (SELECT account_code, date_trunc('month', transaction_date)::DATE AS month, {_NET} AS current FROM src GROUP BY ALL)
    SELECT a.account_code, strftime(a.month, '%Y-%m') AS period, a.current::DOUBLE AS current, b.current::DOUBLE AS prior, (a.current - b.current)::DOUBLE AS change
    FROM m a LEFT JOIN m b ON a.account_code = b.account_code AND b.month + INTERVAL 1 MONTH = a.month"""
)
def prior_period_change(spark: SparkSession, folder: str) -> DataFrame:
    return _money(close_model.period_change(_rows(spark, folder), F.col("transaction_date")), "current", "prior", "change")


def _controls(spark: SparkSession, folder: str, rows: DataFrame | None = None, **more: DataFrame) -> DataFrame:
    by_account = durable(close_model.accounts(rows if rows is not None else _rows(spark, folder)))
    recon = close_model.reconcile_ledger(by_account, _ledger(spark, folder))
    identity = ("entity", "period", "preparer", "{{reviewer}}")
    return close_model.controls(by_account, table(spark, folder, "account_map"), recon, identity=identity, capacities={"source": 100_000, "map": 200}, **more)


_FULL = lambda cols: " AND ".join(f"coalesce(trim({c}::VARCHAR) <> '', false)" for c in cols)
_ANY = lambda cols: " OR ".join(f"coalesce(trim({c}::VARCHAR) <> '', false)" for c in cols)
_CONTROLS = f"""{_RECON},
one AS (SELECT count(*) FILTER ({_ANY(close_model.SOURCE)}) AS active, count(*) FILTER ({_FULL(close_model.SOURCE)}) AS complete,
  coalesce(sum(abs(coalesce(debit, 0)) + abs(coalesce(credit, 0))), 0) AS activity, coalesce(sum(debit), 0) - coalesce(sum(credit), 0) AS balance FROM src),
used AS (SELECT account_code AS account, count(*) AS rows FROM src WHERE coalesce(trim(account_code), '') <> '' GROUP BY 1),
maps AS (SELECT account_code AS account, count(*) AS n FROM account_map WHERE active = 'Yes' GROUP BY 1),
listed AS (SELECT account, count(*) AS n FROM judged WHERE coalesce(trim(account), '') <> '' GROUP BY 1),
four AS (SELECT (SELECT count(*) FILTER ({_ANY(close_model.MAP)}) FROM account_map) AS active,
  (SELECT count(*) FILTER ({_FULL(close_model.MAP)} AND active IN ('Yes', 'No')) FROM account_map) AS complete,
  (SELECT coalesce(sum(rows), 0) FROM used LEFT JOIN maps USING (account) WHERE coalesce(n, 0) <> 1) AS x),
five AS (SELECT (SELECT count(*) FROM judged) AS active, (SELECT count(*) FILTER (status = 'PASS') FROM judged) AS complete,
  (SELECT coalesce(sum(rows), 0) FROM used LEFT JOIN listed USING (account) WHERE coalesce(n, 0) <> 1)
  + (SELECT coalesce(sum(l.n), 0) FROM listed l LEFT JOIN maps USING (account) WHERE coalesce(maps.n, 0) <> 1)
  + (SELECT coalesce(sum(l.n), 0) FROM listed l LEFT JOIN used USING (account) WHERE coalesce(used.rows, 0) = 0) AS x),
t AS (
  SELECT 1 AS position, 'source_rows_complete' AS control, CASE WHEN active = 0 THEN 'NOT READY' WHEN active = complete THEN 'PASS' ELSE 'FAIL' END AS result, (active - complete)::DOUBLE AS delta FROM one
  UNION ALL SELECT 2, 'source_activity_nonzero', CASE WHEN active = 0 OR active <> complete THEN 'NOT READY' WHEN activity > 0 THEN 'PASS' ELSE 'FAIL' END, activity::DOUBLE FROM one
  UNION ALL SELECT 3, 'debits_equal_credits', CASE WHEN active = 0 OR active <> complete THEN 'NOT READY' WHEN abs(balance) < 0.005 THEN 'PASS' ELSE 'FAIL' END, balance::DOUBLE FROM one
  UNION ALL SELECT 4, 'mappings_complete', CASE WHEN active = 0 THEN 'NOT READY' WHEN active - complete + x = 0 THEN 'PASS' ELSE 'FAIL' END, (active - complete + x)::DOUBLE FROM four
  UNION ALL SELECT 5, 'reconciliation_complete', CASE WHEN active = 0 THEN 'NOT READY' WHEN active - complete + x = 0 THEN 'PASS' ELSE 'FAIL' END, (active - complete + x)::DOUBLE FROM five
  UNION ALL SELECT 6, 'entries_balanced', 'NOT APPLICABLE', 0
  UNION ALL SELECT 7, 'exceptions_closed', CASE WHEN active = 0 OR active - complete + x <> 0 THEN 'NOT READY' ELSE 'PASS' END, 0 FROM five
  UNION ALL SELECT 8, 'identity_populated', 'NOT READY', 1
  UNION ALL SELECT 9, 'within_capacity', CASE WHEN x = 0 THEN 'PASS' ELSE 'FAIL' END, x::DOUBLE FROM (SELECT greatest((SELECT count(*) FROM src) - 100000, 0) + greatest((SELECT count(*) FROM account_map) - 200, 0) AS x))"""


@query(f"WITH {_CONTROLS} SELECT * FROM t")
def control_table(spark: SparkSession, folder: str) -> DataFrame:
    return _money(_controls(spark, folder), "delta")


_AS_ENTRY = {"OPEN": "Draft", "PENDING": "Ready for review", "HOLD": "Hold", "PARKED": "Draft "}
_AS_EXCEPTION = {"REVERSED": "Resolved", "VOID": "Retained", "DENIED": "Open", "REQ-INFO": "Closed"}
_CASE = lambda names: "CASE status_code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"
_IN = lambda names: "status_code IN (" + ", ".join(f"'{k}'" for k in names) + ")"
_PARTS = f"""entries AS (SELECT source_row_id AS entry_id, account_code, description, debit, credit, entity_code AS source_reference, {_CASE(_AS_ENTRY)} AS preparation_status FROM src WHERE {_IN(_AS_ENTRY)}),
exceptions AS (SELECT source_row_id AS exception_id, entity_code AS detected_in, description AS question, 'supporting' AS authority_class, account_code AS owner_role, transaction_date AS due_date, {_CASE(_AS_EXCEPTION)} AS status FROM src WHERE {_IN(_AS_EXCEPTION)}),
six AS (SELECT count(*) FILTER ({_ANY(close_model.ENTRY)}) AS active, count(*) FILTER ({_FULL(close_model.ENTRY)} AND preparation_status IN ('Draft', 'Ready for review', 'Hold')) AS complete,
  CASE WHEN abs(coalesce(sum(debit), 0) - coalesce(sum(credit), 0)) < 0.005 THEN 0 ELSE 1 END AS off FROM entries),
seven AS (SELECT count(*) FILTER ({_ANY(close_model.EXCEPTION)}) - count(*) FILTER ({_FULL(close_model.EXCEPTION)} AND status IN ('Open', 'Resolved', 'Retained')) + count(*) FILTER (status = 'Open') AS x FROM exceptions)"""


@query(
    f"""WITH {_CONTROLS}, {_PARTS} SELECT * FROM t WHERE position NOT IN (6, 7)
    UNION ALL SELECT 6, 'entries_balanced', CASE WHEN active = 0 THEN 'NOT APPLICABLE' WHEN active - complete + off = 0 THEN 'PASS' ELSE 'FAIL' END, (active - complete + off)::DOUBLE FROM six
    UNION ALL SELECT 7, 'exceptions_closed', CASE WHEN (SELECT active = 0 OR active - complete + x <> 0 FROM five) THEN 'NOT READY' WHEN x = 0 THEN 'PASS' ELSE 'FAIL' END, x::DOUBLE FROM seven"""
)
def control_table_full(spark: SparkSession, folder: str) -> DataFrame:
    """The controls with proposed entries and exceptions, read off rows by their status."""
    rows = _rows(spark, folder)

    def named(names: dict[str, str]) -> Column:
        out = F.lit(None).cast("string")
        for k, v in names.items():
            out = F.when(F.col("status_code") == k, v).otherwise(out)
        return out

    entries = rows.filter(F.col("status_code").isin(*_AS_ENTRY)).select(F.col("source_row_id").alias("entry_id"), "account_code", "description", "debit", "credit", F.col("entity_code").alias("source_reference"), named(_AS_ENTRY).alias("preparation_status"))
    exceptions = rows.filter(F.col("status_code").isin(*_AS_EXCEPTION)).select(
        F.col("source_row_id").alias("exception_id"), F.col("entity_code").alias("detected_in"), F.col("description").alias("question"), F.lit("supporting").alias("authority_class"), F.col("account_code").alias("owner_role"), F.col("transaction_date").alias("due_date"), named(_AS_EXCEPTION).alias("status")
    )
    return _money(_controls(spark, folder, entries=entries, exceptions=exceptions), "delta")


@query(f"WITH {_CONTROLS} SELECT CASE WHEN bool_or(result = 'FAIL') THEN 'FAIL' WHEN bool_or(result = 'NOT READY') THEN 'NOT READY' ELSE 'PASS' END AS status FROM t")
def model_status(spark: SparkSession, folder: str) -> DataFrame:
    return close_model.model_status(_controls(spark, folder))


@query(
    f"""WITH {_CLEAN}, used AS (SELECT account_code AS account, count(*) AS rows FROM src WHERE account_code IS NOT NULL GROUP BY 1),
    maps AS (SELECT account_code AS account, count(*) AS n FROM account_map WHERE active = 'Yes' GROUP BY 1)
    SELECT account, rows, coalesce(n, 0) AS n FROM used LEFT JOIN maps USING (account) WHERE coalesce(n, 0) <> 1"""
)
def map_coverage(spark: SparkSession, folder: str) -> DataFrame:
    used = _rows(spark, folder).filter("account_code is not null").groupBy(F.col("account_code").alias("account")).agg(F.count(F.lit(1)).alias("rows"))
    return close_model.coverage_defects(used, close_model.active_maps(table(spark, folder, "account_map")))


@query(f"WITH {_CLEAN} SELECT entity_code, count(*) AS rows, count(*) - 100 AS beyond FROM src GROUP BY 1 HAVING count(*) > 100")
def capacity_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of an entity beyond its table's capacity: a count, so no row is ranked or gathered."""
    by = _rows(spark, folder).groupBy("entity_code").agg(F.count(F.lit(1)).alias("rows"))
    return by.filter("rows > 100").withColumn("beyond", F.col("rows") - 100)


@query(
    f"""WITH {_CLEAN}, {_LEDGER}, net AS (SELECT account_code AS account, {_NET} AS source_net FROM src WHERE account_code IS NOT NULL GROUP BY 1)
    SELECT account, CASE WHEN ledger_balance IS NULL THEN 'not_in_ledger' WHEN source_net IS NULL THEN 'not_in_source' ELSE 'balance' END AS defect
    FROM net FULL JOIN led USING (account) WHERE source_net IS DISTINCT FROM ledger_balance
    UNION ALL SELECT account_code, 'duplicate_map' FROM account_map WHERE account_code IS NOT NULL GROUP BY 1 HAVING count(*) > 1
    UNION ALL SELECT account, 'unmapped' FROM net WHERE account NOT IN (SELECT account_code FROM account_map WHERE account_code IS NOT NULL)"""
)
def ledger_exact_match(spark: SparkSession, folder: str) -> DataFrame:
    mapping = table(spark, folder, "account_map").filter("account_code is not null")
    return close_model.ledger_match(_rows(spark, folder), mapping, _ledger(spark, folder))


# A, D, G: carriers


@query("SELECT coalesce(trim(source_row_id), '') AS value, count(*) AS n FROM source_rows GROUP BY 1 HAVING count(*) > 1 OR coalesce(trim(source_row_id), '') = ''")
def carrier_id_integrity(spark: SparkSession, folder: str) -> DataFrame:
    return carriers.id_defects(table(spark, folder, "source_rows"), "source_row_id")


@query("SELECT md5(text) AS digest, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def carrier_exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Texts are grouped by a hash of 256 bits, so that long texts are not shuffled."""
    hashed = table(spark, folder, "documents").filter("text is not null").select(F.sha2("text", 256).alias("h"), F.md5("text").alias("digest"))
    return carriers.duplicate_rows(hashed).select("digest", "n")


_UNIQUE = ("entity_code", "account_code", "description", "status_code")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT nullif(trim({c}), '')) AS n FROM source_rows" for c in _UNIQUE))
def carrier_min_unique(spark: SparkSession, folder: str) -> DataFrame:
    return carriers.distinct_values(table(spark, folder, "source_rows"), _UNIQUE)


@query(
    """SELECT doc_id, len(string_split(text, chr(10))) AS lines, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13)) = '')) AS blank_lines,
    list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS longest FROM documents WHERE text IS NOT NULL"""
)
def carrier_row_metrics(spark: SparkSession, folder: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    docs = table(spark, folder, "documents").filter("text is not null")
    blank = F.size(F.filter(lines, lambda x: F.trim(x, F.lit(" \t\r")) == ""))
    return docs.select("doc_id", F.size(lines).cast("bigint").alias("lines"), blank.cast("bigint").alias("blank_lines"), F.array_max(F.transform(lines, F.length)).cast("bigint").alias("longest"))


@query(
    """WITH c AS (SELECT line_id, upper(trim(status_code)) AS s, trim(coalesce(description, '')) AS d FROM (SELECT source_row_id AS line_id, status_code, description FROM source_rows))
    SELECT 'resolution_required' AS rule, 'error' AS severity, 'source_rows' AS subject, NULL::BIGINT AS ordinal, coalesce(trim(status_code), '') AS detail FROM source_rows WHERE trim(status_code) IN ('REVERSED', 'VOID') AND coalesce(trim(description), '') = ''
    UNION ALL SELECT 'resolution_forbidden', 'error', 'source_rows', NULL, trim(status_code) FROM source_rows WHERE trim(status_code) IN ('PAGE-2') AND coalesce(trim(description), '') <> ''
    UNION ALL SELECT DISTINCT 'status_not_allowed', 'error', 'source_rows', NULL::BIGINT, coalesce(trim(status_code), '') FROM source_rows WHERE coalesce(trim(status_code), '') NOT IN ('ACCRUED', 'CLEARED', 'HOLD', 'OPEN', 'PENDING', 'POSTED', 'REVERSED')
    UNION ALL SELECT 'status_missing', 'error', 'source_rows', NULL, s FROM (VALUES ('OPEN'), ('SUSPENDED')) v(s) WHERE s NOT IN (SELECT coalesce(trim(status_code), '') FROM source_rows)"""
)
def lifecycle_findings(spark: SparkSession, folder: str) -> DataFrame:
    rule = carriers.Lifecycle("status_code", "description", ("ACCRUED", "CLEARED", "HOLD", "OPEN", "PENDING", "POSTED", "REVERSED"), ("OPEN", "SUSPENDED"), ("REVERSED", "VOID"), ("PAGE-2",))
    return carriers.lifecycle_findings(table(spark, folder, "source_rows"), "source_rows", rule)


@query(
    """WITH l AS (SELECT DISTINCT trim(account_code) AS key FROM source_rows WHERE trim(account_code) <> ''), r AS (SELECT DISTINCT trim(account_code) AS key FROM account_map WHERE trim(account_code) <> '')
    SELECT key, 'left' AS side FROM l WHERE key NOT IN (SELECT key FROM r) UNION ALL SELECT key, 'right' FROM r WHERE key NOT IN (SELECT key FROM l)"""
)
def reconcile_keys(spark: SparkSession, folder: str) -> DataFrame:
    return carriers.key_differences(table(spark, folder, "source_rows"), "account_code", table(spark, folder, "account_map"), "account_code")


@query(
    """WITH d AS (SELECT source_row_id, entity_code, account_code, transaction_date, description, debit, credit, status_code, loaded_at, count(*) AS n FROM source_rows GROUP BY ALL HAVING count(*) > 1)
    SELECT 'duplicate_row' AS rule, count(*) AS n FROM d UNION ALL SELECT 'id_not_unique', count(*) FROM (SELECT 1 FROM source_rows GROUP BY coalesce(trim(source_row_id), '') HAVING count(*) > 1)
    UNION ALL SELECT 'too_few_values', count(*) FROM (SELECT count(DISTINCT nullif(trim(status_code), '')) AS c FROM source_rows) WHERE c < 10000
    UNION ALL SELECT 'unresolved_token', 1 FROM source_rows WHERE regexp_matches(concat_ws('|', source_row_id, entity_code, account_code, description, status_code), '\\{\\{[^{}]+\\}\\}') GROUP BY 2
    UNION ALL SELECT 'column_missing', 1"""
)
def carrier_audit(spark: SparkSession, folder: str) -> DataFrame:
    """All carrier rules at once, counted by rule (rules without findings are absent)."""
    rules = carriers.Rules(("source_row_id", "approver"), 1, "source_row_id", {"status_code": 10_000})
    return carriers.audit(table(spark, folder, "source_rows"), "source_rows", rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(regexp_full_match(json_extract_string(props, '$.k'), '-?[0-9]+') AND try_cast(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL, false) AS valid, date_diff('day', DATE '1899-12-30', ts::DATE)::BIGINT AS serial FROM events"""
)
def typed_row_validation(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    valid = F.coalesce(k.rlike(r"\A-?[0-9]+\z") & k.try_cast("bigint").isNotNull(), F.lit(False))
    return table(spark, folder, "events").select("event_id", k.alias("k"), valid.alias("valid"), scalars.excel_serial(F.to_date("ts")).cast("bigint").alias("serial"))


_FLOOR = {"entities": ("entity_code", 4), "accounts": ("account_code", 10), "dates": ("transaction_date", 20), "statuses": ("status_code", 4), "descriptions": ("description", 100)}
_COUNTED = {**{k: (f"count(DISTINCT {c})", least) for k, (c, least) in _FLOOR.items()}, "amounts": ("count(DISTINCT CASE WHEN debit <> 0 THEN debit END)", 150), "cents": ("count(DISTINCT (abs(debit) * 100)::BIGINT % 100)", 101)}


@query(" UNION ALL ".join(f"SELECT '{k}' AS dimension, {c} AS n, {least} AS least, {c} >= {least} AS holds FROM source_rows" for k, (c, least) in _COUNTED.items()))
def diversity_floor(spark: SparkSession, folder: str) -> DataFrame:
    """How many different values each dimension of a population has, against the least it must have."""
    counts = [F.count_distinct(c).alias(k) for k, (c, _) in _FLOOR.items()]
    cents = F.pmod((F.abs("debit") * 100).cast("bigint"), F.lit(100))
    one = table(spark, folder, "source_rows").agg(*counts, F.count_distinct(F.when(F.col("debit") != 0, F.col("debit"))).alias("amounts"), F.count_distinct(cents).alias("cents"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).alias("n"), F.lit(least).alias("least")) for k, (_, least) in _COUNTED.items()]))
    return one.select(each.alias("e")).select("e.*", (F.col("e.n") >= F.col("e.least")).alias("holds"))


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", sum(n)::BIGINT AS rows, max(n) AS top, max(n) / sum(n)::DOUBLE AS share, max(n) / sum(n)::DOUBLE < 0.4 AS holds FROM (SELECT coalesce(trim({c}), '') AS v, count(*) AS n FROM source_rows GROUP BY 1)"
        for c in ("entity_code", "account_code", "description", "status_code")
    )
)
def mode_share(spark: SparkSession, folder: str) -> DataFrame:
    """How much of a column its most frequent value makes up, and whether that is below two fifths."""
    return carriers.mode_share(table(spark, folder, "source_rows"), _UNIQUE).withColumn("holds", F.col("share") < 0.4)


@query("SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def distribution_map(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


# D, H, J: catalog


def _catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Profiled templates as catalog entries, one a key: the smallest profile's."""
    flat = nested.flatten(table(spark, folder, "profiles").select("profile_seq", "body"), "body", ["profile_seq"], nested.Layout("templates", "template", "template_id", (), ("version",)))
    return flat.filter("child_key is not null and version is not null").groupBy(F.col("child_key").alias("template_id"), "version").agg(F.min("profile_seq").alias("first_profile"))


_TEMPLATES = f"{_JSON}, entries AS (SELECT t->>'$.template_id' AS template_id, t->>'$.version' AS version, min(profile_seq) AS first_profile FROM t WHERE json_type(t) = 'OBJECT' AND t->>'$.template_id' IS NOT NULL AND t->>'$.version' IS NOT NULL GROUP BY ALL)"


@query(
    """SELECT blueprint_id, schema_version, archetype, name, artifact_type, primary_class FROM blueprints WHERE schema_version = '2.0.0' AND removed_on IS NULL AND lower(trim(primary_class)) = 'contextual' AND list_contains(string_split(archetype, '_'), 'workbook')"""
)
def catalog_discover(spark: SparkSession, folder: str) -> DataFrame:
    """Entries by equality (which reaches the scan), by what an array must hold, and by a text's identity."""
    known = table(spark, folder, "blueprints").filter("removed_on is null").drop("added_on", "removed_on").withColumn("tags", F.split("archetype", "_"))
    return catalog.discover(known, {"schema_version": "2.0.0", "artifact_type": None}, {"tags": ["workbook"]}, {"primary_class": " CONTEXTUAL"}, order=("blueprint_id",)).drop("tags")


@query("SELECT o_custkey AS custkey FROM orders GROUP BY 1 HAVING list_has_all(list(DISTINCT o_orderpriority), ['1-URGENT', '5-LOW'])")
def capability_superset(spark: SparkSession, folder: str) -> DataFrame:
    """Customers whose orders have all wanted priorities; a set of a fixed vocabulary, combined map-side."""
    have = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.collect_set("o_orderpriority").alias("have"))
    return have.filter(scalars.superset(F.col("have"), ["1-URGENT", "5-LOW"])).select("custkey")


@query(f"WITH {_TEMPLATES}, one AS (SELECT template_id, version FROM entries ORDER BY 1, 2 LIMIT 1) SELECT entries.* FROM entries JOIN one USING (template_id, version)")
def catalog_select_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Exact selection of the first key; the request itself is read off the catalog's smallest key."""
    entries = _catalog(spark, folder)
    wanted = entries.orderBy("template_id", "version").select("template_id", "version").first()
    return catalog.select_exact(entries, *wanted) if wanted else entries.limit(0)


@query(f"WITH {_JSON} SELECT t->>'$.template_id' AS template_id, t->>'$.version' AS version, count(*) AS n FROM t WHERE json_type(t) = 'OBJECT' AND t->>'$.template_id' IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def catalog_duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    flat = nested.flatten(table(spark, folder, "profiles").select("profile_seq", "body"), "body", ["profile_seq"], nested.Layout("templates", "template", "template_id", (), ("version",)))
    return catalog.key_defects(flat.filter("child_key is not null").withColumnRenamed("child_key", "template_id"))


_WINDOW = "w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events QUALIFY back <= 5)"


@query(f"WITH {_WINDOW} SELECT user_id, event_type, count(*) AS exact, max(back = 1) AS consecutive FROM w GROUP BY ALL")
def recent_window_counts(spark: SparkSession, folder: str) -> DataFrame:
    uses = catalog.last_uses(table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type"), 5, ["user_id"], "ts", ["event_id"])
    return catalog.window_counts(uses, ["user_id"], "event_type")


_FACETS = "struct<business_function:array<string>,lifecycle:array<string>,medium:array<string>,organization_form:array<string>>"
_ENTRY = nested.Layout("templates", "template", "template_id", (), ("version", "facets", "diversity_fingerprint"))


def _templates(spark: SparkSession, folder: str) -> DataFrame:
    """Templates of all profiles, with their facets and the profile's id and status."""
    profiles = table(spark, folder, "profiles").withColumn("status", F.get_json_object("body", "$.status"))
    flat = nested.flatten(profiles.select("profile_seq", "submission_profile_id", "status", "body"), "body", ["profile_seq", "submission_profile_id", "status"], _ENTRY)
    keyed = flat.filter("child_key is not null and version is not null").withColumnsRenamed({"child_key": "template_id", "parent_pos": "template_pos", "diversity_fingerprint": "fingerprint"})
    return keyed.withColumn("facets", F.from_json("facets", _FACETS))


_OLD = "version LIKE '1.%'"
_RECOMMEND = f"""{_JSON},
e AS (SELECT profile_seq, template_pos, p.submission_profile_id, p.body->>'$.status' AS status, t->>'$.template_id' AS template_id, t->>'$.version' AS version, t->>'$.diversity_fingerprint' AS fingerprint,
  (t->'$.facets.medium')::VARCHAR[] AS medium, (t->'$.facets.business_function')::VARCHAR[] AS jobs FROM t JOIN profiles p USING (profile_seq) WHERE json_type(t) = 'OBJECT' AND t->>'$.template_id' IS NOT NULL AND t->>'$.version' IS NOT NULL),
catalog AS (SELECT DISTINCT template_id, version, CASE WHEN {_OLD} THEN 'deprecated' ELSE 'released' END AS release_status FROM e),
reviewed AS (SELECT DISTINCT template_id, version, submission_profile_id, fingerprint, medium, jobs FROM e WHERE status = 'reviewed'),
w AS (SELECT template_id, version, row_number() OVER (ORDER BY profile_seq DESC) AS back FROM e WHERE template_pos = 0 QUALIFY back <= 20),
known AS (SELECT w.*, r.submission_profile_id, r.fingerprint FROM w LEFT JOIN (SELECT DISTINCT template_id, version, submission_profile_id, fingerprint FROM reviewed) r USING (template_id, version)),
counted AS (SELECT r.*, release_status, coalesce((SELECT count(*) FROM w WHERE w.template_id = r.template_id AND w.version = r.version), 0) AS exact, coalesce((SELECT bool_or(back = 1) FROM w WHERE w.template_id = r.template_id AND w.version = r.version), false) AS last,
  (SELECT count(*) FROM known k WHERE k.submission_profile_id = r.submission_profile_id) AS lineage, (SELECT count(*) FROM known k WHERE k.fingerprint = r.fingerprint) AS alike
  FROM (SELECT DISTINCT template_id, version, submission_profile_id, fingerprint FROM reviewed WHERE list_contains(medium, 'xlsx') AND list_contains(jobs, 'treasury')) r JOIN catalog USING (template_id, version))"""


@query(
    f"""WITH {_RECOMMEND} SELECT row_number() OVER (ORDER BY release_status = 'deprecated', exact > 0, lineage, alike, submission_profile_id, template_id, version) AS rank, template_id, version, release_status, submission_profile_id, fingerprint, exact, lineage, alike,
    list_concat(['reviewed_profile', 'profile_compatible', 'exact_not_recent'], CASE WHEN lineage > 0 THEN ['submission_lineage_repeated'] ELSE [] END, CASE WHEN alike > 0 THEN ['diversity_fingerprint_repeated'] ELSE [] END) AS reasons
    FROM counted WHERE NOT last AND exact = 0"""
)
def recommend(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked reviewed templates for a treasury workbook, those used in the last twenty deliveries left out."""
    entries = durable(_templates(spark, folder))
    key = ["template_id", "version"]
    known = entries.select(*key).distinct().select(*key, F.when(F.col("version").startswith("1."), "deprecated").otherwise("released").alias("release_status"), F.array().cast("array<string>").alias("capabilities"))
    facets = F.create_map(*[x for c in ("medium", "business_function") for x in (F.lit(c), F.col(f"facets.{c}"))])
    empty = F.lit(None).cast("array<struct<facet:string,value:string,change_kind:string>>")
    # a profile delivered again is one profile; maps cannot be compared, their entries can
    profiles = entries.select(*key, "submission_profile_id", "status", "fingerprint", "facets").distinct().select(*key, "submission_profile_id", "status", "fingerprint", facets.alias("facets"), empty.alias("qualified"), F.array().cast("array<string>").alias("material_kinds"))
    history = entries.filter("template_pos = 0").select(F.col("profile_seq").alias("seq"), *key)
    request = catalog.Request(facets={"medium": "xlsx", "business_function": "treasury"}, window=20)
    return catalog.recommend(profiles, known, history, request)


# C, G: fingerprints


@query("SELECT p_partkey, sha256(to_json({'p_brand': p_brand, 'p_size': p_size, 'p_type': p_type})) AS digest FROM part")
def diversity_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    digest = scalars.canonical_hash({c: F.col(c) for c in ("p_type", "p_brand", "p_size")})
    return table(spark, folder, "part").select("p_partkey", digest.alias("digest"))


@query("SELECT p_brand, sha256(string_agg(p_name || chr(0) || sha256(p_type) || chr(10), '' ORDER BY p_name, sha256(p_type))) AS manifest FROM part GROUP BY 1")
def manifest_hash(spark: SparkSession, folder: str) -> DataFrame:
    return scalars.manifests(table(spark, folder, "part").select("p_brand", "p_name", F.sha2("p_type", 256).alias("h")), "p_brand", "p_name", "h")


@query(
    """WITH f AS (SELECT entity_code, coalesce(status_code, '') AS fp, count(*) AS n FROM source_rows WHERE entity_code IS NOT NULL GROUP BY ALL)
    SELECT entity_code, sum(n)::BIGINT AS items, max(n) AS largest, max(n) / sum(n)::DOUBLE AS share FROM f GROUP BY 1 HAVING sum(n) >= 3 AND max(n) / sum(n)::DOUBLE >= 0.55"""
)
def fingerprint_convergence(spark: SparkSession, folder: str) -> DataFrame:
    """Entities most of whose rows look alike: 55 % of them have one status."""
    rows = table(spark, folder, "source_rows").filter("entity_code is not null").select("entity_code", F.lit(1).alias("one"), F.coalesce("status_code", F.lit("")).alias("fp"))
    return integrity.converging(rows, "entity_code", "one", "fp", share=0.55)


# C: texts


@query(r"SELECT source_row_id, token, count(*) AS n FROM (SELECT source_row_id, unnest(list_distinct(regexp_extract_all(description, '\{\{[^{}\r\n]+\}\}|\[\[[^\[\]\r\n]+\]\]|\{%[^%\r\n]+%\}'))) AS token FROM source_rows) GROUP BY ALL")
def token_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "source_rows").select("source_row_id", F.explode(scalars.found_tokens(F.col("description"))).alias("token"))
    return rows.groupBy("source_row_id", "token").agg(F.count(F.lit(1)).alias("n"))


# the phrases are written out here, so that the SQL does not share the code's table
_CODES = {
    "answer_key": r"\b(hidden\s+)?answer\s+key\b",
    "ground_truth": r"\bground\s+truth\b",
    "grading_rubric": r"\b(grading|evaluation)\s+rubric\b",
    "model_answer": r"\bmodel\s+answer\b",
    "prior_submission": r"\bprior\s+submission\b",
    "system_prompt": r"\bsystem\s+prompt\b",
}
_LISTED = lambda words: "list_sort(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{m}') THEN '{m}' END" for m in words) + "], lambda x: x IS NOT NULL))"


@query(
    f"SELECT doc_id, {_LISTED(('approval', 'contextual', 'governing', 'question', 'superseded', 'supporting'))} AS markers, {_LISTED(('answer key', 'calibration target', 'evaluator-facing', 'generator residue', 'prior submission', 'private grading', 'rubric answer'))} AS forbidden, list_sort(list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{c}' END" for c, p in _CODES.items())
    + "], lambda x: x IS NOT NULL)) AS prohibited FROM documents WHERE text IS NOT NULL"
)
def phrase_scan(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, folder, "documents").filter("text is not null")
    return docs.select(
        "doc_id", F.array_sort(scalars.containing(text, scalars.MARKERS)).alias("markers"), F.array_sort(scalars.containing(text, scalars.FORBIDDEN)).alias("forbidden"), F.array_sort(scalars.prohibited(text)).alias("prohibited")
    )


@query(r"SELECT doc_id, len(regexp_extract_all(text, '(?mi)^(from:|sent:|to:|subject:|on .+ wrote:|>)'))::BIGINT AS markers FROM documents WHERE text IS NOT NULL")
def reply_markers(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").filter("text is not null")
    return docs.select("doc_id", scalars.reply_markers(F.col("text")).cast("bigint").alias("markers"))


_HEAD = lambda h: rf"regexp_matches(b, '(?im)^[ \t>]*{h}:[ \t]*\S')"


@query(
    rf"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '(?im)^[ \t]*(-{{2,}}[ \t]*(original|forwarded) message[ \t]*-{{2,}}|begin forwarded message:)[ \t]*\r?$')[2:],
    lambda b: {_HEAD("from")} AND {_HEAD("to")} AND {_HEAD("subject")} AND {_HEAD("(sent|date)")} AND regexp_matches(b, '\r?\n[ \t]*\r?\n\s*\S')))::BIGINT AS messages FROM documents WHERE text IS NOT NULL"""
)
def quoted_messages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").filter("text is not null")
    return docs.select("doc_id", F.size(scalars.quoted_messages(F.col("text"))).cast("bigint").alias("messages"))


@query(r"SELECT source_row_id, trim(regexp_replace(regexp_replace(description, '</?[a-zA-Z][^>]*>', '', 'g'), '[ \t\r\n\f\v]+', ' ', 'g')) AS seen FROM source_rows WHERE description IS NOT NULL")
def visible_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "source_rows").filter("description is not null")
    return rows.select("source_row_id", scalars.visible_text(F.col("description")).alias("seen"))


@query("SELECT lower(trim(status_code)) AS identity, count(DISTINCT status_code) AS spellings, count(*) AS rows FROM source_rows WHERE status_code IS NOT NULL GROUP BY 1")
def identity_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Statuses as identities, with the spellings each has (all of them are ASCII, which SQL can fold alike)."""
    rows = table(spark, folder, "source_rows").filter("status_code is not null").groupBy("status_code").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy(scalars.identity(F.col("status_code")).alias("identity")).agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("rows"))


@query("SELECT event_id, props->>'/k' AS k FROM events")
def json_pointer(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(
    f"""WITH {_JSON}, p AS (SELECT profile_seq, json_extract_string(c, '$.path') AS path FROM cards UNION ALL SELECT profile_seq, json_extract_string(c, '$.path') FROM assets)
    SELECT path, coalesce(NOT regexp_matches(path, '[:\\\\]') AND NOT starts_with(path, '/') AND NOT ends_with(path, '/') AND NOT contains(path, '//') AND NOT list_contains(string_split(path, '/'), '..') AND NOT list_contains(string_split(path, '/'), '.') AND path <> '', false) AS safe, count(*) AS n FROM p WHERE path IS NOT NULL GROUP BY 1"""
)
def path_safety(spark: SparkSession, folder: str) -> DataFrame:
    flat = nested.flatten(table(spark, folder, "profiles").select("profile_seq", "body"), "body", ["profile_seq"], nested.Layout("templates", "template", "template_id", (nested.Child("foundation_card", "foundation_cards", "card_id"), nested.Child("native_asset", "native_assets", "path")), ("path",)))
    paths = flat.filter("kind <> 'template' and path is not null").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return paths.select("path", scalars.safe_path(F.col("path")).alias("safe"), "n")


# F, G: integrity


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE coalesce(n, 0) <> 1")
def exactly_once(spark: SparkSession, folder: str) -> DataFrame:
    have = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return integrity.not_exactly_once(table(spark, folder, "customer"), have, ["c_custkey"])


_EDGES = (("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"))


@query(" UNION ALL ".join(f"SELECT '{c}.{k}' AS edge, count(*) AS orphans FROM {c} WHERE {k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} WHERE {q} = {k})" for c, k, p, q in _EDGES))
def orphan_rows(spark: SparkSession, folder: str) -> DataFrame:
    def edge(child: str, key: str, parent: str, to: str) -> DataFrame:
        rows = table(spark, folder, child).filter(F.col(key).isNotNull()).select(F.col(key).alias("k"))
        lost = integrity.unmatched(rows, table(spark, folder, parent).select(F.col(to).alias("k")), ["k"])
        return lost.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(f"{child}.{key}").alias("edge"), "orphans")

    return findings.together([edge(*e) for e in _EDGES])


@query("SELECT l_partkey AS key, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def functional_dependency(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("key"), "l_suppkey")
    return integrity.broken_dependency(lines, "key", "l_suppkey")


@query(
    f"""WITH {_JSON}, refs AS (SELECT profile_seq, template_pos, pos AS child_pos, json_extract_string(c, '$.card_id') AS path, json_extract_string(c, '$.sha256') AS sha256 FROM cards WHERE json_extract_string(c, '$.card_id') IS NOT NULL),
    held AS (SELECT card_id AS path, min(source_sha256) AS actual FROM foundation_cards WHERE card_id IS NOT NULL AND source_sha256 IS NOT NULL GROUP BY 1)
    SELECT profile_seq, template_pos, child_pos, refs.path, sha256, CASE WHEN actual IS NULL THEN 'missing' ELSE 'hash_differs' END AS defect FROM refs LEFT JOIN held USING (path) WHERE actual IS NULL OR sha256 IS DISTINCT FROM actual"""
)
def bound_references(spark: SparkSession, folder: str) -> DataFrame:
    """Cards that profiles bind by hash, against the cards' own hashes."""
    layout = nested.Layout("templates", "template", "template_id", (nested.Child("foundation_card", "foundation_cards", "card_id"),), ("sha256",))
    flat = nested.flatten(table(spark, folder, "profiles").select("profile_seq", "body"), "body", ["profile_seq"], layout).filter("kind = 'foundation_card' and child_key is not null")
    refs = flat.select("profile_seq", F.col("parent_pos").alias("template_pos"), "child_pos", F.col("child_key").alias("path"), "sha256")
    held = table(spark, folder, "foundation_cards").filter("card_id is not null and source_sha256 is not null").groupBy(F.col("card_id").alias("path")).agg(F.min("source_sha256").alias("sha256"))
    return integrity.bound_references(refs, held)


@query(
    f"""WITH {_JSON}, u AS (SELECT DISTINCT trim(json_extract_string(c, '$.blueprint_id')) AS blueprint_id FROM prints), r AS (SELECT DISTINCT blueprint_id FROM blueprints)
    SELECT blueprint_id, 'unregistered' AS side FROM u WHERE blueprint_id IS NOT NULL AND blueprint_id NOT IN (SELECT blueprint_id FROM r WHERE blueprint_id IS NOT NULL)
    UNION ALL SELECT blueprint_id, 'unused' FROM r WHERE blueprint_id IS NOT NULL AND blueprint_id NOT IN (SELECT blueprint_id FROM u WHERE blueprint_id IS NOT NULL)"""
)
def registry_match(spark: SparkSession, folder: str) -> DataFrame:
    layout = nested.Layout("templates", "template", "template_id", (nested.Child("blueprint", "blueprint", "blueprint_id"),))
    flat = nested.flatten(table(spark, folder, "profiles").select("profile_seq", "body"), "body", ["profile_seq"], layout).filter("kind = 'blueprint' and child_key is not null")
    return integrity.registry_differences(flat.select(F.trim("child_key").alias("blueprint_id")), table(spark, folder, "blueprints").filter("blueprint_id is not null"), ["blueprint_id"])


@query("SELECT file_name, md5(raw_line) AS digest, count(*) AS n FROM raw_source_lines WHERE raw_line IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def resent_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that came more than once in a file. They are grouped by 256 bits of hash, so no text is shuffled."""
    lines = table(spark, folder, "raw_source_lines").filter("raw_line is not null").select("file_name", F.sha2("raw_line", 256).alias("h"), F.md5("raw_line").alias("digest"))
    return carriers.duplicate_rows(lines).select("file_name", "digest", "n")


@query(f"WITH {_LINES} SELECT file_name, count(*) AS lines, count(*) FILTER (line_id IN (SELECT line_id FROM reasons)) AS rejected FROM lines GROUP BY 1")
def line_structure(spark: SparkSession, folder: str) -> DataFrame:
    """How files' lines load: lines, rejects and distinct reasons by file."""
    done = malformed.classify(table(spark, folder, "raw_source_lines").select("file_name", "raw_line"), "raw_line")
    return done.groupBy("file_name").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.size("reasons") > 0).alias("rejected"))
