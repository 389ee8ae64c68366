"""Queries of the record problems (1, 2, 3 and 5) and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import compare, malformed, nested, orphans
from tallyforge.session import durable
from tallyforge.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

FIELDS = ("entity_code", "account_code", "transaction_date", "description", "debit", "credit", "status_code")
KEYS_ONLY = nested.Layout(nested.PROFILE.parents, nested.PROFILE.parent_kind, nested.PROFILE.parent_key, nested.PROFILE.children)
REFERRING = nested.Layout("templates", "template", "template_id", tuple(c for c in nested.PROFILE.children if c.kind in ("foundation_card", "blueprint")))


# 1: rows that fail to parse


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "raw_source_lines").select("line_id", "raw_line")
    return malformed.rejected(lines, "raw_line").select("line_id", "reason").distinct()


def p1_rejected_by_file(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "raw_source_lines").select("file_name", "raw_line")
    return malformed.rejected(lines, "raw_line").groupBy("file_name", "reason").agg(F.count(F.lit(1)).alias("n"))


def p1_loaded(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "raw_source_lines").select("line_id", "raw_line")
    rows = malformed.loaded(lines, "raw_line")
    return rows.withColumn("debit", F.col("debit").cast("double")).withColumn("credit", F.col("credit").cast("double"))


_FITS = "regexp_full_match({}, '-?0*[0-9]{{0,16}}([.][0-9]{{0,2}}0*)?')"
_BARE = r'"(?:[^"]|"")*"|[^",]*'


def _nth(n: int) -> str:
    got = f"regexp_extract(l, '^(?:(?:{_BARE}),){{{n}}}({_BARE})', 1)"
    return f"CASE WHEN {got} LIKE '\"%' THEN replace(substr({got}, 2, length({got}) - 2), '\"\"', '\"') ELSE {got} END"


_LINES = f"""
lines AS (SELECT line_id, file_name, raw_line AS l FROM raw_source_lines),
shape AS (
  SELECT *, coalesce(NOT regexp_full_match(l, '(?:{_BARE})(?:,(?:{_BARE}))*'), false) AS broken,
    coalesce(length(regexp_replace(l, '"(?:[^"]|"")*"', 'Q', 'g')) - length(replace(regexp_replace(l, '"(?:[^"]|"")*"', 'Q', 'g'), ',', '')) + 1, 0) AS n
  FROM lines),
cut AS (
  SELECT *, {_nth(3)} AS d, {_nth(5)} AS dr, {_nth(6)} AS cr FROM shape WHERE NOT broken AND n = 8),
judged AS (
  SELECT *, regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast(d AS DATE) IS NOT NULL AND d NOT LIKE '0000%' AS d_ok,
    regexp_full_match(dr, '-?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)') AS dr_ok,
    regexp_full_match(cr, '-?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)') AS cr_ok FROM cut),
reasons AS (
  SELECT line_id, file_name, 'quoting' AS reason FROM shape WHERE broken
  UNION ALL SELECT line_id, file_name, 'column_count' FROM shape WHERE NOT broken AND n <> 8
  UNION ALL SELECT line_id, file_name, 'transaction_date' FROM judged WHERE NOT d_ok
  UNION ALL SELECT line_id, file_name, 'debit' FROM judged WHERE NOT dr_ok
  UNION ALL SELECT line_id, file_name, 'credit' FROM judged WHERE NOT cr_ok)
"""


# 2: nested records


def _profiles(spark: SparkSession, folder: str, *carry: str) -> DataFrame:
    return table(spark, folder, "profiles").select(*carry, "body")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = nested.flatten(_profiles(spark, folder, "profile_seq"), "body", ["profile_seq"], KEYS_ONLY)
    wanted = F.col("kind").isin("foundation_card", "native_asset") | F.col("kind").startswith("evidence.")
    # a child has one place in one template of one profile, and profile_seq is unique: rows are distinct as they are
    return rows.filter(wanted & F.col("child_key").isNotNull()).withColumnRenamed("parent_pos", "template_pos")


def _flat(kind: str, name: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = nested.children(nested.flatten(_profiles(spark, folder, "profile_seq"), "body", ["profile_seq"]), kind)
        extra = ["version"] if kind == "template" else ["path", "sha256"]
        category = [F.substring_index("kind", ".", -1).alias("category")] if kind.endswith(".") else []
        return rows.select("profile_seq", F.col("parent_pos").alias("template_pos"), *category, "child_pos", F.col("child_key").alias(name), *[c for c in extra if c != name])

    return query


def _each(path: str) -> str:
    """The elements of a JSON array, or the value that stands in its place, with their places."""
    return f"""(SELECT unnest(range(len(es)))::BIGINT AS pos, unnest(es) AS e FROM (SELECT CASE WHEN v IS NULL OR json_type(v) = 'NULL' THEN [] WHEN json_type(v) = 'ARRAY' THEN v::JSON[] ELSE [v] END AS es FROM (SELECT {path} AS v)))"""


_JSON = f"""
t AS (SELECT profile_seq, recorded_on, x.pos AS template_pos, x.e AS t FROM profiles, LATERAL {_each("json_extract(body, '$.templates')")} x),
cards AS (SELECT profile_seq, recorded_on, template_pos, x.pos, x.e AS c FROM t, LATERAL {_each("json_extract(t, '$.foundation_cards')")} x),
prints AS (SELECT profile_seq, recorded_on, template_pos, x.pos, x.e AS c FROM t, LATERAL {_each("json_extract(t, '$.blueprint')")} x),
assets AS (SELECT profile_seq, template_pos, x.pos, x.e AS c FROM t, LATERAL {_each("json_extract(t, '$.native_assets')")} x),
ev AS (SELECT profile_seq, template_pos, k, json_extract(json_extract(t, '$.evidence'), k) AS c FROM (SELECT *, unnest(json_keys(t, '$.evidence')) AS k FROM t WHERE json_type(t, '$.evidence') = 'OBJECT'))
"""


# 3: orphan references


def _references(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "source_rows")
    listed = nested.flatten(_profiles(spark, folder, "profile_seq", "recorded_on"), "body", ["profile_seq", "recorded_on"], REFERRING)
    target = F.when(F.col("kind") == "blueprint", "blueprints").when(F.col("kind") == "foundation_card", "foundation_cards")
    named = listed.withColumn("ref_table", target).filter("ref_table is not null")
    # the profiles are parsed once: their few references are kept for the two passes that read them
    held = durable(orphans.references(named, F.col("ref_table"), F.col("child_key"), F.col("recorded_on"), F.col("profile_seq")))
    return orphans.references(rows, "account_map", F.col("account_code"), F.col("transaction_date"), F.col("source_row_id")).unionByName(held)


def _parents(spark: SparkSession, folder: str) -> DataFrame:
    one = lambda name, key: orphans.validity(table(spark, folder, name), name, F.col(key), F.col("added_on"), F.col("removed_on"))
    return one("account_map", "account_code").unionByName(one("blueprints", "blueprint_id")).unionByName(one("foundation_cards", "card_id"))


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphans(_references(spark, folder), _parents(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("ref_table", F.date_format("day", "yyyy-MM").alias("period"), "record_key", "ref_key").distinct()


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.report(_orphans(spark, folder))


_ORPHANS = f"""
{_JSON},
refs AS (
  SELECT 'account_map' AS ref_table, upper(trim(account_code)) AS k, transaction_date AS d, source_row_id AS record_key FROM source_rows
  UNION ALL SELECT 'blueprints', upper(trim(json_extract_string(c, '$.blueprint_id'))), recorded_on, profile_seq::VARCHAR FROM prints
  UNION ALL SELECT 'foundation_cards', upper(trim(json_extract_string(c, '$.card_id'))), recorded_on, profile_seq::VARCHAR FROM cards),
parents AS (
  SELECT 'account_map' AS ref_table, upper(trim(account_code)) AS k, added_on, removed_on FROM account_map
  UNION ALL SELECT 'blueprints', upper(trim(blueprint_id)), added_on, removed_on FROM blueprints
  UNION ALL SELECT 'foundation_cards', upper(trim(card_id)), added_on, removed_on FROM foundation_cards),
orphan AS (
  SELECT DISTINCT ref_table, k AS ref_key, d, record_key FROM refs r WHERE k IS NOT NULL AND d IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM parents p WHERE p.ref_table = r.ref_table AND p.k = r.k AND p.added_on <= r.d AND (p.removed_on IS NULL OR r.d < p.removed_on)))
"""


# 5: two copies


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    types = {"debit": "decimal(38,4)", "credit": "decimal(38,4)"}
    return compare.differences(table(spark, folder, "source_rows"), table(spark, folder, "source_rows_mirror"), "source_row_id", FIELDS, types)


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return p5_found(spark, folder).groupBy("difference").agg(F.count(F.lit(1)).alias("n"))


_DIFFERENCES = f"""
a AS (SELECT DISTINCT source_row_id AS id, {", ".join(FIELDS)} FROM source_rows),
b AS (SELECT DISTINCT source_row_id AS id, {", ".join(FIELDS)} FROM source_rows_mirror),
found AS (
  SELECT id AS source_row_id, 'only_source' AS difference FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.id IS NOT DISTINCT FROM a.id)
  UNION SELECT id, 'only_mirror' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.id IS NOT DISTINCT FROM a.id)
  {" ".join(f"UNION SELECT a.id, '{c}' FROM a JOIN b ON a.id IS NOT DISTINCT FROM b.id WHERE a.{c} IS DISTINCT FROM b.{c}" for c in FIELDS)})
"""

QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_loaded": p1_loaded,
    "p1_rejected_by_file": p1_rejected_by_file,
    "p2_found": p2_found,
    "p2_templates": _flat("template", "template_id"),
    "p2_foundation_cards": _flat("foundation_card", "card_id"),
    "p2_native_assets": _flat("native_asset", "path"),
    "p2_evidence": _flat("evidence.", "sha256"),
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p5_found": p5_found,
    "p5_report": p5_report,
}

_CHILD = "json_extract_string(c, '$.{}')"
_LINK = "profile_seq, template_pos, pos AS child_pos"

SQL = {
    "p1_found": f"WITH {_LINES} SELECT DISTINCT line_id, reason FROM reasons",
    "p1_loaded": f"""WITH {_LINES} SELECT line_id, {_nth(0)} AS source_row_id, {_nth(1)} AS entity_code, {_nth(2)} AS account_code, d::DATE AS transaction_date,
      {_nth(4)} AS description, {_nth(7)} AS status_code,
      CASE WHEN {_FITS.format("dr")} THEN dr::DECIMAL(18,2)::DOUBLE END AS debit, CASE WHEN NOT {_FITS.format("dr")} THEN dr END AS debit_text,
      CASE WHEN {_FITS.format("cr")} THEN cr::DECIMAL(18,2)::DOUBLE END AS credit, CASE WHEN NOT {_FITS.format("cr")} THEN cr END AS credit_text FROM judged WHERE d_ok AND dr_ok AND cr_ok""",
    "p1_rejected_by_file": f"WITH {_LINES} SELECT file_name, reason, count(*) AS n FROM reasons GROUP BY ALL",
    "p2_found": f"""WITH {_JSON}, found AS (
      SELECT profile_seq, template_pos, 'foundation_card' AS kind, pos AS child_pos, {_CHILD.format("card_id")} AS child_key FROM cards
      UNION ALL SELECT profile_seq, template_pos, 'native_asset', pos, CASE json_type(c) WHEN 'VARCHAR' THEN c->>'$' ELSE {_CHILD.format("path")} END FROM assets
      UNION ALL SELECT profile_seq, template_pos, 'evidence.' || k, 0, {_CHILD.format("sha256")} FROM ev)
      SELECT * FROM found WHERE child_key IS NOT NULL""",
    "p2_templates": f"WITH {_JSON} SELECT profile_seq, template_pos, template_pos AS child_pos, t->>'$.template_id' AS template_id, t->>'$.version' AS version FROM t WHERE json_type(t) = 'OBJECT'",
    "p2_foundation_cards": f"WITH {_JSON} SELECT {_LINK}, {_CHILD.format('card_id')} AS card_id, {_CHILD.format('path')} AS path, {_CHILD.format('sha256')} AS sha256 FROM cards",
    "p2_native_assets": f"WITH {_JSON} SELECT {_LINK}, CASE json_type(c) WHEN 'VARCHAR' THEN c->>'$' ELSE {_CHILD.format('path')} END AS path, {_CHILD.format('sha256')} AS sha256 FROM assets",
    "p2_evidence": f"WITH {_JSON} SELECT profile_seq, template_pos, k AS category, 0::BIGINT AS child_pos, {_CHILD.format('sha256')} AS sha256, {_CHILD.format('path')} AS path FROM ev",
    "p3_found": f"WITH {_ORPHANS} SELECT DISTINCT ref_table, strftime(d, '%Y-%m') AS period, record_key, ref_key FROM orphan",
    "p3_report": f"""WITH {_ORPHANS}, known AS (SELECT ref_table, k, min(CASE WHEN removed_on IS NULL OR removed_on > added_on THEN added_on END) AS s FROM parents WHERE k IS NOT NULL GROUP BY ALL)
      SELECT orphan.ref_table, strftime(d, '%Y-%m') AS period, CASE WHEN known.k IS NULL THEN 'missing' WHEN s IS NULL OR s > d THEN 'late' ELSE 'deleted' END AS status,
        count(*) AS orphan_refs, count(DISTINCT ref_key) AS orphan_keys
      FROM orphan LEFT JOIN known ON known.ref_table = orphan.ref_table AND known.k = orphan.ref_key GROUP BY ALL""",
    "p5_found": f"WITH {_DIFFERENCES} SELECT * FROM found",
    "p5_report": f"WITH {_DIFFERENCES} SELECT difference, count(*) AS n FROM found GROUP BY ALL",
}
