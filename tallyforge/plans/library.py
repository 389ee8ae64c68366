"""Queries over a library of linked records, and the SQL they are checked against.

Profiles' templates stand for catalog entries, releases and evidence; ``foundation_cards`` and
``blueprints`` for the records they are bound to. Every query reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import documents, scalars
from tallyforge.operators import carriers, catalog, findings, integrity, library, malformed, nested
from tallyforge.plans.records import _JSON, _LINES, _nth
from tallyforge.plans.reference import _CLEAN, _CONTROLS, QUERIES, SQL, _controls, _money, _rows, query
from tallyforge.session import durable
from tallyforge.sources import carriers as files
from tallyforge.sources.tables import table

CATEGORIES = ("core_integrity", "render", "metadata", "computational", "provenance", "leakage", "authority_separation", "anti_filler")
_LAYOUT = nested.Layout("templates", "template", "template_id", nested.PROFILE.children, ("path", "sha256", "version", "diversity_fingerprint"), ("template_id", "version", "release", "facets", "foundation_cards"))
_PLACE = ["profile_seq", "template_pos"]


def _flat(spark: SparkSession, folder: str) -> DataFrame:
    """All parts of all profiles, each with its template's key, release and facets."""
    rows = nested.flatten(table(spark, folder, "profiles").select("profile_seq", "body"), "body", ["profile_seq"], _LAYOUT)
    return rows.withColumnsRenamed({"parent_pos": "template_pos", "parent_template_id": "template_id", "parent_version": "of_version"}).withColumn("release_id", F.get_json_object("parent_release", "$.release_id"))


def _kind(rows: DataFrame, kind: str) -> DataFrame:
    return rows.filter(F.col("kind") == kind)


_FLAT = f"""{_JSON},
tt AS (SELECT profile_seq, template_pos, t, t->>'$.template_id' AS template_id, t->>'$.version' AS version, t->>'$.release.release_id' AS release_id, t->>'$.release.path' AS release_path, t->>'$.release.sha256' AS release_sha256 FROM t WHERE json_type(t) = 'OBJECT'),
card AS (SELECT tt.*, pos, c->>'$.card_id' AS card_id, c->>'$.path' AS path, c->>'$.sha256' AS sha256 FROM cards JOIN tt USING (profile_seq, template_pos)),
asset AS (SELECT tt.*, pos, CASE json_type(c) WHEN 'VARCHAR' THEN c->>'$' ELSE c->>'$.path' END AS path, c->>'$.sha256' AS sha256 FROM assets JOIN tt USING (profile_seq, template_pos)),
proof AS (SELECT tt.*, k AS category, c->>'$.path' AS path, c->>'$.sha256' AS sha256 FROM ev JOIN tt USING (profile_seq, template_pos))"""
_EIGHT = "(VALUES " + ", ".join(f"('{c}')" for c in CATEGORIES) + ") AS eight(category)"


# F: joins


@query(
    f"""WITH {_JSON}, held AS (SELECT blueprint_id, count(*) AS n FROM (SELECT DISTINCT blueprint_id, schema_version, archetype, name, artifact_type, primary_class FROM blueprints WHERE removed_on IS NULL AND blueprint_id IS NOT NULL) GROUP BY 1),
    refs AS (SELECT profile_seq, template_pos, c->>'$.blueprint_id' AS blueprint_id FROM prints)
    SELECT profile_seq, template_pos, blueprint_id, coalesce(n, 0) AS n FROM refs LEFT JOIN held USING (blueprint_id) WHERE blueprint_id IS NOT NULL AND coalesce(n, 0) <> 1"""
)
def entry_context(spark: SparkSession, folder: str) -> DataFrame:
    """Templates whose blueprint is not found exactly once among those in force."""
    refs = _kind(_flat(spark, folder), "blueprint").filter("child_key is not null").select(*_PLACE, F.col("child_key").alias("blueprint_id"))
    held = table(spark, folder, "blueprints").filter("removed_on is null and blueprint_id is not null").drop("added_on", "removed_on")
    return library.not_one(refs, held, ["blueprint_id"])


@query(
    f"""WITH {_FLAT}, i AS (SELECT profile_seq, template_pos, t, unnest(range(3))::INT AS index FROM tt WHERE json_type(t->'$.facets.medium') = 'ARRAY' OR json_type(t, '$.facets') IS NULL)
    SELECT profile_seq, template_pos, index, CASE WHEN json_type(t->'$.facets.medium') = 'ARRAY' THEN (t->'$.facets.medium')->>index END AS element,
    CASE WHEN json_type(t, '$.facets') IS NULL THEN 'no_holder' WHEN (t->'$.facets.medium')->>index IS NULL THEN 'no_element' END AS defect FROM i"""
)
def element_references(spark: SparkSession, folder: str) -> DataFrame:
    """References by place into arrays of another record: the first three media of each template."""
    templates = _kind(_flat(spark, folder), "template")
    held = templates.filter("parent_facets is not null").select(*_PLACE, F.from_json(F.get_json_object("parent_facets", "$.medium"), "array<string>").alias("medium"))
    refs = templates.select(*_PLACE, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("index"))
    return library.elements(refs, held, _PLACE, "index", "medium")


@query(
    f"""WITH {_FLAT}, used AS (SELECT DISTINCT card_id, path, sha256 FROM card JOIN profiles p USING (profile_seq) WHERE card_id IS NOT NULL AND path IS NOT NULL AND sha256 IS NOT NULL AND coalesce(p.body->>'$.status', '') <> 'reviewed'),
    known AS (SELECT DISTINCT card_id, path, sha256 FROM card JOIN profiles p USING (profile_seq) WHERE card_id IS NOT NULL AND path IS NOT NULL AND sha256 IS NOT NULL AND p.body->>'$.status' = 'reviewed')
    SELECT *, 'unregistered' AS side FROM (FROM used EXCEPT FROM known) UNION ALL SELECT *, 'unused' FROM (FROM known EXCEPT FROM used)"""
)
def invariant_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Card bindings (card, path, hash) of profiles against the registry that reviewed profiles make."""
    key = ["card_id", "path", "sha256"]
    status = F.coalesce(F.get_json_object("body", "$.status"), F.lit(""))
    profiles = table(spark, folder, "profiles").select("profile_seq", (status == "reviewed").alias("reviewed"), "body")
    cards = _kind(nested.flatten(profiles, "body", ["profile_seq", "reviewed"], nested.Layout("templates", "template", "template_id", (nested.Child("foundation_card", "foundation_cards", "card_id"),), ("path", "sha256"))), "foundation_card")
    # both sides come from one pass: a triple's sides are bits
    bits = cards.withColumnRenamed("child_key", "card_id").dropna(subset=key).groupBy(*key).agg(F.bit_or(F.when(F.col("reviewed"), 2).otherwise(1)).alias("m"))
    return bits.filter("m <> 3").select(*key, F.when(F.col("m") == 1, "unregistered").otherwise("unused").alias("side"))


@query(
    f"""WITH {_FLAT} SELECT template_id, field, count(DISTINCT value) AS n FROM (SELECT template_id, unnest([{{'field': 'release_id', 'value': release_id}}, {{'field': 'version', 'value': version}}, {{'field': 'path', 'value': release_path}}, {{'field': 'sha256', 'value': release_sha256}}], recursive := true) FROM tt WHERE template_id IS NOT NULL)
    GROUP BY ALL HAVING count(DISTINCT value) > 1"""
)
def release_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Templates that different deliveries bind to different releases, versions, paths or bytes."""
    r = _kind(_flat(spark, folder), "release").filter("template_id is not null").select("template_id", F.col("child_key").alias("release_id"), F.col("of_version").alias("version"), "path", "sha256")
    return library.conflicts(r, ["template_id"], ["release_id", "version", "path", "sha256"])


@query(f"WITH {_FLAT} SELECT release_id, field, count(DISTINCT sha256) AS n FROM (SELECT release_id, 'sha256' AS field, sha256 FROM proof UNION ALL SELECT release_id, 'sha256', sha256 FROM asset) WHERE release_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT sha256) > 1")
def evidence_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """How many different files a release's evidence and assets are bound to by hash."""
    rows = _flat(spark, folder).filter("(kind like 'evidence.%' or kind = 'native_asset') and release_id is not null")
    return library.conflicts(rows, ["release_id"], ["sha256"])


_HOMES = {
    "foundation_card": ("card", "card_id", "'library/foundations/' || card_id || '.json'"),
    "evidence": ("proof", "release_id", "'evidence/template-releases/' || release_id || '/technical-' || category || '.json'"),
    "native_asset": ("asset", "template_id", "'library/templates/' || template_id || '/' || version || '/' || regexp_extract(path, '[^/]+$')"),
}


@query(f"WITH {_FLAT} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS bindings, count(*) FILTER (path = {home}) AS in_place FROM {t} WHERE path IS NOT NULL AND {i} IS NOT NULL" for k, (t, i, home) in _HOMES.items()))
def evidence_bindings(spark: SparkSession, folder: str) -> DataFrame:
    """Bound files by kind, and those that lie where their own keys say."""
    text = lambda *parts: F.concat(*[F.lit(p) if p.endswith(("/", "-", ".json")) else F.col(p) for p in parts])
    rows = _flat(spark, folder).withColumn("category", F.expr("substring(kind, 10)")).withColumn("base", F.substring_index(F.coalesce("path", "child_key"), "/", -1))
    kind = F.when(F.col("kind").startswith("evidence."), "evidence").otherwise(F.col("kind"))
    home = (
        F.when(kind == "foundation_card", text("library/foundations/", "child_key", ".json"))
        .when(kind == "evidence", text("evidence/template-releases/", "release_id", "/technical-", "category", ".json"))
        .otherwise(text("library/templates/", "template_id", "/", "of_version", "/", "base"))
    )
    path = F.when(kind == "native_asset", F.col("child_key")).otherwise(F.col("path"))
    bound = rows.filter(kind.isin(*_HOMES) & path.isNotNull() & home.isNotNull()).select(kind.alias("kind"), (path == home).alias("same"))
    return bound.groupBy("kind").agg(F.count(F.lit(1)).alias("bindings"), F.count_if("same").alias("in_place"))


@query(
    f"""WITH {_FLAT}, n AS (SELECT profile_seq, template_pos, category, count(*) AS n FROM proof WHERE sha256 IS NOT NULL GROUP BY ALL)
    SELECT profile_seq, template_pos, category, coalesce(n, 0) AS n FROM tt CROSS JOIN {_EIGHT} LEFT JOIN n USING (profile_seq, template_pos, category) WHERE coalesce(n, 0) <> 1"""
)
def evidence_complete(spark: SparkSession, folder: str) -> DataFrame:
    """Categories of evidence that a template does not have exactly once."""
    rows = _flat(spark, folder)
    return library.incomplete(_kind(rows, "template"), _proofs(rows), _PLACE, "category", CATEGORIES)


def _proofs(rows: DataFrame) -> DataFrame:
    return rows.filter("kind like 'evidence.%' and child_key is not null").withColumn("category", F.expr("substring(kind, 10)"))


@query(
    f"""WITH {_FLAT}, keys AS (SELECT template_id, version, count(*) AS deliveries FROM tt WHERE template_id IS NOT NULL AND version IS NOT NULL GROUP BY ALL),
    n AS (SELECT template_id, version, category, count(*) AS n FROM proof WHERE sha256 IS NOT NULL AND category IN (SELECT category FROM {_EIGHT}) GROUP BY ALL)
    SELECT template_id, version, deliveries, count(*) FILTER (n >= deliveries) AS categories, CASE WHEN count(*) FILTER (n >= deliveries) = 8 THEN 'PASS' ELSE 'FAIL' END AS status FROM keys LEFT JOIN n USING (template_id, version) GROUP BY ALL"""
)
def technical_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """All-or-nothing over eight categories: those that every delivery of a template has evidence for."""
    rows = _flat(spark, folder).filter("template_id is not null and of_version is not null")
    key = ["template_id", F.col("of_version").alias("version")]
    marked = rows.filter((F.col("kind") == "template") | (F.col("kind").startswith("evidence.") & F.col("child_key").isNotNull()))
    counts = marked.groupBy(*key).agg(F.count_if(F.col("kind") == "template").alias("deliveries"), *[F.count_if(F.col("kind") == f"evidence.{c}").alias(c) for c in CATEGORIES])
    n = sum((F.when((F.col(c) >= F.col("deliveries")) & (F.col(c) > 0), 1).otherwise(0) for c in CATEGORIES), F.lit(0)).cast("bigint")
    return counts.select("template_id", "version", "deliveries", n.alias("categories"), F.when(n == 8, "PASS").otherwise("FAIL").alias("status"))


# J: composed


@query(
    f"""WITH {_FLAT},
    f AS (
      SELECT 'card_unknown' AS rule FROM card WHERE card_id IS NOT NULL AND card_id NOT IN (SELECT card_id FROM foundation_cards WHERE card_id IS NOT NULL)
      UNION ALL SELECT 'card_hash_differs' FROM card WHERE card_id IN (SELECT card_id FROM foundation_cards WHERE card_id IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM foundation_cards k WHERE k.card_id = card.card_id AND k.source_sha256 = card.sha256)
      UNION ALL SELECT 'card_not_reviewed' FROM card WHERE card_id IN (SELECT card_id FROM foundation_cards GROUP BY 1 HAVING count(*) FILTER (status = 'reviewed') = 0)
      UNION ALL SELECT 'blueprint_unknown' FROM prints WHERE c->>'$.blueprint_id' IS NOT NULL AND c->>'$.blueprint_id' NOT IN (SELECT blueprint_id FROM blueprints WHERE blueprint_id IS NOT NULL)
      UNION ALL SELECT 'evidence_missing' FROM tt CROSS JOIN {_EIGHT} LEFT JOIN (SELECT profile_seq, template_pos, category, 1 AS one FROM proof WHERE sha256 IS NOT NULL) USING (profile_seq, template_pos, category) WHERE one IS NULL
      UNION ALL SELECT 'asset_not_owned' FROM asset WHERE path IS NOT NULL AND NOT starts_with(path, concat('library/templates/', template_id, '/', version, '/'))
      UNION ALL SELECT 'asset_unbound' FROM asset WHERE path IS NOT NULL AND sha256 IS NULL
      UNION ALL SELECT 'template_repeated' FROM (SELECT 1 FROM tt WHERE template_id IS NOT NULL AND version IS NOT NULL GROUP BY profile_seq, template_id, version HAVING count(*) > 1)
      UNION ALL SELECT 'facet_unknown' FROM (SELECT DISTINCT profile_seq, template_pos, unnest((t->'$.facets.medium')::VARCHAR[]) AS m FROM tt) WHERE m NOT IN (SELECT artifact_type FROM blueprints WHERE artifact_type IS NOT NULL)
      UNION ALL SELECT 'fingerprint_missing' FROM tt WHERE t->>'$.diversity_fingerprint' IS NULL)
    SELECT rule, count(*) AS n FROM f GROUP BY 1"""
)
def profile_findings(spark: SparkSession, folder: str) -> DataFrame:
    """All rules over profiles at once, counted by rule."""
    return _profile_findings(spark, folder).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def _profile_findings(spark: SparkSession, folder: str) -> DataFrame:
    rows = durable(_flat(spark, folder))  # parsed once for all rules
    who, place = F.col("profile_seq"), F.col("template_pos")
    cards = _kind(rows, "foundation_card").filter("child_key is not null").withColumnRenamed("child_key", "card_id")
    held = table(spark, folder, "foundation_cards").filter("card_id is not null")
    blueprints = table(spark, folder, "blueprints")
    known = cards.join(held.groupBy("card_id").agg(F.max(F.coalesce(F.col("status") == "reviewed", F.lit(False))).alias("reviewed")), "card_id", "left")
    hashes = held.filter("source_sha256 is not null").select("card_id", F.col("source_sha256").alias("sha256"), F.lit(True).alias("same")).distinct()
    bound = known.filter("reviewed is not null").join(hashes, ["card_id", "sha256"], "left")
    prints = _kind(rows, "blueprint").filter("child_key is not null").withColumnRenamed("child_key", "blueprint_id")
    assets = _kind(rows, "native_asset").filter("child_key is not null")
    home = F.concat(F.lit("library/templates/"), F.coalesce("template_id", F.lit("")), F.lit("/"), F.coalesce("of_version", F.lit("")))
    templates = _kind(rows, "template")
    media = templates.select(*_PLACE, F.explode(F.from_json(F.get_json_object("parent_facets", "$.medium"), "array<string>")).alias("artifact_type")).filter("artifact_type is not null").distinct()
    parts = [
        findings.finding(known.filter("reviewed is null"), "card_unknown", who, F.col("card_id"), place),
        findings.finding(bound.filter("same is null"), "card_hash_differs", who, F.col("card_id"), place),
        findings.finding(known.filter("not reviewed"), "card_not_reviewed", who, F.col("card_id"), place),
        findings.finding(integrity.unmatched(prints, blueprints, ["blueprint_id"]), "blueprint_unknown", who, F.col("blueprint_id"), place),
        findings.finding(library.incomplete(templates, _proofs(rows), _PLACE, "category", CATEGORIES).filter("n = 0"), "evidence_missing", who, F.col("category"), place),
        findings.finding(assets.filter(~F.coalesce(F.startswith("child_key", F.concat(home, F.lit("/"))), F.lit(False))), "asset_not_owned", who, F.col("child_key"), place),
        findings.finding(assets.filter("sha256 is null"), "asset_unbound", who, F.col("child_key"), place),
        findings.finding(catalog.key_defects(templates.filter("template_id is not null and of_version is not null"), ("profile_seq", "template_id", "of_version")), "template_repeated", who, F.col("template_id")),
        findings.finding(integrity.unmatched(media, blueprints, ["artifact_type"]), "facet_unknown", who, F.col("artifact_type"), place),
        findings.finding(templates.filter("diversity_fingerprint is null"), "fingerprint_missing", who, F.lit(""), place),
    ]
    return findings.together(parts)


@query(
    f"""WITH {_FLAT}, f AS (SELECT profile_seq, template_pos, t, (t->'$.facets.business_function')::VARCHAR[] AS business_function, (t->'$.facets.lifecycle')::VARCHAR[] AS lifecycle, (t->'$.facets.medium')::VARCHAR[] AS medium, (t->'$.facets.organization_form')::VARCHAR[] AS organization_form FROM tt WHERE json_type(t, '$.facets') = 'OBJECT'),
    ids AS (SELECT profile_seq, template_pos, list_sort(list(DISTINCT card_id) FILTER (card_id IS NOT NULL)) AS ids FROM card GROUP BY ALL)
    SELECT profile_seq, template_pos, sha256(to_json({{'diversity_dimensions': {{'business_function': business_function, 'lifecycle': lifecycle, 'medium': medium, 'organization_form': organization_form}}, 'semantic_pattern_ids': coalesce(ids, [])}})) AS derived,
    t->>'$.diversity_fingerprint' AS stored FROM f LEFT JOIN ids USING (profile_seq, template_pos)"""
)
def fingerprint_check(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of templates, derived again from their facets and the cards they use, beside the stored ones."""
    templates = _kind(_flat(spark, folder), "template").filter("parent_facets is not null")
    facets = F.from_json("parent_facets", "struct<business_function:array<string>,lifecycle:array<string>,medium:array<string>,organization_form:array<string>>")
    cards = F.coalesce("parent_foundation_cards", F.lit("[]"))
    # one card may stand alone in place of its array
    listed = F.from_json(F.when(F.startswith(F.ltrim(cards), F.lit("[")), cards).otherwise(F.concat(F.lit("["), cards, F.lit("]"))), "array<struct<card_id:string>>")
    ids = F.filter(F.transform(listed, lambda c: c["card_id"]), lambda i: i.isNotNull())
    dims = {c: F.col(f"f.{c}") for c in ("business_function", "lifecycle", "medium", "organization_form")}
    step = templates.select(*_PLACE, "diversity_fingerprint", facets.alias("f"), F.coalesce(ids, F.array().cast("array<string>")).alias("ids"))
    return step.select(*_PLACE, scalars.fingerprint(dims, F.col("ids")).alias("derived"), F.col("diversity_fingerprint").alias("stored"))


@query(
    f"""WITH {_FLAT} SELECT profile_seq, template_pos, pos AS child_pos, path, coalesce(NOT regexp_matches(path, '[:\\\\]') AND NOT contains(path, '//') AND NOT list_contains(string_split(path, '/'), '..') AND NOT list_contains(string_split(path, '/'), '.') AND NOT ends_with(path, '/')
    AND starts_with(path, 'library/templates/' || template_id || '/1.'), false) AS owned FROM asset WHERE path IS NOT NULL"""
)
def asset_ownership(spark: SparkSession, folder: str) -> DataFrame:
    """Assets, and whether they lie safely below the folder of their template's first major version."""
    assets = _kind(_flat(spark, folder), "native_asset").filter("child_key is not null")
    minor = F.regexp_extract("child_key", r"\A[^/]*/[^/]*/[^/]*/(1\.[^/]*)/", 1)
    home = F.concat(F.lit("library/templates/"), F.col("template_id"), F.lit("/"), F.when(minor != "", minor))
    return assets.select(*_PLACE, "child_pos", F.col("child_key").alias("path"), F.coalesce(library.owned(F.col("child_key"), home), F.lit(False)).alias("owned"))


@query(
    f"""WITH {_FLAT}, d AS (SELECT release_id, path, count(DISTINCT sha256) AS hashes, min(sha256) AS sha256 FROM asset WHERE release_id IS NOT NULL AND path IS NOT NULL GROUP BY ALL)
    SELECT release_id, path, sha256, CASE WHEN hashes = 0 THEN 'unbound' WHEN hashes > 1 THEN 'hash_conflict' END AS defect FROM d"""
)
def release_assets(spark: SparkSession, folder: str) -> DataFrame:
    """Each release's assets with their hash, and what is wrong with the binding."""
    assets = _kind(_flat(spark, folder), "native_asset").filter("child_key is not null and release_id is not null")
    distinct = assets.select("release_id", F.col("child_key").alias("path"), "sha256").distinct()
    held = distinct.groupBy("release_id", "path").agg(F.count("sha256").alias("n"), F.min("sha256").alias("sha256"))
    return held.select("release_id", "path", "sha256", F.when(F.col("n") == 0, "unbound").when(F.col("n") > 1, "hash_conflict").alias("defect"))


@query(
    f"""WITH {_FLAT}, good AS (SELECT release_id FROM (SELECT DISTINCT release_id, path, sha256, regexp_extract(path, '[^/]+$') AS base FROM asset WHERE release_id IS NOT NULL AND path IS NOT NULL) GROUP BY 1 HAVING count(*) = count(DISTINCT base) AND count(*) = count(sha256)),
    one AS (SELECT min(release_id) AS release_id FROM good)
    SELECT DISTINCT path AS source, 'work/copy/' || regexp_extract(path, '[^/]+$') AS target, sha256 FROM asset JOIN one USING (release_id) WHERE path IS NOT NULL"""
)
def instantiate(spark: SparkSession, folder: str) -> DataFrame:
    """The copies that instantiate the first release whose assets are all bound, each to a name of its own."""
    assets = _kind(_flat(spark, folder), "native_asset").filter("child_key is not null and release_id is not null").select("release_id", F.col("child_key").alias("path"), "sha256").distinct()
    base = F.substring_index("path", "/", -1)
    good = assets.groupBy("release_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(base).alias("names"), F.count("sha256").alias("bound")).filter("n = names and n = bound")
    first = good.agg(F.min("release_id").alias("r")).first().r
    chosen = assets.filter(F.col("release_id") == first)
    return library.instantiation(chosen, "work/copy", {"synthetic": True, "copy": True, "reuse": True}, "profiles") if first is not None else chosen.select(F.col("path").alias("source"), F.col("path").alias("target"), "sha256")


@query(
    f"""WITH {_FLAT}, r AS (SELECT profile_seq, template_pos, release_id AS name, sha256(to_json({{'path': release_path, 'release_id': release_id, 'sha256': release_sha256, 'template_id': template_id, 'version': version}})) AS sha256 FROM tt WHERE release_id IS NOT NULL),
    first AS (SELECT name, arg_min(sha256, profile_seq * 1000000 + template_pos) AS held FROM r GROUP BY 1)
    SELECT DISTINCT name, r.sha256, CASE WHEN r.sha256 = held THEN 'identical' ELSE 'different' END AS state FROM r JOIN first USING (name)"""
)
def release_records(spark: SparkSession, folder: str) -> DataFrame:
    """Releases assembled as records: does each delivery make the bytes that the first one made?"""
    r = _kind(_flat(spark, folder), "release").filter("child_key is not null")
    fields = {"release_id": F.col("child_key"), "path": F.col("path"), "sha256": F.col("sha256"), "template_id": F.col("template_id"), "version": F.col("of_version")}
    made = library.records(r.select(*_PLACE, "child_key", "path", "sha256", "template_id", "of_version").withColumnRenamed("sha256", "bound"), F.col("child_key"), fields | {"sha256": F.col("bound")})
    held = made.groupBy("name").agg(F.min_by("sha256", F.struct(*_PLACE)).alias("held"))
    distinct = made.select("name", "sha256").distinct().join(held, "name")
    return distinct.select("name", "sha256", F.when(F.col("sha256") == F.col("held"), "identical").otherwise("different").alias("state"))


@query(
    f"""WITH {_FLAT}, a AS (SELECT profile_seq, template_pos, pos AS place, path AS actual FROM asset), e AS (SELECT profile_seq, template_pos, row_number() OVER (PARTITION BY profile_seq, template_pos ORDER BY path NULLS LAST, pos) - 1 AS place, path AS expected FROM asset)
    SELECT profile_seq, template_pos, place, expected, actual FROM e FULL JOIN a USING (profile_seq, template_pos, place) WHERE expected IS DISTINCT FROM actual"""
)
def render_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Places at which a template's assets are not listed in the order of their paths."""
    assets = _kind(_flat(spark, folder), "native_asset").select("profile_seq", "template_pos", F.col("child_pos").alias("place"), F.col("child_key").alias("path"))
    order = Window.partitionBy(*_PLACE).orderBy(F.col("path").asc_nulls_last(), "place")  # a template's own assets
    key = F.struct(*_PLACE)
    wanted = assets.select(key.alias("k"), (F.row_number().over(order) - 1).cast("bigint").alias("place"), "path")
    differing = integrity.list_differences(wanted, assets.select(key.alias("k"), "place", "path"), "k", "place", "path")
    return differing.select("k.profile_seq", "k.template_pos", "place", "expected", "actual")


@query(
    """WITH r AS (SELECT DISTINCT source_row_id, entity_code, account_code, transaction_date, description, debit, credit, status_code FROM source_rows),
    d AS (SELECT coalesce(entity_code, '') AS descriptor, coalesce(account_code, '') AS name, 2 AS min_rows, 25 AS max_rows, count(*) FILTER (status_code = 'POSTED') AS reference_rows, count(*) AS expanded_rows FROM r GROUP BY ALL)
    SELECT descriptor, name, unnest(list_filter([CASE WHEN min_rows > max_rows THEN 'bounds_reversed' END, CASE WHEN reference_rows < min_rows THEN 'reference_below_minimum' END, CASE WHEN reference_rows >= expanded_rows THEN 'reference_not_below_expanded' END, CASE WHEN expanded_rows > max_rows THEN 'expanded_beyond_capacity' END], lambda x: x IS NOT NULL)) AS problem FROM d"""
)
def descriptor_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Bounds of declared tables: each entity declares one for each of its accounts."""
    by = _rows(spark, folder).groupBy(F.coalesce("entity_code", F.lit("")).alias("descriptor"), F.coalesce("account_code", F.lit("")).alias("name"))
    tables = by.agg(F.count_if(F.col("status_code") == "POSTED").alias("reference_rows"), F.count(F.lit(1)).alias("expanded_rows")).withColumns({"min_rows": F.lit(2), "max_rows": F.lit(25)})
    return library.descriptor_findings(tables)


@query(
    f"""WITH {_LINES}, ok AS (SELECT * FROM judged WHERE d_ok AND dr_ok AND cr_ok), bad AS (SELECT DISTINCT line_id FROM reasons)
    SELECT 'lines' AS metric, count(*)::VARCHAR AS value FROM lines UNION ALL SELECT 'rejected', count(*)::VARCHAR FROM bad UNION ALL SELECT 'loaded', count(*)::VARCHAR FROM ok
    UNION ALL SELECT 'debit', sum(dr::DECIMAL(18,2))::VARCHAR FROM ok UNION ALL SELECT 'credit', sum(cr::DECIMAL(18,2))::VARCHAR FROM ok UNION ALL SELECT 'dates', count(DISTINCT d)::VARCHAR FROM ok"""
)
def population_build(spark: SparkSession, folder: str) -> DataFrame:
    """A population built from raw lines, and what it must come to: lines in, rows out, sums and dates."""
    done = malformed.classify(table(spark, folder, "raw_source_lines").select("line_id", "raw_line"), "raw_line")
    good = F.size("reasons") == 0
    return library.measured(done, lines=F.count(F.lit(1)), rejected=F.count_if(~good), loaded=F.count_if(good), debit=F.sum("debit"), credit=F.sum("credit"), dates=F.count_distinct("transaction_date"))


@query(
    """WITH a AS (SELECT DISTINCT source_row_id, entity_code, account_code, transaction_date, description, debit, credit, status_code FROM source_rows), b AS (SELECT DISTINCT source_row_id, entity_code, account_code, transaction_date, description, debit, credit, status_code FROM source_rows_mirror),
    m AS (SELECT 'rows' AS metric, (SELECT count(*) FROM a)::VARCHAR AS expected, (SELECT count(*) FROM b)::VARCHAR AS observed UNION ALL SELECT 'debit', (SELECT sum(debit)::DECIMAL(38,2) FROM a)::VARCHAR, (SELECT sum(debit)::DECIMAL(38,2) FROM b)::VARCHAR
    UNION ALL SELECT 'entities', (SELECT count(DISTINCT entity_code) FROM a)::VARCHAR, (SELECT count(DISTINCT entity_code) FROM b)::VARCHAR) SELECT * FROM m WHERE expected IS DISTINCT FROM observed"""
)
def population_verify(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of a population against those of its rebuild."""
    of = lambda df: library.measured(df, rows=F.count(F.lit(1)), debit=F.sum("debit").cast("decimal(38,2)"), entities=F.count_distinct("entity_code"))
    return library.verified(of(_rows(spark, folder)), of(table(spark, folder, "source_rows_mirror").drop("loaded_at").distinct()))


@query("SELECT coalesce(entity_code, '') AS entity_code, CASE max(CASE WHEN status_code IN ('POSTED', 'CLEARED') THEN 0 WHEN status_code = 'REVERSED' THEN 2 ELSE 1 END) WHEN 0 THEN 'PASS' WHEN 1 THEN 'CANNOT_CHECK' ELSE 'INCOMPATIBLE' END AS state FROM source_rows GROUP BY 1")
def status_fold(spark: SparkSession, folder: str) -> DataFrame:
    """The gravest state of each entity's rows; statuses that say nothing cannot be checked."""
    state = F.when(F.col("status_code").isin("POSTED", "CLEARED"), "PASS").when(F.col("status_code") == "REVERSED", "INCOMPATIBLE").otherwise("unknown")
    return library.folded(table(spark, folder, "source_rows").select(F.coalesce("entity_code", F.lit("")).alias("entity_code"), state.alias("state")), ["entity_code"], "state")


@query("SELECT p_partkey, CASE WHEN p_type IS NULL OR trim(p_type) = '' THEN 'CANNOT_CHECK' WHEN split_part(p_brand, '#', 2) = p_size::VARCHAR THEN 'PASS' ELSE 'INCOMPATIBLE' END AS exact, CASE WHEN p_size IS NULL THEN 'CANNOT_CHECK' WHEN p_size = 1 THEN 'PASS' ELSE 'INCOMPATIBLE' END AS near FROM part")
def version_states(spark: SparkSession, folder: str) -> DataFrame:
    """Versions against wanted ones, equal or by their leading parts."""
    size = F.col("p_size").cast("string")
    exact = library.version_state(F.when(F.trim("p_type") != "", size), F.substring_index("p_brand", "#", -1))
    return table(spark, folder, "part").select("p_partkey", exact.alias("exact"), library.version_state(F.concat(size, F.lit(".3")), F.lit("1"), exact=False).alias("near"))


# A, C, D: carriers, documents, scalars


@query(
    f"""WITH {_LINES}, w AS (SELECT file_name, l, CASE WHEN broken THEN NULL ELSE n END AS width FROM shape)
    SELECT file_name, count(*) + 1 AS rows, greatest(max(width), 8) AS max_width, count(*) FILTER (coalesce(l, '') = '') AS blank_rows, count(*) FILTER (width IS DISTINCT FROM 8) AS ragged FROM w GROUP BY 1"""
)
def carrier_shape(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (the header counted), widest row, blank rows and rows not of the header's width, by file."""
    lines = table(spark, folder, "raw_source_lines").select("file_name", "raw_line")
    text = F.col("raw_line")
    quoted = text.contains('"')
    fields = F.when(text.isNull(), F.lit(0)).when(quoted, F.size(malformed.split_quoted(text))).otherwise(F.size(F.split(text, ",", -1)))
    width = F.when(~F.coalesce(quoted & malformed.quoting_broken(text), F.lit(False)), fields)
    return lines.select("file_name", width.alias("w"), (F.coalesce(text, F.lit("")) == "").alias("blank")).groupBy("file_name").agg(
        (F.count(F.lit(1)) + 1).alias("rows"), F.greatest(F.max("w"), F.lit(8)).cast("bigint").alias("max_width"), F.count_if("blank").alias("blank_rows"), F.count_if(~F.col("w").eqNullSafe(F.lit(8))).alias("ragged")
    )


@query(
    """WITH x AS (SELECT 'profiles' AS carrier, body AS v FROM profiles UNION ALL SELECT 'captured_entries', record_text FROM captured_entries UNION ALL SELECT 'events', props FROM events)
    SELECT carrier, count(*) AS texts, count(*) FILTER (coalesce(json_valid(v) AND json_type(CASE WHEN json_valid(v) THEN v END) = 'OBJECT', false)) AS objects FROM x GROUP BY 1"""
)
def json_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that are whole JSON objects, by carrier; each text is a line of its carrier."""
    one = lambda name, c: table(spark, folder, name).select(F.lit(name).alias("carrier"), F.col(c).alias("v"))
    rows = one("profiles", "body").unionByName(one("captured_entries", "record_text")).unionByName(one("events", "props"))
    return documents.object_flags(rows, "v").groupBy("carrier").agg(F.count(F.lit(1)).alias("texts"), F.count_if("is_object").alias("objects"))


_POINTERS = ("/submission_profile_id", "/templates/0/template_id", "/templates/1/evidence/render/sha256", "/templates/0/facets/medium/1", "/reuse_policy/material_change_kinds/0", "/reuse_policy/block_consecutive_exact")


@query("SELECT profile_seq, pointer, json_extract_string(body, pointer) AS value FROM profiles CROSS JOIN (VALUES " + ", ".join(f"('{p}')" for p in _POINTERS) + ") AS x(pointer)")
def json_pointers(spark: SparkSession, folder: str) -> DataFrame:
    """What JSON pointers find in each profile; null where they lead nowhere."""
    return documents.pointed(table(spark, folder, "profiles").select("profile_seq", "body"), "body", ["profile_seq"], _POINTERS)


@query(
    """SELECT b.blueprint_id, rule, detail FROM blueprints b, LATERAL (SELECT 'field_blank' AS rule, c AS detail FROM (VALUES ('name', name), ('archetype', archetype)) v(c, x) WHERE coalesce(trim(x), '') = ''
    UNION ALL SELECT 'value_not_allowed', concat_ws('=', 'artifact_type', artifact_type) WHERE coalesce(artifact_type NOT IN ('xlsx', 'docx', 'pdf'), true)
    UNION ALL SELECT 'consumer_unknown', u FROM (SELECT unnest(string_split(archetype, '_')) AS u) WHERE u NOT IN (SELECT split_part(archetype, '_', 1) FROM blueprints WHERE archetype IS NOT NULL)) f WHERE b.blueprint_id IS NOT NULL"""
)
def catalog_entry_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Field rules over catalog entries: blank fields, values outside their domain, consumers that are not registered."""
    b = table(spark, folder, "blueprints").filter("blueprint_id is not null")
    entries = b.select(F.col("blueprint_id").alias("template_id"), F.lit("").alias("version"), "name", "archetype", "artifact_type", F.split("archetype", "_").alias("supported_consumers"))
    registered = table(spark, folder, "blueprints").filter("archetype is not null").select(F.substring_index("archetype", "_", 1).alias("consumer_id"))
    found = catalog.entry_findings(entries, ("name", "archetype"), {"artifact_type": ("xlsx", "docx", "pdf")}, registered)
    return found.select(F.rtrim(F.col("subject"), F.lit("@")).alias("blueprint_id"), "rule", "detail")


@query(
    """WITH d AS (SELECT DISTINCT doc_id, toxic, lower(trim(reviewer)) AS actor FROM doc_labels WHERE reviewer IS NOT NULL), s AS (SELECT actor, count(*) AS lanes FROM (SELECT DISTINCT toxic, actor FROM d) GROUP BY 1)
    SELECT 'all' AS subject, actor, lanes AS n FROM s WHERE lanes > 1"""
)
def shared_actors(spark: SparkSession, folder: str) -> DataFrame:
    """Reviewers that, as identities, stand in more than one lane: they gave labels of both kinds, or none."""
    labels = table(spark, folder, "doc_labels").select(F.lit("all").alias("subject"), F.coalesce(F.col("toxic").cast("string"), F.lit("none")).alias("lane"), "reviewer")
    return integrity.shared_identities(labels, "subject", "lane", "reviewer")


@query(
    """WITH r AS (SELECT p_partkey, 'B4:' || chr(65 + (p_size % 26)::INT) || (p_partkey + 4) AS ref, 'A1:A' || chr(65 + (p_size % 26)::INT) || '9' AS wide, p_size || ' - ' || (p_size + 7) || ' tabs' AS target FROM part)
    SELECT p_partkey, ascii(regexp_extract(ref, ':([A-Z]+)', 1)) - 64 - 1 AS width, p_partkey::INT AS data_rows, 26 + ascii(substr(split_part(wide, ':', 2), 2, 1)) - 64 AS far, split_part(target, ' - ', 1)::INT AS low, regexp_extract(target, ' - ([0-9]+)', 1)::INT AS high FROM r"""
)
def spreadsheet_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Shapes of cell ranges, column numbers and targets written as text."""
    letter = F.char(F.lit(65) + F.col("p_size") % 26)
    rows = table(spark, folder, "part").select(
        "p_partkey", F.concat(F.lit("B4:"), letter, (F.col("p_partkey") + 4).cast("string")).alias("ref"), F.concat(F.lit("A1:A"), letter, F.lit("9")).alias("wide"), F.concat(F.col("p_size").cast("string"), F.lit(" - "), (F.col("p_size") + 7).cast("string"), F.lit(" tabs")).alias("target")
    )
    shape, foot = scalars.range_shape(F.col("ref")), scalars.footprint(F.col("target"), "tabs")
    return rows.select("p_partkey", shape["width"].alias("width"), shape["data_rows"].alias("data_rows"), scalars.range_shape(F.col("wide"))["width"].alias("far"), foot["low"].alias("low"), foot["high"].alias("high"))


@query("SELECT account_code, lower(active) NOT IN ('0', 'false', 'off', 'no') AS enabled, count(*) AS n FROM account_map WHERE active IS NOT NULL GROUP BY ALL UNION ALL SELECT account_code, true, count(*) FROM account_map WHERE active IS NULL GROUP BY ALL")
def enabled_accounts(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts by a property that is on unless it says otherwise."""
    return table(spark, folder, "account_map").select("account_code", scalars.on_off(F.col("active")).alias("enabled")).groupBy("account_code", "enabled").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT source_row_id, unnest(regexp_extract_all(regexp_replace(description, '=\r?\n', '', 'g'), '(?s)\{\{(.*?)\}\}', 1)) AS slot FROM source_rows")
def template_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Names of unfilled slots, also across lines."""
    return table(spark, folder, "source_rows").select("source_row_id", F.explode(scalars.slots(F.col("description"))).alias("slot"))


@query("SELECT p_partkey, unnest(list_transform(range(1, p_size % 4 + 1), lambda i: 'render/' || p_partkey || '/page-' || i || '.png')) AS path FROM part")
def page_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The files that a render of several pages must consist of."""
    pattern = F.concat(F.lit("render/"), F.col("p_partkey").cast("string"), F.lit("/page-{page}.png"))
    return table(spark, folder, "part").select("p_partkey", F.explode(scalars.expand_pages(pattern, F.col("p_size") % 4)).alias("path"))


@query(
    """WITH c AS (SELECT upper(trim(account_code)) AS code, debit FROM source_rows WHERE account_code IS NOT NULL), m AS (SELECT DISTINCT upper(trim(account_code)) AS code FROM account_map)
    SELECT 'keys_not_left_subset_of_right' AS rule, count(DISTINCT trim(account_code)) AS n FROM source_rows WHERE trim(account_code) <> '' AND trim(account_code) NOT IN (SELECT trim(account_code) FROM account_map WHERE trim(account_code) <> '')"""
)
def reconciliation_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of a carrier that another must hold: findings by rule."""
    found = carriers.reconcile(table(spark, folder, "source_rows"), "account_code", table(spark, folder, "account_map"), "account_code", "left_subset_of_right", "source-to-map")
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


_SCHEMA = {
    "type": "object",
    "required": ["submission_profile_id", "reuse_policy", "templates"],
    "properties": {
        "status": {"enum": ["reviewed", "draft", "retired"]},
        "templates": {"type": "array", "maxItems": 3},
        "reuse_policy": {"type": "object", "required": ["material_change_kinds"], "properties": {"material_change_kinds": {"items": {"pattern": "_"}, "minItems": 3}}, "additionalProperties": False},
    },
}


@query(
    """WITH p AS (SELECT profile_seq::VARCHAR AS subject, body, json_extract(body, '$.templates') AS t, json_extract(body, '$.reuse_policy') AS r, json_extract(body, '$.reuse_policy.material_change_kinds') AS k FROM profiles)
    SELECT subject, '/reuse_policy' AS location, 'required' AS problem FROM p WHERE r IS NULL UNION ALL SELECT subject, '/templates', 'required' FROM p WHERE t IS NULL
    UNION ALL SELECT subject, '/templates', 'type' FROM p WHERE json_type(t) <> 'ARRAY' UNION ALL SELECT subject, '/templates', 'size' FROM p WHERE json_type(t) = 'ARRAY' AND json_array_length(t) > 3
    UNION ALL SELECT subject, '/status', 'enum' FROM p WHERE json_extract(body, '$.status') IS NOT NULL AND coalesce(body->>'$.status', '') NOT IN ('reviewed', 'draft', 'retired')
    UNION ALL SELECT subject, '/reuse_policy', 'type' FROM p WHERE r IS NOT NULL AND json_type(r) <> 'OBJECT' UNION ALL SELECT subject, '/reuse_policy/material_change_kinds', 'required' FROM p WHERE json_type(r) = 'OBJECT' AND k IS NULL
    UNION ALL SELECT subject, '/reuse_policy/' || f, 'additionalProperties' FROM (SELECT subject, unnest(json_keys(r)) AS f FROM p WHERE json_type(r) = 'OBJECT') WHERE f <> 'material_change_kinds'
    UNION ALL SELECT subject, '/reuse_policy/material_change_kinds', 'size' FROM p WHERE json_type(k) = 'ARRAY' AND json_array_length(k) < 3
    UNION ALL SELECT subject, '/reuse_policy/material_change_kinds/' || (i - 1), 'pattern' FROM (SELECT subject, unnest(k::VARCHAR[]) AS v, generate_subscripts(k::VARCHAR[], 1) AS i FROM p WHERE json_type(k) = 'ARRAY') WHERE NOT contains(v, '_')"""
)
def profile_schema(spark: SparkSession, folder: str) -> DataFrame:
    """Rules of a closed schema that profiles break, with where."""
    return documents.schema_findings(table(spark, folder, "profiles"), "profile_seq", "body", _SCHEMA)


@query(
    """SELECT profile_seq::VARCHAR AS subject, '/reuse_policy/history_scope' AS location, 'forbidden_key' AS problem FROM profiles WHERE json_extract(body, '$.reuse_policy.history_scope') IS NOT NULL
    UNION ALL SELECT profile_seq::VARCHAR, '/scope', 'forbidden_text' FROM profiles WHERE body->>'$.scope' LIKE 'public_safe%'"""
)
def forbidden_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys and texts that must not occur at any depth of a profile."""
    return documents.forbidden_findings(table(spark, folder, "profiles"), "profile_seq", "body", ["History_Scope"], [r"\Apublic_safe"])


@query(
    """SELECT profile_seq, CASE WHEN json_extract(body, '$.reuse_policy.block_consecutive_exact') IS NOT NULL THEN 'private' END AS scope, CASE WHEN json_extract(body, '$.reuse_policy.block_consecutive_exact') IS NOT NULL THEN json_extract_string(body, '$.reuse_policy.history_scope') END AS history,
    CASE WHEN json_extract(body, '$.reuse_policy.block_consecutive_exact') IS NULL THEN 'no_target' END AS problem FROM profiles"""
)
def document_patch(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles with one field replaced and one removed; those without the field are left as they are."""
    operations = [{"op": "replace", "path": "/scope", "value": "private"}, {"op": "remove", "path": "/reuse_policy/block_consecutive_exact"}]
    made = documents.patched(table(spark, folder, "profiles"), "body", ["profile_seq"], operations)
    left = F.get_json_object("document", "$.reuse_policy.block_consecutive_exact")
    return made.select("profile_seq", F.get_json_object("document", "$.scope").alias("scope"), F.when(left.isNull(), F.get_json_object("document", "$.reuse_policy.history_scope")).alias("history"), "problem")


@query(
    f"""WITH {_FLAT}, r AS (SELECT profile_seq % 2 AS side, template_id AS name, sha256(to_json({{'release_id': release_id, 'version': version}})) AS sha256 FROM tt WHERE template_id IS NOT NULL)
    SELECT DISTINCT a.name, a.sha256, CASE WHEN NOT EXISTS (SELECT 1 FROM r b WHERE b.side = 0 AND b.name = a.name) THEN 'missing' WHEN EXISTS (SELECT 1 FROM r b WHERE b.side = 0 AND b.name = a.name AND b.sha256 = a.sha256) THEN 'identical' ELSE 'different' END AS state FROM r a WHERE a.side = 1"""
)
def publication_states(spark: SparkSession, folder: str) -> DataFrame:
    """Records that every second profile would publish against those that the others published."""
    rows = _kind(_flat(spark, folder), "release").filter("template_id is not null")
    made = library.records(rows.select("profile_seq", "template_id", "child_key", "of_version"), F.col("template_id"), {"release_id": F.col("child_key"), "version": F.col("of_version")})
    return library.publication(made.filter("profile_seq % 2 = 1"), made.filter("profile_seq % 2 = 0"))


@query(
    r"""WITH x AS (SELECT raw_line AS l, regexp_replace(raw_line, '(^|,)"(?:[^"]|"")*"', '\1Q', 'g') AS q FROM raw_source_lines WHERE raw_line IS NOT NULL),
    y AS (SELECT CASE WHEN NOT regexp_full_match(l, '(?:"(?:[^"]|"")*"|[^",][^,]*|)(?:,(?:"(?:[^"]|"")*"|[^",][^,]*|))*') THEN 'unreadable' WHEN l = '' THEN 'no_rows' WHEN length(q) - length(replace(q, ',', '')) <> 7 THEN 'width' ELSE 'good' END AS state FROM x)
    SELECT state, count(*) AS n FROM y GROUP BY 1"""
)
def carrier_records(spark: SparkSession, folder: str) -> DataFrame:
    """Each line as a file of its own below the header, parsed strictly: what becomes of it."""
    header = ",".join(f.name for f in malformed.SOURCE_ROW)
    content = table(spark, folder, "raw_source_lines").filter("raw_line is not null").select(F.col("line_id").cast("string").alias("path"), F.encode(F.concat(F.lit(f"{header}\n"), F.col("raw_line")), "utf-8").alias("content"))
    rows = files.strict_rows(content)
    return rows.groupBy(F.coalesce("problem", F.lit("good")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_FLAT}, known AS (SELECT 'library/foundations/' || card_id || '.json' AS path FROM foundation_cards WHERE card_id IS NOT NULL)
    SELECT DISTINCT path FROM card WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM known)"""
)
def declared_resources(spark: SparkSession, folder: str) -> DataFrame:
    """Files that templates declare and the library does not list."""
    listed = table(spark, folder, "foundation_cards").filter("card_id is not null").select(F.concat(F.lit("library/foundations/"), F.col("card_id"), F.lit(".json")).alias("path"))
    return integrity.unmatched(_kind(_flat(spark, folder), "foundation_card").filter("path is not null").select("path"), listed, ["path"]).distinct()


@query(SQL["profile_findings"].replace("SELECT rule, count(*) AS n FROM f GROUP BY 1", "SELECT CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS findings FROM f"))
def library_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The state of the gate before every use of the library."""
    return findings.status(_profile_findings(spark, folder))


_POPULATION = f"{_LINES.replace('judged', 'line_judged')}, src AS (SELECT DISTINCT {_nth(0)} AS source_row_id, {_nth(1)} AS entity_code, {_nth(2)} AS account_code, d::DATE AS transaction_date, {_nth(4)} AS description, dr::DECIMAL(18,2) AS debit, cr::DECIMAL(18,2) AS credit, {_nth(7)} AS status_code FROM line_judged WHERE d_ok AND dr_ok AND cr_ok)"


@query(f"WITH {_CONTROLS.replace(_CLEAN, _POPULATION)} SELECT * FROM t")
def population_controls(spark: SparkSession, folder: str) -> DataFrame:
    """From raw lines to the control table: load, drop repeated rows, reconcile with the ledger, judge."""
    loaded = malformed.loaded(table(spark, folder, "raw_source_lines").select("raw_line"), "raw_line").drop("debit_text", "credit_text").distinct()
    return _money(_controls(spark, folder, loaded), "delta")


def enforced(spark: SparkSession, folder: str) -> None:
    """Refuses a library with any finding; what an operation on it calls first."""
    library.gate(_profile_findings(spark, folder))


__all__ = ["CATEGORIES", "QUERIES", "SQL", "enforced"]
