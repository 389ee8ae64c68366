"""Round trips: rows written as packages and read back by the artifact readers, against SQL over the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import documents
from tallyforge.functions.scalars import column_number
from tallyforge.operators import integrity, library, malformed, office
from tallyforge.plans.records import _LINES
from tallyforge.plans.reference import QUERIES, SQL, query
from tallyforge.session import durable, scratch
from tallyforge.sinks import packages, publish
from tallyforge.sources import artifacts, carriers, pdf
from tallyforge.sources.tables import table

_HEADERS = ("source_row_id", "entity_code", "account_code", "debit", "credit")
_NET = "net"


def _books(spark: SparkSession, folder: str) -> DataFrame:
    """All source rows as workbooks, with the net of each row as a formula; kept, since other partitions give other files."""
    amount = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = table(spark, folder, "source_rows").select(*_HEADERS, (amount("debit") - amount("credit")).alias(_NET))
    return durable(packages.workbooks(rows, _HEADERS, {_NET: "D{r}-E{r}"}, capacity=4000))


_CELL = [*_HEADERS, _NET]


@query(
    " UNION ALL ".join(
        f"SELECT {i} AS number, '{c}' AS header, count({x}) AS cells, count(DISTINCT {x}) AS different, {'count(*)' if c == _NET else '0'} AS formulas, {f'sum({x})::DOUBLE' if c in ('debit', 'credit', _NET) else 'NULL::DOUBLE'} AS total FROM source_rows"
        for i, (c, x) in enumerate(((c, "coalesce(debit, 0) - coalesce(credit, 0)" if c == _NET else c) for c in _CELL), 1)
    )
)
def workbook_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """What is read from workbooks that hold all source rows: cells, values and formulas of each column."""
    cells = artifacts.workbook_cells(_books(spark, folder))
    number = column_number(F.regexp_extract("cell", "^[A-Z]+", 0))
    body = cells.filter(~F.col("cell").rlike("^[A-Z]+1$")).select(number.cast("int").alias("number"), "value", F.col("formula").isNotNull().alias("f"))
    names = F.array(*map(F.lit, _CELL))
    by_value = body.groupBy("number", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if("f").alias("f"))  # distinct values meet by value, not by column
    money = F.when(F.col("number") >= 4, F.col("value").cast("decimal(20,2)") * F.col("n"))
    return by_value.groupBy("number").agg(F.sum("n").alias("cells"), F.count(F.lit(1)).alias("different"), F.sum("f").alias("formulas"), F.sum(money).cast("double").alias("total")).select("number", F.get(names, F.col("number") - 1).alias("header"), "cells", "different", "formulas", "total")


@query("SELECT count(*) AS rows, 0::BIGINT AS declared_differs, 0::BIGINT AS shape_problems, count(*) AS formulas, 0::BIGINT AS structure_differs, 0::BIGINT AS cached_after, count(*) AS empty_caches FROM source_rows")
def workbook_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Declared tables against those the workbooks hold, their shapes, and formulas before and after caches are stripped."""
    books = _books(spark, folder)
    declared = books.select("path", F.lit("Data").alias("sheet"), F.lit("DataTable").alias("name"), F.concat(F.lit("A1:F"), (F.col("rows") + 1).cast("string")).alias("ref"), F.lit(",".join(_CELL)).alias("columns"))
    native = office.native_tables(books).withColumn("columns", F.array_join("columns", ","))
    differing = library.table_differences(declared, native, ["path", "sheet", "name"], ["ref", "columns"])
    before = office.formula_evidence(artifacts.workbook_cells(books))
    stripped = books.select("path", packages.built(packages.without_caches, F.col("content")).alias("content"))
    bare = durable(artifacts.workbook_cells(stripped))
    after = office.formula_evidence(bare)
    changed = integrity.field_differences(before, after, ["path"], ["formulas", "structure"])
    one = lambda df, name, c=None: df.agg((F.count(F.lit(1)) if c is None else F.coalesce(F.sum(c), F.lit(0))).cast("bigint").alias(name))
    parts = [one(books, "rows", "rows"), one(differing, "declared_differs"), one(artifacts.shape_findings(books), "shape_problems"), one(before, "formulas", "formulas"), one(changed, "structure_differs"), one(after, "cached_after", "cached"), one(office.empty_caches(bare).filter("not valid"), "empty_caches")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out


@query("SELECT doc_id, len(string_split(text, chr(10))) AS paragraphs, length(replace(text, chr(10), '')) AS characters FROM documents WHERE text IS NOT NULL")
def document_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts written as documents, a paragraph a line, and what their inspector tells."""
    docs = table(spark, folder, "documents").filter("text is not null")
    made = docs.select("doc_id", packages.built(lambda t: packages.document(t.split("\n")), F.col("text")).alias("content"))
    told = F.from_json(artifacts.detail(F.lit("docx"), F.col("content")), "paragraphs bigint, characters bigint")
    return made.select("doc_id", told.alias("d")).select("doc_id", "d.*")


@query(
    r"""SELECT source, count(*) AS messages, count(DISTINCT doc_id) AS ids, count(artifact_family) AS attachments, sum(len(regexp_extract_all(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?mi)^(from:|sent:|to:|subject:|on .+ wrote:|>)')))::BIGINT AS markers FROM documents WHERE text IS NOT NULL GROUP BY 1"""
)
def mail_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts written as mail, with an attachment where the document has a family: messages, their ids and replies by source."""

    def made(text: str, number: int, family: str | None) -> bytes:
        return packages.mail(f"Document {number}", f"{number}@example.com", text, {f"{family}.txt": text[:100]} if family is not None else None)

    docs = table(spark, folder, "documents").filter("text is not null")
    mails = docs.select("source", packages.built(made, F.col("text"), F.col("doc_id"), F.col("artifact_family")).alias("content"))
    told = F.from_json(artifacts.detail(F.lit("eml"), F.col("content")), "message_id string, missing_headers array<string>, attachments array<struct<name:string,type:string,binary:boolean>>, reply_markers bigint")
    # ids are counted by hash buckets first, so that no source's set of ids is held by one task
    rows = mails.select("source", told.alias("d")).select("source", F.col("d.message_id").alias("id"), F.size("d.attachments").alias("a"), F.col("d.reply_markers").alias("m"))
    by_id = rows.groupBy("source", "id").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("m").alias("m"))
    return by_id.groupBy("source").agg(F.sum("n").alias("messages"), F.count(F.lit(1)).alias("ids"), F.sum("a").alias("attachments"), F.sum("m").alias("markers"))


@query("SELECT p_partkey, (p_size % 5 + 1)::BIGINT AS pages, (p_size + 10)::DOUBLE AS smallest_side, CASE WHEN p_size + 10 < 16 THEN 'page_too_small' END AS problem FROM part")
def pdf_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Files of several pages, and what their page tree and media boxes tell."""

    def made(key: int, size: int) -> bytes:
        return pdf.write([(size + 10, 600, f"({key}) Tj % endobj".encode())] * (size % 5 + 1))

    files = durable(table(spark, folder, "part").select("p_partkey", F.concat(F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("path"), packages.built(made, F.col("p_partkey"), F.col("p_size")).alias("content")))
    told = F.from_json(artifacts.detail(F.lit("pdf"), F.col("content")), "pages bigint, smallest_side double")
    problems = artifacts.shape_findings(files).select(F.col("name").alias("path"), "problem")
    return files.select("p_partkey", "path", told.alias("d")).join(problems, "path", "left").select("p_partkey", "d.pages", "d.smallest_side", "problem")


@query("SELECT p_partkey, p_size AS width, (p_partkey % 9 + 1)::INT AS height, CASE WHEN least(p_size, p_partkey % 9 + 1) < 2 THEN 'image_too_small' END AS problem FROM part")
def png_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Images, their size from the header alone, and what their whole structure tells."""

    def made(key: int, size: int) -> bytes:
        return packages.png([bytes([key % 256]) * size] * (key % 9 + 1))

    files = durable(table(spark, folder, "part").select("p_partkey", F.concat(F.col("p_partkey").cast("string"), F.lit(".png")).alias("path"), packages.built(made, F.col("p_partkey"), F.col("p_size")).alias("content")))
    problems = artifacts.shape_findings(files).select(F.col("name").alias("path"), "problem")
    return files.select("p_partkey", "path", artifacts.png_size(F.col("content")).alias("s")).join(problems, "path", "left").select("p_partkey", "s.width", "s.height", "problem")


@query(
    """SELECT 'inner.zip' AS container, 'txt' AS type, count(*) AS members, sum(length(p_name))::BIGINT AS bytes, count(DISTINCT sha256(p_name)) AS hashes FROM part WHERE p_name IS NOT NULL
    UNION ALL SELECT 'outer.zip', 'zip', count(*), NULL, NULL FROM part WHERE p_name IS NOT NULL UNION ALL SELECT 'outer.zip', 'csv', count(*), sum(length('a,b' || chr(10) || p_size || ',2'))::BIGINT, count(DISTINCT p_size) FROM part WHERE p_name IS NOT NULL"""
)
def archive_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Members of archives within archives: how many of each type, their bytes and hashes."""

    def made(name: str, size: int) -> bytes:
        return packages.zipped({"inner.zip": packages.zipped({"name.txt": name}), "row.csv": f"a,b\n{size},2"})

    files = table(spark, folder, "part").select(F.lit("outer.zip").alias("path"), packages.built(made, F.col("p_name"), F.col("p_size")).alias("content"))
    rows = artifacts.inventory(files.filter("content is not null")).filter("container is not null").select(F.element_at(F.split("container", "!"), -1).alias("container"), "type", "bytes", "sha256")
    whole = F.col("type") != "zip"  # an archive's own bytes are the compressor's affair
    by_hash = rows.groupBy("container", "type", "sha256").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    return by_hash.groupBy("container", "type").agg(F.sum("n").alias("members"), F.sum(F.when(whole, F.col("b"))).alias("bytes"), F.nullif(F.count(F.when(whole, 1)), F.lit(0)).alias("hashes"))


@query("SELECT 'core' AS kind, p_brand AS value, count(*) AS files FROM part GROUP BY 2")
def package_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Core properties of documents, counted by value."""

    def made(brand: str) -> bytes:
        return packages.zipped({"word/document.xml": "<d/>", "docProps/core.xml": f"<c><creator>{brand}</creator></c>", "docProps/custom.xml": "<p"})

    files = table(spark, folder, "part").select(F.lit("x.docx").alias("path"), packages.built(made, F.col("p_brand")).alias("content"))
    return office.properties(files).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("files"))


@query(
    r"""SELECT token, count(*) AS files, count(*) AS members FROM (SELECT unnest(list_distinct(regexp_extract_all(description, '\{\{[^{}\r\n]+\}\}|\[\[[^\[\]\r\n]+\]\]|\{%[^%\r\n]+%\}'))) AS token FROM source_rows WHERE description LIKE '%{%' OR description LIKE '%[[%') GROUP BY 1"""
)
def package_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Unfilled slots in documents made of descriptions, each cut over two runs, and the members they stand in."""

    def made(text: str) -> bytes:
        runs = "".join(f'<w:r><w:t xml:space="preserve">{packages._shown(part)}</w:t></w:r>' for part in (text[: len(text) // 2], text[len(text) // 2 :]))
        return packages.zipped({"word/document.xml": f'<w:document xmlns:w="w"><w:p>{runs}</w:p></w:document>'})

    rows = table(spark, folder, "source_rows").filter("description like '%{%' or description like '%[[%'")
    files = durable(rows.select(F.concat_ws("-", "source_row_id", F.monotonically_increasing_id().cast("string")).alias("path"), packages.built(made, F.col("description")).alias("content")))
    found = office.tokens(office.surfaces(files))
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("files"), F.sum(F.size("members")).alias("members"))


_PLAIN = "(l IS NULL OR NOT regexp_matches(l, '[\\r\\n]'))"


@query(
    f"""WITH {_LINES}, x AS (SELECT * FROM lines WHERE l IS NOT NULL AND trim(l) <> '' AND {_PLAIN})
    SELECT file_name, count(*) AS lines, count(*) FILTER (line_id IN (SELECT line_id FROM reasons)) AS rejected, 0::BIGINT AS other_headers FROM x GROUP BY 1"""
)
def carrier_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Lines written as delimited files below their header and scanned again: what loads, by file."""
    header = [f.name for f in malformed.SOURCE_ROW]
    rows = table(spark, folder, "raw_source_lines").filter("raw_line is not null and trim(raw_line) <> ''").filter(~F.col("raw_line").rlike("[\r\n]")).select("file_name", "raw_line")
    named = F.regexp_extract("path", "file_name=([^/]+)/", 1)
    with scratch(spark) as at:
        # the header of each file is its first line: one file a name, its lines sorted after it
        heads = rows.select("file_name").distinct().select("file_name", F.lit(",".join(header)).alias("raw_line"), F.lit(0).alias("o"))
        rows.withColumn("o", F.lit(1)).unionByName(heads).repartition("file_name").sortWithinPartitions("file_name", "o").drop("o").write.partitionBy("file_name").text(at)
        done = malformed.classify(carriers.lines(spark, at, header, "*.txt"), "raw_line")
        counts = done.groupBy(named.alias("file_name")).agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.size("reasons") > 0).alias("rejected"))
        wrong = carriers.first_lines(spark, at, header, "*.txt").groupBy(named.alias("file_name")).agg(F.count(F.lit(1)).alias("n"))
        return durable(counts.join(wrong, "file_name", "left").select("file_name", "lines", "rejected", F.coalesce("n", F.lit(0)).cast("bigint").alias("other_headers")))


@query(
    """WITH x AS (SELECT CASE WHEN profile_seq % 3 = 0 THEN body || '}' WHEN profile_seq % 3 = 1 THEN body ELSE '[' || body || ']' END AS v, profile_seq % 3 AS k, body->>'$.status' AS status FROM profiles)
    SELECT CASE WHEN k = 1 THEN status END AS status, k <> 1 AS corrupt, count(*) AS n FROM x GROUP BY ALL"""
)
def json_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles written as lines of JSON and scanned again under a schema: every third is broken, every third a list."""
    body = F.when(F.col("profile_seq") % 3 == 0, F.concat("body", F.lit("}"))).when(F.col("profile_seq") % 3 == 1, F.col("body")).otherwise(F.concat(F.lit("["), F.col("body"), F.lit("]")))
    rows = table(spark, folder, "profiles").select(F.regexp_replace(body, "[\r\n]", " ").alias("value"))
    with scratch(spark) as at:
        rows.write.text(at)
        texts = documents.object_flags(spark.read.text(at), "value")
        bad = ~F.col("is_object")
        status = F.when(~bad, F.get_json_object("value", "$.status"))
        return durable(texts.groupBy(status.alias("status"), bad.alias("corrupt")).agg(F.count(F.lit(1)).alias("n")))


@query("SELECT 'first' AS step, 'written' AS state, count(*) AS rows FROM blueprints UNION ALL SELECT 'again', 'unchanged', count(*) FROM blueprints UNION ALL SELECT 'other', 'refused', count(*) FROM blueprints")
def publish_once(spark: SparkSession, folder: str) -> DataFrame:
    """A table published, published again, and refused once it differs; its rows after each step."""
    whole = table(spark, folder, "blueprints")
    steps = []
    with scratch(spark) as at:
        for step, df in (("first", whole), ("again", whole.repartition(3)), ("other", whole.limit(0))):
            try:
                state = publish.publish_tables({f"{at}/t": df})[f"{at}/t"]
            except publish.Refused:
                state = "refused"
            steps.append((step, state, spark.read.parquet(f"{at}/t").count()))
    return spark.createDataFrame(steps, "step string, state string, rows bigint")


_TRAITS = (
    # a rule, and every how many-th part breaks it
    ("hidden_sheet", 5),
    ("hidden_row", 7),
    ("hidden_columns", 11),
    ("formula_error", 13),
    ("external_relationship", 17),
    ("comments", 19),
    ("stale_metadata", 23),
    ("embedded_object", 29),
    ("custom_xml", 31),
    ("malformed_part", 37),
    ("prohibited_phrase", 41),
    ("unresolved_token", 43),
)


@query(" UNION ALL ".join(f"SELECT '{rule}' AS rule, count(*) AS n FROM part WHERE p_partkey % {k} = 0 HAVING count(*) > 0" for rule, k in _TRAITS))
def office_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Workbooks that have what a clean one must not have, by rule."""

    def made(key: int) -> bytes:
        has = {rule for rule, k in _TRAITS if key % k == 0}
        parts = {
            "[Content_Types].xml": "<Types/>",
            "xl/workbook.xml": f'<workbook xmlns:r="r"><sheets><sheet name="S" {"state='hidden'" if "hidden_sheet" in has else ""} r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<R><Relationship Id="rId1" Type="t/worksheet" Target="worksheets/sheet1.xml"/></R>',
            "xl/worksheets/sheet1.xml": f'<w><cols><col min="2" max="3" hidden="{int("hidden_columns" in has)}"/></cols><sheetData><row r="1" hidden="{int("hidden_row" in has)}"><c r="A1" t="{"e" if "formula_error" in has else "n"}"><f>1</f><v>1</v></c></row></sheetData></w>',
        }
        texts = [t for rule, t in (("prohibited_phrase", "the answer key"), ("unresolved_token", "{{slot}}")) if rule in has]
        extra = {
            "external_relationship": ("xl/_rels/links.xml.rels", '<R><Relationship Id="r" Type="t/link" Target="http://far" TargetMode="External"/></R>'),
            "comments": ("xl/comments1.xml", "<c/>"),
            "stale_metadata": ("docProps/core.xml", "<c><creator>x</creator></c>"),
            "embedded_object": ("xl/embeddings/o.bin", "x"),
            "custom_xml": ("customXml/item1.xml", "<c/>"),
            "malformed_part": ("xl/bad.xml", "<c"),
        }
        parts |= dict(v for k, v in extra.items() if k in has)
        if texts:
            parts["xl/sharedStrings.xml"] = "<sst>" + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>"
        return packages.zipped(parts)

    path = F.concat(F.col("p_partkey").cast("string"), F.lit(".xlsx"))
    files = durable(table(spark, folder, "part").select(path.alias("path"), path.alias("name"), packages.built(made, F.col("p_partkey")).alias("content")))
    return office.findings(files).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH p AS (SELECT p_partkey, repeat(p_name || ' ', p_size % 6) AS content, p_brand, p_name FROM part) SELECT problem, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN strlen(content) < 64 THEN 'too_short' END, CASE WHEN NOT contains(content, p_name) THEN 'lacks_name' END, CASE WHEN NOT contains(content, p_brand) THEN 'lacks_brand' END], lambda x: x IS NOT NULL)) AS problem FROM p) GROUP BY 1"""
)
def proof_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Proofs that are too short, or lack a text they must contain."""
    content = F.encode(F.repeat(F.concat("p_name", F.lit(" ")), F.col("p_size") % 6), "utf-8")
    proofs = table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("path"), content.alias("content"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return office.proof_problems(proofs, ["name", "brand"]).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey::VARCHAR AS path, CASE WHEN p_partkey % 10 = 0 THEN 'missing' ELSE 'hash_differs' END AS defect FROM part WHERE p_partkey % 10 = 0 OR (p_partkey % 7 = 0 AND p_name <> p_name || 'x')")
def hash_bound_files(spark: SparkSession, folder: str) -> DataFrame:
    """References by path and hash against the files' bytes: some files are absent, some hashes of other bytes."""
    part = table(spark, folder, "part").withColumn("path", F.col("p_partkey").cast("string"))
    files = part.filter("p_partkey % 10 <> 0").select("path", F.sha2(F.encode("p_name", "utf-8"), 256).alias("sha256"))
    declared = F.when(F.col("p_partkey") % 7 == 0, F.concat("p_name", F.lit("x"))).otherwise(F.col("p_name"))
    refs = part.select("path", F.sha2(declared, 256).alias("sha256"))
    return integrity.bound_references(refs, files).select("path", "defect")


__all__ = ["QUERIES", "SQL"]
