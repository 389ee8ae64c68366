"""Queries of the text problems (4, 6, 7, 8 and 9) and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import abuse, copies, leakage, packing, residue
from tallyforge.session import durable
from tallyforge.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


# 4: duplicates hidden by formatting


def _tuples(spark: SparkSession, folder: str) -> DataFrame:
    return copies.encoded(table(spark, folder, "captured_entries"), "capture_id", "record_text")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies.copies(_tuples(spark, folder))


def p4_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return copies.groups(_tuples(spark, folder)).select("keep_id", F.col("n").alias("copies"))


def p4_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Every canonical value of the three fields, with the records that have it."""
    return copies.dictionary(table(spark, folder, "captured_entries"), "capture_id", "record_text").select("field", "value", "records")


def _value(label: str) -> str:
    return f"regexp_replace(lower(upper(regexp_extract(record_text, '(?is){label}(.*?)(?:{'|'.join(copies.LABELS.values())}|$)', 1))), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


_SAME = f"""
v AS (SELECT DISTINCT capture_id, {", ".join(f"{_value(p)} AS v{i}" for i, p in enumerate(copies.LABELS.values()))} FROM captured_entries
  WHERE {" AND ".join(f"regexp_matches(record_text, '(?i){p}')" for p in copies.LABELS.values())}),
g AS (SELECT v0, v1, v2, min(capture_id) AS keep_id, count(*) AS copies FROM v GROUP BY ALL)
"""


# 6: template residue and error texts

VALUES = ("description", "status_code")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "source_rows").select("source_row_id", "entity_code", *VALUES)
    return residue.found(rows, "source_row_id", VALUES, "entity_code")


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that remain, as they are."""
    return residue.clean(table(spark, folder, "source_rows"), VALUES, "entity_code")


def p6_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Values and cases by field, and the classifier's figures on entities it was not trained on."""
    return residue.rates(table(spark, folder, "source_rows").select("source_row_id", "entity_code", *VALUES), VALUES, "entity_code")


# 7: filling containers


def p7_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(packing.sizes(table(spark, folder, "documents"), "doc_id", "text"))
    return packed.select(F.col("id").alias("doc_id"), "piece", F.col("n").alias("tokens"), "container", "filled")


def p7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return packing.quality(packing.pack(packing.sizes(table(spark, folder, "documents"), "doc_id", "text")))


def p7_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of any packing: each text placed once and whole, containers as full as they say, within capacity."""
    cap = packing.CAPACITY
    packed = p7_packing(spark, folder).withColumn("tokens", F.col("tokens").cast("bigint"))
    # a document has few pieces for its tokens and a container at most as many as tokens: both counted map-side
    of_document = packed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece").alias("places"), F.min("piece").alias("first"), F.max("piece").alias("last"), F.sum("tokens").alias("size")
    )
    documents = of_document.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if((F.col("pieces") != F.col("places")) | (F.col("first") != 0) | (F.col("last") != F.col("pieces") - 1)).alias("repeated"),
        F.count_if(F.col("pieces") != F.ceil(F.col("size") / cap)).alias("needless_cuts"),
    )
    of_container = packed.groupBy("container").agg(F.sum("tokens").alias("held"), F.min("filled").alias("low"), F.max("filled").alias("high"))
    containers = of_container.agg(
        F.count_if(F.col("held") > cap).alias("overfull"),
        F.count_if((F.col("low") != F.col("held")) | (F.col("high") != F.col("held"))).alias("misstated"),
        # at most one container that is not above half full: any two such would have been joined
        F.greatest(F.count_if(2 * F.col("held") <= cap) - 1, F.lit(0)).cast("bigint").alias("joinable"),
    )
    return documents.join(F.broadcast(containers))


# 8: leaked evaluation texts


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p8_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """For each document and item, how many of the item's windows are in it, and where the first stands."""
    found = leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.select("doc_id", "item_id", F.col("windows").cast("bigint").alias("windows"), F.col("first_word").cast("bigint").alias("first_word"))


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents each leaked item is in, with its suite."""
    items = table(spark, folder, "eval_items").select("item_id", "suite").distinct()
    return p8_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents")).join(items, "item_id")


def p8_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Phrase and proximity matches."""
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), proximity=True)


# 9: abusive, hateful or sexual content


def _judged(spark: SparkSession, folder: str, *carry: str) -> tuple[DataFrame, float]:
    """Every document's score, and the score from which on it is a case."""
    documents = table(spark, folder, "documents")
    model = abuse.fit(abuse.sample(documents, table(spark, folder, "doc_labels")))
    return abuse.adapted(durable(abuse.scored(documents, model, *carry)), model)


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder, "doc_id")[0]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    scores, threshold = _judged(spark, folder, "doc_id")
    return scores.filter(F.col("score") >= threshold).select("doc_id").distinct()


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    scores, threshold = _judged(spark, folder, "source")
    return abuse.rates(scores.withColumn("flagged", F.col("score") >= threshold))


def _windows(table: str, key: str) -> str:
    """Every run of 13 words of each text, with its place."""
    n = leakage.WINDOW
    return f"""SELECT {key}, unnest(range(len(ws) - {n - 1})) AS at, array_to_string(ws[unnest(range(len(ws) - {n - 1})) + 1 : unnest(range(len(ws) - {n - 1})) + {n}], ' ') AS run
    FROM (SELECT DISTINCT {key}, regexp_extract_all(lower(upper(text)), '[\\p{{L}}\\p{{N}}]+') AS ws FROM {table} WHERE text IS NOT NULL) WHERE len(ws) >= {n}"""


_LEAKS = f"""
d AS ({_windows("documents", "doc_id")}), i AS ({_windows("eval_items", "item_id")}),
leak AS (SELECT doc_id, item_id, count(DISTINCT i.at) AS windows, min(d.at) AS first_word FROM d JOIN i USING (run) GROUP BY ALL)
"""

QUERIES: dict[str, Query] = {
    "p4_found": p4_found,
    "p4_collapsed": p4_collapsed,
    "p4_dictionary": p4_dictionary,
    "p6_found": p6_found,
    "p6_clean": p6_clean,
    "p6_rates": p6_rates,
    "p7_packing": p7_packing,
    "p7_quality": p7_quality,
    "p7_invariants": p7_invariants,
    "p8_found": p8_found,
    "p8_items": p8_items,
    "p8_phrases": p8_phrases,
    "p8_matches": p8_matches,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
    "p9_rates": p9_rates,
}

SQL = {
    "p4_found": f"WITH {_SAME} SELECT keep_id, capture_id AS copy_id FROM v JOIN g USING (v0, v1, v2) WHERE capture_id > keep_id",
    "p4_collapsed": f"WITH {_SAME} SELECT keep_id, copies FROM g",
    "p4_dictionary": f"WITH {_SAME} " + " UNION ALL ".join(f"SELECT '{name}' AS field, v{i} AS value, count(*) AS records FROM v GROUP BY ALL" for i, name in enumerate(copies.LABELS)),
    # sizes are a tokenizer's, which SQL does not have; what must hold of any packing it can say
    "p7_invariants": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS repeated, 0::BIGINT AS needless_cuts, 0::BIGINT AS overfull, 0::BIGINT AS misstated, 0::BIGINT AS joinable FROM documents WHERE length(text) > 0",
    "p8_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM leak",
    "p8_items": f"WITH {_LEAKS} SELECT item_id, suite, count(*) AS documents FROM leak JOIN (SELECT DISTINCT item_id, suite FROM eval_items) USING (item_id) GROUP BY ALL",
    "p8_phrases": f"WITH {_LEAKS} SELECT * FROM leak",
}
