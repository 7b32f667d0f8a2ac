"""Queries about documents, sources and readings as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arqueo.functions.identity import fold
from arqueo.functions.text import amount, data, order_number
from arqueo.plans.registry import Registry, sql_amount, sql_data, sql_order
from arqueo.plans.relations import _readings, _value
from arqueo.session import table

query = Registry()


@query("""
WITH r AS (SELECT file_id, field, max(observed) AS native, CASE WHEN count(*) FILTER (status = 'OK') = count(*) THEN 'OK' ELSE max(status) FILTER (status <> 'OK') END AS status FROM ocr_report GROUP BY 1, 2),
l AS (SELECT file_id, field, max(expected) AS witness FROM ocr_labels GROUP BY 1, 2)
SELECT coalesce(r.file_id, l.file_id) AS file_id, coalesce(r.field, l.field) AS field,
  CASE WHEN r.status = 'OK' AND r.native IS NOT NULL AND l.witness IS NOT NULL AND l.witness <> r.native THEN 'CONFLICT' WHEN r.status = 'OK' AND r.native IS NOT NULL THEN 'OK' WHEN l.witness IS NOT NULL THEN 'OK' ELSE coalesce(r.status, 'MISSING') END AS status,
  CASE WHEN r.status = 'OK' AND r.native IS NOT NULL THEN r.native ELSE coalesce(l.witness, r.native) END AS value
FROM r FULL JOIN l ON r.file_id = l.file_id AND r.field = l.field""")
def ex_merged_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readers' values of each field: a good reading stays unless the other differs, a poor one is replaced."""
    bad = F.col("status") != "OK"
    r = table(spark, sf_dir, "ocr_report").groupBy("file_id", "field").agg(F.max("observed").alias("native"), F.when(F.count_if(F.col("status") == "OK") == F.count("*"), "OK").otherwise(F.max(F.when(bad, F.col("status")))).alias("status"))
    x = r.join(table(spark, sf_dir, "ocr_labels").groupBy("file_id", "field").agg(F.max("expected").alias("witness")), ["file_id", "field"], "full_outer")
    good = F.coalesce((F.col("status") == "OK") & F.col("native").isNotNull(), F.lit(False))
    status = F.when(good & (F.col("witness") != F.col("native")), "CONFLICT").when(good | F.col("witness").isNotNull(), "OK").otherwise(F.coalesce("status", F.lit("MISSING")))
    return x.select("file_id", "field", status.alias("status"), F.when(good, F.col("native")).otherwise(F.coalesce("witness", "native")).alias("value"))


_NUMBERS = [r"(PO-[0-9]{4}-[0-9]{6})", r"((?:FA|INV|FRA)-[0-9]+)", r"([A-Z]-[0-9]{5,})"]


@query("SELECT doc_id, coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in _NUMBERS) + ") AS number FROM documents WHERE text IS NOT NULL")
def ex_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several patterns that a text matches."""
    x = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return x.select("doc_id", F.coalesce(*[F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in _NUMBERS]).alias("number"))


_KEY = "sha256(lower(replace(sha256, 'sha256:', '')) || '|' || coalesce(json_extract_string(extraction, '$.profile'), '') || '|v1')"


@query(f"SELECT DISTINCT {_KEY} AS cache_key FROM invoice_documents WHERE state <> 'DONE' EXCEPT SELECT {_KEY} FROM invoice_documents WHERE state = 'DONE'")
def ex_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys (content, profile, version) of what is still to be read and isn't in the cache."""
    key = F.sha2(F.concat(F.lower(F.regexp_replace("sha256", "sha256:", "")), F.lit("|"), F.coalesce(F.get_json_object("extraction", "$.profile"), F.lit("")), F.lit("|v1")), 256)
    x = table(spark, sf_dir, "invoice_documents").select("state", key.alias("cache_key"))
    return x.filter("state <> 'DONE'").select("cache_key").distinct().join(x.filter("state = 'DONE'"), "cache_key", "left_anti")


@query(f"""SELECT id, {_value('invoice_number')} AS invoice_number, {sql_data(_value('supplier_nif'))} AS nif, {sql_order(_value('"order"'))} AS pedido, CAST({sql_amount(_value('total'))} AS DOUBLE) AS total FROM invoice_documents""")
def rm_document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document with its main readings."""
    x = _readings(spark, sf_dir, "invoice_number", "supplier_nif", "order", "total")
    return x.select("id", "invoice_number", data(F.col("supplier_nif")).alias("nif"), order_number(F.col("order")).alias("pedido"), amount(F.col("total")).cast("double").alias("total"))


@query(f"""
WITH d AS (SELECT id, CAST({sql_amount(_value('total'))} AS DOUBLE) AS total FROM invoice_documents)
SELECT id, total, row_number() OVER (ORDER BY total DESC NULLS LAST, id) AS place FROM d QUALIFY place BETWEEN 41 AND 80""")
def so_by_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of forty by total, unreadable totals last."""
    x = rm_document_rows(spark, sf_dir).select("id", "total").orderBy(F.desc_nulls_last("total"), "id").limit(80)
    return x.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("total"), "id"))).filter("place > 40")  # of 80 rows


@query("SELECT source.row AS sheet_row, name FROM supplier_rows WHERE contains(strip_accents(lower(nfc_normalize(name))), 'informatica')")
def so_accent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose name holds a word, whatever its accents and letter case."""
    return table(spark, sf_dir, "supplier_rows").filter(fold(F.col("name")).contains("informatica")).select(F.col("source.row").alias("sheet_row"), "name")


@query("""
WITH n AS (SELECT batch_id, count(*) AS n_docs, count(*) FILTER (extraction IS NOT NULL) AS n_read, count(latest_decision) AS n_decided FROM invoice_documents GROUP BY 1)
SELECT b.id AS batch_id, coalesce(n_docs, 0) AS n_docs, CASE WHEN n_docs > 0 THEN round(100.0 * n_read / n_docs, 2) END AS percent_read, CASE WHEN n_docs > 0 THEN round(100.0 * n_decided / n_docs, 2) END AS percent_decided FROM batches b LEFT JOIN n ON n.batch_id = b.id""")
def ag_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each batch is; null for one without documents."""
    n = table(spark, sf_dir, "invoice_documents").groupBy("batch_id").agg(F.count("*").alias("n_docs"), F.count("extraction").alias("n_read"), F.count("latest_decision").alias("n_decided"))
    x = table(spark, sf_dir, "batches").select(F.col("id").alias("batch_id")).join(n, "batch_id", "left")
    percent = lambda c: F.round(F.try_divide(F.col(c) * F.lit(100.0), F.col("n_docs")), 2)
    return x.select("batch_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), percent("n_read").alias("percent_read"), percent("n_decided").alias("percent_decided"))


@query("""
WITH a AS (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) AS value FROM events GROUP BY 1), t AS (SELECT min(event_type) AS retraction FROM events)
SELECT user_id, CASE WHEN kind <> retraction THEN event_id END AS event_id, CASE WHEN kind <> retraction THEN value END AS value FROM a, t""")
def wi_latest_unless_retracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last answer of each user, or none if the last event withdraws it (here: is of the first type); older ones don't come back."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    kind = e.agg(F.min("event_type").alias("retraction"))
    last = e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), "event_id").alias("r")).join(F.broadcast(kind))  # one row
    stands = F.col("r.event_type") != F.col("retraction")
    return last.select("user_id", F.when(stands, F.col("r.event_id")).alias("event_id"), F.when(stands, F.col("r.value")).alias("value"))


@query("""
SELECT 'batch_without_snapshot' AS issue, count(*) AS n FROM batches WHERE snapshot_id IS NOT NULL AND snapshot_id NOT IN (SELECT id FROM sources) UNION ALL
SELECT 'batch_without_master', count(*) FROM batches WHERE master_id IS NOT NULL AND master_id NOT IN (SELECT id FROM sources WHERE kind = 'master') UNION ALL
SELECT 'document_without_batch', count(*) FROM invoice_documents WHERE batch_id IS NULL OR batch_id NOT IN (SELECT id FROM batches) UNION ALL
SELECT 'row_without_snapshot', count(*) FROM erp_rows WHERE snapshot_id NOT IN (SELECT snapshot_id FROM erp_snapshot)""")
def tx_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that lead nowhere, by kind."""
    t = lambda n: table(spark, sf_dir, n)

    def orphans(issue: str, x: DataFrame, key: str, targets: DataFrame, target: str, nulls: bool = False) -> DataFrame:
        x = x.select(F.col(key).alias("k"))
        x = x if nulls else x.filter("k IS NOT NULL")
        return x.join(targets.select(F.col(target).alias("k")), "k", "left_anti").agg(F.lit(issue).alias("issue"), F.count("*").alias("n"))

    return (
        orphans("batch_without_snapshot", t("batches"), "snapshot_id", t("sources"), "id")
        .union(orphans("batch_without_master", t("batches"), "master_id", t("sources").filter("kind = 'master'"), "id"))
        .union(orphans("document_without_batch", t("invoice_documents"), "batch_id", t("batches"), "id", True))
        .union(orphans("row_without_snapshot", t("erp_rows"), "snapshot_id", t("erp_snapshot"), "snapshot_id"))
    )


@query(f"""
SELECT e.snapshot_id, e.idx, e.s AS supplier, e.n AS nif FROM (SELECT snapshot_id, idx, coalesce({sql_data('proveedor')}, {sql_data('proveedor_id')}) AS s, {sql_data('nif')} AS n FROM erp_rows) e
WHERE e.n IS NOT NULL AND EXISTS (SELECT 1 FROM supplier_rows m WHERE {sql_data('m.id')} = e.s) AND NOT EXISTS (SELECT 1 FROM supplier_rows m WHERE {sql_data('m.id')} = e.s AND {sql_data('m.nif')} = e.n)""")
def jo_identity_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ERP rows whose tax number isn't one that the master has for their supplier. The master is reduced to one row a supplier first."""
    m = table(spark, sf_dir, "supplier_rows").groupBy(data(F.col("id")).alias("supplier")).agg(F.collect_set(data(F.col("nif"))).alias("nifs"))
    e = table(spark, sf_dir, "erp_rows").select("snapshot_id", "idx", F.coalesce(data(F.col("proveedor")), data(F.col("proveedor_id"))).alias("supplier"), data(F.col("nif")).alias("nif"))
    return e.filter("nif IS NOT NULL").join(m, "supplier").filter(~F.array_contains("nifs", F.col("nif"))).select("snapshot_id", "idx", "supplier", "nif")


@query(f"""
WITH o AS (SELECT DISTINCT {sql_order(_value('"order"'))} AS p FROM invoice_documents), e AS (SELECT DISTINCT {sql_order('pedido')} AS p FROM erp_rows)
SELECT count(*) AS n_orders, count(*) FILTER (p IN (SELECT p FROM e WHERE p IS NOT NULL)) AS n_in_erp, count(*) = count(*) FILTER (p IN (SELECT p FROM e WHERE p IS NOT NULL)) AS is_subset FROM o WHERE p IS NOT NULL""")
def jo_subset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all orders of invoices are in the ERP."""
    e = table(spark, sf_dir, "erp_rows").select(order_number(F.col("pedido")).alias("p")).filter("p IS NOT NULL").distinct().withColumn("there", F.lit(1))
    o = _readings(spark, sf_dir, "order").select(order_number(F.col("order")).alias("p")).filter("p IS NOT NULL").distinct().join(e, "p", "left")
    return o.agg(F.count("*").alias("n_orders"), F.count("there").alias("n_in_erp"), (F.count("*") == F.count("there")).alias("is_subset"))


@query("""SELECT id, json_extract_string(payload, '$.version') AS version, CAST(json_extract_string(payload, '$.tolerance_eur') AS DOUBLE) AS tolerance_eur, len(CAST(json_extract(payload, '$.allowed_currencies') AS VARCHAR[])) AS n_currencies FROM sources WHERE kind = 'policy'""")
def sc_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies with a fixed schema."""
    x = table(spark, sf_dir, "sources").filter("kind = 'policy'").select("id", F.from_json("payload", "version STRING, tolerance_eur STRING, allowed_currencies ARRAY<STRING>").alias("p"))
    return x.select("id", "p.version", F.col("p.tolerance_eur").cast("double").alias("tolerance_eur"), F.size("p.allowed_currencies").cast("long").alias("n_currencies"))


@query("""SELECT source.sheet AS sheet, count(*) AS n_rows, count(DISTINCT id) AS n_ids, min(source.row) AS first_row, max(source.row) AS last_row FROM supplier_rows GROUP BY 1""")
def sc_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the composed master by the sheet that they come from."""
    return table(spark, sf_dir, "supplier_rows").groupBy(F.col("source.sheet").alias("sheet")).agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.min("source.row").alias("first_row"), F.max("source.row").alias("last_row"))


@query("""SELECT state, lower(regexp_extract(file_id, '([.][A-Za-z]+)$', 1)) AS extension, count(*) AS n, count(DISTINCT lower(replace(sha256, 'sha256:', ''))) AS n_contents FROM invoice_documents GROUP BY 1, 2""")
def ag_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by state and kind of file, and how many contents they have."""
    x = table(spark, sf_dir, "invoice_documents").groupBy("state", F.lower(F.regexp_extract("file_id", "([.][A-Za-z]+)$", 1)).alias("extension"))
    return x.agg(F.count("*").alias("n"), F.count_distinct(F.lower(F.regexp_replace("sha256", "sha256:", ""))).alias("n_contents"))


@query("""
WITH f AS (SELECT file_id, field, max(expected) AS v FROM ocr_labels WHERE expected IS NOT NULL GROUP BY 1, 2), o AS (SELECT file_id, field, max(observed) AS v FROM ocr_report WHERE observed IS NOT NULL GROUP BY 1, 2)
SELECT coalesce(f.file_id, o.file_id) AS file_id, coalesce(f.field, o.field) AS field, coalesce(f.v, o.v) AS value FROM f FULL JOIN o ON f.file_id = o.file_id AND f.field = o.field""")
def js_map_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's readings as a map, over which the map of its labels is laid: later keys win."""
    pairs = lambda t, c: table(spark, sf_dir, t).filter(F.col(c).isNotNull()).groupBy("file_id", "field").agg(F.max(c).alias("v")).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "v"))).alias(t))
    x = pairs("ocr_report", "observed").join(pairs("ocr_labels", "expected"), "file_id", "full_outer")
    empty = F.create_map().cast("map<string,string>")
    a, b = (F.coalesce(c, empty) for c in ("ocr_report", "ocr_labels"))
    under = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    return x.select("file_id", F.explode(F.map_concat(under, b)).alias("field", "value"))


QUERIES, SQL = query.queries, query.sql
