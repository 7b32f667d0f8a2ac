"""Queries p3_ and p4_: changes between snapshots, and times in one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arqueo.functions.text import amount, data, identifier, order_number
from arqueo.functions.times import with_time
from arqueo.operators.snapshots import neighbours, snapshot_changes
from arqueo.operators.timestamps import normalised_times, not_normal, union_all
from arqueo.plans.registry import sql_amount, sql_data, sql_identifier, sql_order
from arqueo.plans.times_sql import times
from arqueo.session import table, written

_ROW = "id STRING, fecha STRING, fecha_registro STRING, proveedor STRING, proveedor_id STRING, nif STRING, pedido STRING, importe STRING, importe_esperado STRING, estado STRING"
_HEAD = "complete BOOLEAN, created STRING, url STRING"


def erp_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The complete ERP snapshots that a batch uses: (headers with snapshot_id, url, created in microseconds; rows with snapshot_id
    and the row's fields, all strings). Payloads of unused snapshots aren't parsed, and the others once."""
    used = table(spark, sf_dir, "batches").select(F.col("snapshot_id").alias("id")).filter("id IS NOT NULL").distinct()
    x = table(spark, sf_dir, "sources").filter("kind = 'erp'").select("id", "payload").join(used, "id", "left_semi")
    schema = f"{_HEAD}, rows ARRAY<STRUCT<{_ROW.replace(' STRING', ': STRING')}>>"
    x = written(x.select(F.col("id").alias("snapshot_id"), F.from_json("payload", schema).alias("p")).select("snapshot_id", "p.*").filter("complete"), "payloads")
    heads = with_time(x.select("snapshot_id", "url", "created"), F.col("created"), "t")
    return heads.groupBy("snapshot_id").agg(F.min("url").alias("url"), F.min("t_at").alias("created")), x.select("snapshot_id", F.explode("rows").alias("r")).select("snapshot_id", "r.*")


def either(df: DataFrame, a: str, b: str) -> Column:
    """The first of two spellings of a column that has a value."""
    return F.coalesce(F.col(a), F.col(b))


def row_meaning(rows: DataFrame) -> DataFrame:
    """snapshot_id, row_id (the id, an identifier already) and row_hash, a 256-bit digest of what the row says, whatever its spelling.

    A value that can't be read counts as its identifier. A no-data word, null and blank are the same.
    """
    x = with_time(rows, either(rows, "fecha", "fecha_registro"), "f")

    def meaning(read: Column, c: Column) -> Column:
        return F.coalesce(read.cast("string"), data(c), F.lit(""))

    fecha, importe = either(x, "fecha", "fecha_registro"), either(x, "importe", "importe_esperado")
    parts = [
        meaning(F.col("f_date"), fecha),
        meaning(F.lit(None), either(x, "proveedor", "proveedor_id")),
        meaning(F.lit(None), F.col("nif")),
        meaning(order_number(F.col("pedido")), F.col("pedido")),
        meaning(amount(importe), importe),
        meaning(F.lit(None), F.col("estado")),
    ]
    return x.select("snapshot_id", F.col("id").alias("row_id"), F.unhex(F.sha2(F.concat_ws("\x01", *parts), 256)).alias("row_hash"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads, rows = erp_snapshots(spark, sf_dir)
    pairs = written(neighbours(heads, "url", [F.col("created"), F.col("snapshot_id")]), "pairs")
    # A payload is parsed by one task; its rows are spread by their id, by which they are compared after, before each is read.
    return snapshot_changes(row_meaning(rows.withColumn("id", identifier(F.col("id"))).repartition("id")), pairs)


def p3_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each snapshot added, removed and changed."""
    x = p3_found(spark, sf_dir)
    count = lambda kind: F.count_if(F.col("change_kind") == kind).alias(kind)
    return x.groupBy("prev_snapshot_id", "snapshot_id").agg(count("added"), count("removed"), count("changed"))


def all_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date and time of erp_rows and invoice_documents: tab, rec_key, field, raw, norm, at."""
    erp, docs = table(spark, sf_dir, "erp_rows"), table(spark, sf_dir, "invoice_documents").filter("extraction IS NOT NULL")
    docs = docs.select("id", F.from_json("extraction", "fields STRUCT<date: STRUCT<value: STRING>>, ocr_metadata STRUCT<read_at: STRING>").alias("e"))
    key = F.concat_ws("/", F.coalesce("snapshot_id", F.lit("")), F.coalesce(F.col("idx").cast("string"), F.lit("")))
    columns = lambda tab, key, **fields: ({"tab": F.lit(tab), "rec_key": key}, fields)
    a = columns("erp_rows", key, fecha=F.col("fecha"), fecha_registro=F.col("fecha_registro"))
    b = columns("invoice_documents", F.col("id"), date=F.col("e.fields.date.value"), read_at=F.col("e.ocr_metadata.read_at"))
    return union_all([normalised_times(erp, *a), normalised_times(docs, *b)])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_normal(all_times(spark, sf_dir), ["tab", "rec_key"])


def p4_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each field are normal as written, were normalised, or name no real time."""
    x = all_times(spark, sf_dir)
    return x.groupBy("tab", "field").agg(
        F.count("*").alias("n_values"),
        F.count_if(F.col("raw") == F.col("norm")).alias("n_normal"),
        F.count_if(F.col("raw") != F.col("norm")).alias("n_rewritten"),
        F.count_if(F.col("norm").isNull()).alias("n_unreadable"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
    )


_COLUMNS = ["id", "fecha", "fecha_registro", "proveedor", "proveedor_id", "nif", "pedido", "importe", "importe_esperado", "estado"]


def _text(c: str) -> str:
    return f"coalesce({sql_data(c)}, '')"


_CHANGES = f"""
j AS (SELECT id, payload FROM sources WHERE kind = 'erp' AND id IN (SELECT snapshot_id FROM batches) AND CAST(json_extract(payload, '$.complete') AS BOOLEAN)),
x AS (SELECT id AS sid, unnest(CAST(json_extract(payload, '$.rows') AS JSON[])) AS r FROM j),
rr AS (SELECT sid, {', '.join(f"json_extract_string(r, '$.{c}') AS {c}" for c in _COLUMNS)} FROM x),
tv AS (SELECT coalesce(fecha, fecha_registro) AS v FROM rr UNION ALL SELECT json_extract_string(payload, '$.created') FROM j), {times('tv')},
m AS (SELECT sid, {sql_identifier('id')} AS row_id, concat_ws('|', coalesce(CAST(day AS VARCHAR), {_text('coalesce(fecha, fecha_registro)')}), {_text('coalesce(proveedor, proveedor_id)')}, {_text('nif')}, coalesce({sql_order('pedido')}, {_text('pedido')}),
  coalesce(CAST({sql_amount('coalesce(importe, importe_esperado)')} AS VARCHAR), {_text('coalesce(importe, importe_esperado)')}), {_text('estado')}) AS h FROM rr LEFT JOIN times ON v = coalesce(fecha, fecha_registro)),
hd AS (SELECT id AS sid, min(json_extract_string(payload, '$.url')) AS url, min(us) AS us FROM j JOIN times ON v = json_extract_string(payload, '$.created') GROUP BY 1),
pr AS (SELECT sid AS a, lead(sid) OVER (PARTITION BY url ORDER BY us, sid) AS b FROM hd),
sd AS (SELECT a, b, row_id, h, false AS later FROM pr JOIN m ON sid = a WHERE b IS NOT NULL UNION ALL SELECT a, b, row_id, h, true FROM pr JOIN m ON sid = b),
g AS (SELECT a, b, row_id, list_sort(list(DISTINCT h) FILTER (NOT later)) AS p, list_sort(list(DISTINCT h) FILTER (later)) AS q FROM sd GROUP BY 1, 2, 3),
c AS (SELECT a AS prev_snapshot_id, b AS snapshot_id, row_id, CASE WHEN p IS NULL THEN 'added' WHEN q IS NULL THEN 'removed' ELSE 'changed' END AS change_kind FROM g WHERE p IS DISTINCT FROM q)"""

_ALL_TIMES = f"""
d AS (SELECT id, json_extract_string(extraction, '$.fields.date.value') AS a, json_extract_string(extraction, '$.ocr_metadata.read_at') AS b FROM invoice_documents WHERE extraction IS NOT NULL),
e AS (SELECT coalesce(snapshot_id, '') || '/' || coalesce(CAST(idx AS VARCHAR), '') AS k, fecha, fecha_registro FROM erp_rows),
al AS (SELECT 'erp_rows' AS tab, k AS rec_key, 'fecha' AS field, fecha AS v FROM e UNION ALL SELECT 'erp_rows', k, 'fecha_registro', fecha_registro FROM e UNION ALL SELECT 'invoice_documents', id, 'date', a FROM d UNION ALL SELECT 'invoice_documents', id, 'read_at', b FROM d),
tv AS (SELECT v FROM al), {times('tv')},
xt AS (SELECT tab, rec_key, field, al.v AS raw, norm, us FROM al LEFT JOIN times ON times.v = al.v WHERE al.v IS NOT NULL)"""

SQL = {
    "p3_found": f"WITH {_CHANGES} SELECT * FROM c",
    "p3_change_counts": f"WITH {_CHANGES} SELECT prev_snapshot_id, snapshot_id, count(*) FILTER (change_kind = 'added') AS added, count(*) FILTER (change_kind = 'removed') AS removed, count(*) FILTER (change_kind = 'changed') AS changed FROM c GROUP BY 1, 2",
    "p4_found": f"WITH {_ALL_TIMES} SELECT DISTINCT tab, rec_key, field, norm FROM xt WHERE norm <> raw",
    "p4_by_field": f"""WITH {_ALL_TIMES} SELECT tab, field, count(*) AS n_values, count(*) FILTER (raw = norm) AS n_normal, count(*) FILTER (raw <> norm) AS n_rewritten, count(*) FILTER (norm IS NULL) AS n_unreadable, min(us) AS first_at, max(us) AS last_at FROM xt GROUP BY 1, 2""",
}

QUERIES = {"p3_found": p3_found, "p3_change_counts": p3_change_counts, "p4_found": p4_found, "p4_by_field": p4_by_field}
