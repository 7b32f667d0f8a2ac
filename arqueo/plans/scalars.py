"""Queries of scalar functions: identifiers, money, dates, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arqueo.functions import identity
from arqueo.functions.text import amount, data, identifier, order_number
from arqueo.plans.registry import Registry, sql_amount, sql_data, sql_identifier, sql_order
from arqueo.session import table

query = Registry()

_FIELDS = "MAP<STRING, STRUCT<value: STRING, status: STRING, evidence: ARRAY<STRUCT<raw_value: STRING, method: STRING, confidence: DOUBLE, page: INT>>>>"


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each extracted field: id, field, value, status, evidence."""
    x = table(spark, sf_dir, "invoice_documents").filter("extraction IS NOT NULL")
    return x.select("id", F.explode(F.from_json(F.get_json_object("extraction", "$.fields"), _FIELDS)).alias("field", "f")).select("id", "field", "f.*")


@query(f"SELECT source.sheet AS sheet, source.row AS sheet_row, {sql_data('id')} AS id, {sql_data('nif')} AS nif, {sql_identifier('iban')} AS iban FROM supplier_rows")
def st_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "supplier_rows")
    return x.select(F.col("source.sheet").alias("sheet"), F.col("source.row").alias("sheet_row"), data(F.col("id")).alias("id"), data(F.col("nif")).alias("nif"), identifier(F.col("iban")).alias("iban"))


@query(r"""
SELECT source.row AS sheet_row, trim(regexp_replace(strip_accents(replace(replace(lower(nfc_normalize(name)), '’', ''''), 'ß', 'ss')), '[\s\p{Z}]+', ' ', 'g')) AS folded,
       regexp_replace(strip_accents(replace(lower(nfc_normalize(name)), 'ß', 'ss')), '[^a-z0-9]', '', 'g') AS header_key
FROM supplier_rows""")
def st_folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "supplier_rows")
    return x.select(F.col("source.row").alias("sheet_row"), identity.fold(F.col("name")).alias("folded"), identity.header_key(F.col("name")).alias("header_key"))


_IBAN_SQL = f"""
WITH a AS (SELECT source.row AS sheet_row, {sql_identifier('iban')} AS x FROM supplier_rows),
n AS (SELECT sheet_row, x, map {{'BE': 16, 'BR': 29, 'CH': 21, 'DE': 22, 'ES': 24, 'FR': 27, 'GB': 22, 'IT': 27, 'JP': 23, 'NL': 18, 'PT': 25}}[x[1:2]] AS n FROM a),
c AS (SELECT sheet_row, CASE WHEN regexp_matches(x, '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+$') AND length(x) >= n THEN x[1:n] END AS iban FROM n)
SELECT sheet_row, iban, CASE WHEN length(iban) > 8 THEN iban[1:4] || '…' || iban[-4:] ELSE iban END AS masked,
  CASE WHEN iban IS NOT NULL THEN list_reduce(list_prepend(0::BIGINT, list_transform(string_split(iban[5:] || iban[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN (ascii(c) - 48)::BIGINT ELSE (ascii(c) - 55)::BIGINT END)),
    lambda a, d: CASE WHEN d < 10 THEN (a * 10 + d) % 97 ELSE (a * 100 + d) % 97 END) = 1 END AS checksum_ok
FROM c"""


@query(_IBAN_SQL)
def st_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account numbers cut to their country's length, with check digits and mask."""
    x = table(spark, sf_dir, "supplier_rows").select(F.col("source.row").alias("sheet_row"), identity.iban(F.col("iban")).alias("iban"))
    return x.select("sheet_row", "iban", identity.masked(F.col("iban")).alias("masked"), F.when(F.col("iban").isNotNull(), identity.iban_valid(F.col("iban"))).alias("checksum_ok"))


# The SQL's own values.
_CURRENCY_MAP = "map {'EUR': 'EUR', '€': 'EUR', 'EURO': 'EUR', 'EUROS': 'EUR', 'USD': 'USD', 'US$': 'USD', 'GBP': 'GBP', '£': 'GBP', 'CHF': 'CHF', 'FR': 'CHF', 'JPY': 'JPY', '¥': 'JPY', 'YEN': 'JPY', 'MXN': 'MXN', 'MX$': 'MXN', 'BRL': 'BRL', 'R$': 'BRL'}"


@query(f"""
SELECT {_CURRENCY_MAP}[{sql_identifier("json_extract_string(extraction, '$.fields.currency.value')")}] AS currency, count(*) AS n_docs
FROM invoice_documents WHERE extraction IS NOT NULL GROUP BY 1""")
def st_currencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "invoice_documents").filter("extraction IS NOT NULL")
    return x.groupBy(identity.currency(F.get_json_object("extraction", "$.fields.currency.value")).alias("currency")).agg(F.count("*").alias("n_docs"))


@query(f"SELECT snapshot_id, idx, {sql_order('pedido')} AS pedido FROM erp_rows")
def st_order_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "erp_rows").select("snapshot_id", "idx", order_number(F.col("pedido")).alias("pedido"))


@query(f"SELECT snapshot_id, idx, CAST({sql_amount('coalesce(importe, importe_esperado)')} AS DOUBLE) AS importe FROM erp_rows")
def nu_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "erp_rows").select("snapshot_id", "idx", amount(F.coalesce("importe", "importe_esperado")).cast("double").alias("importe"))


def _json_field(f: str) -> str:
    return f"json_extract_string(extraction, '$.fields.{f}.value')"


@query(f"""
WITH a AS (SELECT id, {sql_amount(_json_field('base'))} AS base, {sql_amount(_json_field('tax_rate'))} AS rate, {sql_amount(_json_field('tax_amount'))} AS tax, {sql_amount(_json_field('total'))} AS total FROM invoice_documents WHERE extraction IS NOT NULL)
SELECT id, abs(round(CAST(base AS DECIMAL(18,2)) * CAST(rate AS DECIMAL(9,2)) * 0.01, 2) - CAST(tax AS DECIMAL(18,2))) <= 0.01 AS tax_ok,
       abs(CAST(base AS DECIMAL(18,2)) + CAST(tax AS DECIMAL(18,2)) - CAST(total AS DECIMAL(18,2))) <= 0.01 AS total_ok FROM a""")
def nu_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether base times rate gives the tax, rounded half up, and base plus tax the total, within a cent; null if a part is missing."""
    x = table(spark, sf_dir, "invoice_documents").filter("extraction IS NOT NULL")
    schema = "base STRUCT<value: STRING>, tax_rate STRUCT<value: STRING>, tax_amount STRUCT<value: STRING>, total STRUCT<value: STRING>"
    x = x.select("id", F.from_json(F.get_json_object("extraction", "$.fields"), schema).alias("f"))
    number = lambda k, t="decimal(18,2)": amount(F.col(f"f.{k}.value")).cast(t)
    tax = F.round(number("base") * number("tax_rate", "decimal(9,2)") / 100, 2)
    return x.select("id", (F.abs(tax - number("tax_amount")) <= 0.01).alias("tax_ok"), (F.abs(number("base") + number("tax_amount") - number("total")) <= 0.01).alias("total_ok"))


@query("SELECT event_type, CAST(median(value) AS DOUBLE) AS p50, CAST(quantile_disc(value, 0.95) AS DOUBLE) AS p95, max(value) AS most, count(*) AS n FROM events GROUP BY 1")
def nu_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and nearest-rank 95th percentile."""
    x = table(spark, sf_dir, "events").groupBy("event_type")
    return x.agg(F.median("value").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.max("value").alias("most"), F.count("*").alias("n"))


@query("""SELECT field, count(*) AS n, count(*) FILTER (status = 'OK') AS n_ok, CASE WHEN count(observed) > 0 THEN round(count(*) FILTER (observed = expected)::DOUBLE / count(observed), 6) END AS ratio FROM ocr_report GROUP BY 1""")
def nu_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios to six places, null where nothing is counted."""
    x = table(spark, sf_dir, "ocr_report").groupBy("field")
    return x.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "OK").alias("n_ok"), F.round(F.try_divide(F.count_if(F.col("observed") == F.col("expected")).cast("double"), F.count("observed")), 6).alias("ratio"))


@query("SELECT o_orderkey, replace(replace(replace(format('{:,.2f}', o_totalprice), ',', '#'), '.', ','), '#', '.') AS shown FROM orders")
def nu_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", identity.spanish_number(F.col("o_totalprice")).alias("shown"))


@query("SELECT c_custkey, sha256('{\"name\":\"' || c_name || '\",\"segment\":\"' || c_mktsegment || '\"}') AS digest FROM customer")
def st_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of canonical JSON: sorted keys, no blanks."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))), 256).alias("digest"))


@query("""SELECT json_extract_string(extraction, '$.profile') AS profile, json_extract_string(extraction, '$.version') AS version, count(*) AS n_docs, round(max(CAST(json_extract_string(extraction, '$.seconds') AS DOUBLE)), 4) AS most_seconds
FROM invoice_documents WHERE extraction IS NOT NULL GROUP BY 1, 2""")
def js_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "invoice_documents").filter("extraction IS NOT NULL").select(F.from_json("extraction", "profile STRING, version STRING, seconds DOUBLE").alias("e")).select("e.*")
    return x.groupBy("profile", "version").agg(F.count("*").alias("n_docs"), F.round(F.max("seconds"), 4).alias("most_seconds"))


@query("""
WITH a AS (SELECT unnest(CAST(json_extract(extraction, '$.pages[*].lines[*].method') AS VARCHAR[])) AS method FROM invoice_documents WHERE extraction IS NOT NULL)
SELECT trim(method, '"') AS method, count(*) AS n_lines FROM a GROUP BY 1""")
def js_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the way they were read."""
    x = table(spark, sf_dir, "invoice_documents").filter("extraction IS NOT NULL")
    x = x.select(F.explode(F.flatten(F.from_json("extraction", "pages ARRAY<STRUCT<lines: ARRAY<STRUCT<method: STRING>>>>")["pages"]["lines"])).alias("l"))
    return x.groupBy("l.method").agg(F.count("*").alias("n_lines"))


@query("""
WITH k AS (SELECT id, extraction, unnest(json_keys(extraction, '$.fields')) AS field FROM invoice_documents WHERE extraction IS NOT NULL)
SELECT id, field, json_extract_string(extraction, '$.fields.' || field || '.status') AS status, json_extract_string(extraction, '$.fields.' || field || '.value') AS value FROM k""")
def js_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields(spark, sf_dir).select("id", "field", "status", "value")


@query("""
WITH k AS (SELECT id, extraction, unnest(json_keys(extraction, '$.fields')) AS field FROM invoice_documents WHERE extraction IS NOT NULL),
e AS (SELECT id, field, CAST(json_extract(extraction, '$.fields.' || field || '.evidence') AS JSON[]) AS ev FROM k)
SELECT id, field, json_extract_string(list_filter(ev, lambda x: CAST(json_extract_string(x, '$.confidence') AS DOUBLE) < 0.85)[1], '$.raw_value') AS first_weak FROM e
WHERE len(list_filter(ev, lambda x: CAST(json_extract_string(x, '$.confidence') AS DOUBLE) < 0.85)) > 0""")
def js_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first piece of evidence that is read with little confidence."""
    x = fields(spark, sf_dir).select("id", "field", F.get(F.filter("evidence", lambda e: e["confidence"] < 0.85), F.lit(0)).alias("e"))
    return x.filter("e IS NOT NULL").select("id", "field", F.col("e.raw_value").alias("first_weak"))


QUERIES, SQL = query.queries, query.sql
