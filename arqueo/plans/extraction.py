"""Queries of readings, dates in words, lines, statuses of fields and merged readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arqueo.functions import candidates as cand
from arqueo.functions import readings as rd
from arqueo.functions import unicode as uni
from arqueo.functions import worddates
from arqueo.functions.identity import fold
from arqueo.functions.text import amount, data, identifier, order_number
from arqueo.functions.times import micros
from arqueo.operators import extraction as ex
from arqueo.operators import relational as rel
from arqueo.plans.registry import DASHES, NARROW, WIDE, Registry, sql_amount, sql_data, sql_identifier, sql_order
from arqueo.plans.scalars import fields
from arqueo.session import table

query = Registry()


def _field(f: str) -> str:
    return f"json_extract_string(extraction, '$.fields.\"{f}\".value')"


def _value(spark: SparkSession, sf_dir: str, f: str) -> DataFrame:
    """id and v, a field's value as read, of every document."""
    return table(spark, sf_dir, "invoice_documents").select("id", F.get_json_object("extraction", f"$.fields.{f}.value").alias("v"))


def _read(df: DataFrame, reading, *keys: str) -> DataFrame:
    return df.select(*keys, reading.alias("r")).select(*keys, "r.value", "r.error")


# --- readings with a reason

_X = sql_identifier("v")
_SQL_NUMBER = f"""
WITH d AS (SELECT id, {_field('invoice_number')} AS v FROM invoice_documents), x AS (SELECT id, v, {_X} AS x, replace(replace({_X}, '–', '-'), '—', '-') AS y FROM d),
r AS (SELECT id, v, CASE WHEN length(x) <= 80 AND regexp_full_match(x, '[A-Z0-9][A-Z0-9/_-][A-Z0-9/_-]+') AND regexp_matches(x, '[0-9]') AND NOT regexp_matches(x, 'FECHA|DATE|IBAN|TOTAL|PEDIDO|NIF|CIF') THEN x END AS value,
  CASE WHEN length(y) <= 80 AND regexp_full_match(y, '[A-Z0-9][A-Z0-9/_-][A-Z0-9/_-]+') AND regexp_matches(y, '[0-9]') AND NOT regexp_matches(y, 'FECHA|DATE|DATA|TOTAL|PEDIDO|ORDER|NIF|CIF|IBAN') THEN y END AS tolerant FROM x)
SELECT id, value, CASE WHEN v IS NOT NULL AND value IS NULL THEN 'mixed_fields' END AS error, tolerant FROM r"""


@query(_SQL_NUMBER)
def rd_invoice_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice numbers of both profiles; what is no number has a reason."""
    x = _value(spark, sf_dir, "invoice_number")
    return x.select("id", rd.invoice_number(F.col("v")).alias("r"), rd.invoice_number(F.col("v"), True)["value"].alias("tolerant")).select("id", "r.value", "r.error", "tolerant")


_CLEAN = rf"upper(regexp_replace(regexp_replace(translate(@, '{WIDE.replace(chr(0xFF20), "")}', '{NARROW.replace(chr(39), chr(39) * 2).replace(chr(64), "")}'), '\p{{Cf}}', '', 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"


@query(rf"""
WITH x AS (SELECT snapshot_id, idx, pedido AS v, regexp_replace({_CLEAN.replace('@', 'pedido')}, '[\s\p{{Z}}{DASHES}]+', '-', 'g') AS x FROM erp_rows)
SELECT snapshot_id, idx, CASE WHEN regexp_full_match(x, 'PO-[0-9]{{4}}-[0-9]{{3,6}}') THEN x END AS value, CASE WHEN v IS NOT NULL AND NOT regexp_full_match(x, 'PO-[0-9]{{4}}-[0-9]{{3,6}}') THEN 'no_order' END AS error FROM x""")
def rd_order_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers of three to six digits, with blanks or dashes."""
    return _read(table(spark, sf_dir, "erp_rows"), rd.order(F.col("pedido")), "snapshot_id", "idx")


@query(f"""
WITH a AS (SELECT DISTINCT {sql_identifier('nif')} AS x FROM supplier_rows UNION SELECT DISTINCT {sql_identifier('nif')} FROM erp_rows),
b AS (SELECT x, CASE WHEN regexp_matches(x, '^[XYZ]') THEN CAST(instr('XYZ', x[1]) - 1 AS VARCHAR) || substr(x, 2) ELSE x END AS p, list_transform(range(2, 9), lambda i: TRY_CAST(substr(x, i, 1) AS INTEGER)) AS d FROM a WHERE x IS NOT NULL),
c AS (SELECT x, p, (10 - (d[2] + d[4] + d[6] + list_sum(list_transform([d[1], d[3], d[5], d[7]], lambda v: v * 2 // 10 + v * 2 % 10))) % 10) % 10 AS k FROM b)
SELECT x AS nif, CASE WHEN regexp_full_match(x, '[0-9]{{2}}[.][0-9]{{3}}[.][0-9]{{3}}/[0-9]{{4}}-[0-9]{{2}}|[A-Z][0-9]{{7}}[A-Z0-9]|[0-9]{{8}}[A-Z]|[A-Z]{{2}}[A-Z0-9]{{7,14}}|[0-9]{{10,15}}') THEN 'ok' ELSE 'no_tax_id' END AS shape,
  CASE WHEN regexp_full_match(x, '[0-9]{{8}}[A-Z]|[XYZ][0-9]{{7}}[A-Z]') THEN right(x, 1) = substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(CAST(left(p, 8) AS BIGINT) % 23 AS BIGINT) + 1, 1)
    WHEN regexp_full_match(x, '[A-HJ-NP-SUVW][0-9]{{7}}[0-9A-J]') THEN right(x, 1) = CAST(k AS VARCHAR) OR right(x, 1) = substr('JABCDEFGHI', CAST(k AS BIGINT) + 1, 1) ELSE false END AS control_ok FROM c""")
def rd_tax_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tax number as it is written, with its shape and control."""
    nifs = [table(spark, sf_dir, t).select(identifier(F.col("nif")).alias("nif")) for t in ("supplier_rows", "erp_rows")]
    x = nifs[0].union(nifs[1]).filter("nif IS NOT NULL").distinct()
    return x.select("nif", F.coalesce(rd.tax_id(F.col("nif"))["error"], F.lit("ok")).alias("shape"), rd.spanish_tax_number_valid(F.col("nif")).alias("control_ok"))


_CURRENCY_SQL = """
WITH v AS (SELECT DISTINCT json_extract_string(extraction, '$.fields.currency.value') AS v FROM invoice_documents UNION SELECT expected FROM ocr_labels WHERE field = 'currency' UNION SELECT observed FROM ocr_report WHERE field = 'currency' UNION SELECT unnest(['$', 'R$', 'fr', 'Yen', '¥', 'dólares', 'us$', 'NOK'])),
x AS (SELECT v, """ + _CLEAN.replace("@", "v") + """ AS x FROM v WHERE v IS NOT NULL),
r AS (SELECT v, x, CASE WHEN x = '$' THEN NULL ELSE coalesce(MAP {'€': 'EUR', 'EURO': 'EUR', 'EUROS': 'EUR', '£': 'GBP', '¥': 'JPY', 'R$': 'BRL', 'MX$': 'MXN', 'FR': 'CHF'}[x], x) END AS standard,
  MAP {'EUR': 'EUR', 'USD': 'USD', 'GBP': 'GBP', 'CHF': 'CHF', 'JPY': 'JPY', 'BRL': 'BRL', 'MXN': 'MXN', '€': 'EUR', '£': 'GBP', 'R$': 'BRL', 'MX$': 'MXN'}[x] AS tolerant,
  MAP {'EUR': 'EUR', 'USD': 'USD', 'GBP': 'GBP', 'CHF': 'CHF', 'JPY': 'JPY', 'BRL': 'BRL', 'MXN': 'MXN', '€': 'EUR', '£': 'GBP', 'R$': 'BRL', 'MX$': 'MXN', 'EURO': 'EUR', 'EUROS': 'EUR', 'US$': 'USD', 'DOLLAR': 'USD', 'DOLLARS': 'USD', 'DÓLAR': 'USD', 'DÓLARES': 'USD', '¥': 'JPY', 'YEN': 'JPY', 'YENES': 'JPY'}[x] AS label FROM x)
SELECT v AS raw, standard, tolerant, label, CASE WHEN label IS NULL THEN CASE WHEN x = '$' THEN 'ambiguous_sign' ELSE 'no_currency' END END AS error FROM r"""


@query(_CURRENCY_SQL)
def rd_currencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every currency as it is written, read by three profiles; a few signs and words are added."""
    v = _value(spark, sf_dir, "currency").select("v")
    for t, c in (("ocr_labels", "expected"), ("ocr_report", "observed")):
        v = v.union(table(spark, sf_dir, t).filter("field = 'currency'").select(c))
    extra = spark.range(1).select(F.explode(F.array(*map(F.lit, ["$", "R$", "fr", "Yen", "¥", "dólares", "us$", "NOK"]))).alias("v"))
    x = v.union(extra).filter("v IS NOT NULL").distinct()
    label = rd.currency(F.col("v"), "label")
    return x.select(F.col("v").alias("raw"), rd.currency(F.col("v"))["value"].alias("standard"), rd.currency(F.col("v"), "tolerant")["value"].alias("tolerant"), label["value"].alias("label"), label["error"].alias("error"))


@query(r"""
WITH a AS (SELECT snapshot_id, idx, coalesce(importe, importe_esperado) AS v FROM erp_rows),
b AS (SELECT *, regexp_replace(regexp_extract(regexp_replace(v, '\s', '', 'g'), '-?[0-9][0-9.,]*'), '[.,]+$', '') AS x FROM a),
c AS (SELECT *, CASE WHEN contains(x, ',') AND contains(x, '.') THEN CASE WHEN instr(reverse(x), ',') < instr(reverse(x), '.') THEN replace(replace(x, '.', ''), ',', '.') ELSE replace(x, ',', '') END
  WHEN contains(x, ',') THEN replace(x, ',', '.') WHEN regexp_full_match(x, '-?[0-9]{1,3}([.][0-9]{3})+') THEN replace(x, '.', '') ELSE x END AS y FROM b)
SELECT snapshot_id, idx, CAST(TRY_CAST(y AS DECIMAL(38,6)) AS DOUBLE) AS permissive FROM c""")
def rd_permissive_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "erp_rows")
    return x.select("snapshot_id", "idx", rd.permissive_amount(F.coalesce("importe", "importe_esperado")).cast("double").alias("permissive"))


@query(f"SELECT id, nfc_normalize(file_id) AS file_name, regexp_replace(nfc_normalize(file_id), '[^A-Za-z0-9._-]+', '_', 'g') AS safe_id, replace(replace(replace(replace(file_id, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS xml FROM invoice_documents")
def st_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "invoice_documents")
    return x.select("id", uni.nfc(F.col("file_id")).alias("file_name"), rd.safe_id(uni.nfc(F.col("file_id"))).alias("safe_id"), rd.xml_escaped(F.col("file_id")).alias("xml"))


# --- dates in words

_LANG = "[" + ", ".join(f"{{l: '{k}', w: [{', '.join(chr(39) + w.replace('|', chr(39) + ', ' + chr(39)) + chr(39) for w in ws.split())}]}}" for k, ws in {
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre|setiembre octubre noviembre diciembre", "ca": "gener febrer marc abril maig juny juliol agost setembre octubre novembre desembre",
    "pt": "janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro", "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "fr": "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre", "de": "januar februar marz april mai juni juli august september oktober november dezember",
    "en": "january|jan february|feb march|mar april|apr may june|jun july|jul august|aug september|sep|sept october|oct november|nov december|dec"}.items()) + "]"
_MONTH_NUMBERS = "MAP {" + ", ".join(f"'{w}': {i + 1}" for i, ws in enumerate([
    "enero gener janeiro gennaio janvier januar january jan", "febrero febrer fevereiro febbraio fevrier februar february feb", "marzo marc marco mars marz march mar", "abril aprile avril april apr", "mayo maig maio maggio mai may",
    "junio juny junho giugno juin juni june jun", "julio juliol julho luglio juillet juli july jul", "agosto agost aout august aug", "septiembre setiembre setembre setembro settembre septembre september sep sept",
    "octubre outubro ottobre octobre oktober october oct", "noviembre novembre novembro november nov", "diciembre desembre dezembro dicembre decembre dezember december dec"]) for w in ws.split()) + "}"
_DATES_SQL = rf"""
WITH d AS (SELECT DISTINCT v FROM (SELECT {_field('date')} AS v FROM invoice_documents UNION ALL SELECT fecha FROM erp_rows UNION ALL SELECT fecha_registro FROM erp_rows) WHERE v IS NOT NULL),
s AS (SELECT v, regexp_replace(v, '^[\s\p{{Z}}\p{{Cf}}]+|[\s\p{{Z}}\p{{Cf}}]+$', '', 'g') AS s FROM d), f AS (SELECT v, s, trim(regexp_replace(replace(strip_accents(lower(s)), '’', ''''), '[\s\p{{Z}}]+', ' ', 'g')) AS f FROM s),
p AS (SELECT v, s, regexp_extract(f, '^(?:(?:el|le|am|the|of|de|del|den)[ ,]+|[dl]''[ ,]*)*([0-9]{{1,2}})(?:[ ,]+(?:(?:el|le|am|the|of|de|del|den)[ ,]+|[dl]''[ ,]*)*|[ ,]*[dl]''[ ,]*)([a-z]+)(?:[ ,]+(?:(?:el|le|am|the|of|de|del|den)[ ,]+|[dl]''[ ,]*)*|[ ,]*[dl]''[ ,]*)([0-9]{{4}})$', ['d', 'm', 'y']) AS p FROM f),
r AS (SELECT v, s, p, CASE WHEN regexp_full_match(s, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN try_strptime(s, '%Y-%m-%d') WHEN regexp_full_match(s, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') THEN try_strptime(s, '%d/%m/%Y')
  WHEN regexp_full_match(s, '[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}') THEN try_strptime(s, '%d-%m-%Y') WHEN regexp_full_match(s, '[0-9]{{1,2}}[.][0-9]{{1,2}}[.][0-9]{{4}}') THEN try_strptime(s, '%d.%m.%Y') END AS n,
  try_strptime(p.y || '-' || {_MONTH_NUMBERS}[p.m] || '-' || p.d, '%Y-%m-%d') AS w FROM p)"""


@query(_DATES_SQL + f" SELECT v AS raw, CAST(coalesce(n, w) AS DATE) AS date, CASE WHEN n IS NULL AND w IS NOT NULL THEN list_filter({_LANG}, lambda x: list_contains(x.w, p.m))[1].l END AS language FROM r")
def dt_invoice_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct text of a date or time, as the date of an invoice: digits in four orders, or words in seven languages; null for all else."""
    v = _value(spark, sf_dir, "date").select("v")
    erp = table(spark, sf_dir, "erp_rows")
    x = v.union(erp.select("fecha")).union(erp.select("fecha_registro")).filter("v IS NOT NULL").distinct()
    return worddates.with_invoice_date(x, F.col("v"), "r").select(F.col("v").alias("raw"), F.col("r_date").alias("date"), F.col("r_language").alias("language"))


# --- lines, statuses, readers


@query(r"""
WITH l AS (SELECT id, CAST(json_extract_string(p, '$.page') AS INTEGER) AS page, unnest(CAST(json_extract(p, '$.lines') AS JSON[])) AS l FROM (SELECT id, unnest(CAST(json_extract(extraction, '$.pages') AS JSON[])) AS p FROM invoice_documents WHERE extraction IS NOT NULL)),
t AS (SELECT id, page, CAST(json_extract_string(l, '$.line_no') AS INTEGER) AS n, list_filter(string_split(json_extract_string(l, '$.raw_text'), ' '), lambda w: w <> '') AS ws FROM l),
r AS (SELECT id, page, row_number() OVER (PARTITION BY id, page ORDER BY n) AS line_no, array_to_string(list_transform(ws, lambda w: trim(regexp_replace(regexp_replace(w, '\p{Cf}', '', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))), ' ') AS text, array_to_string(ws, ' ') AS raw_text, len(ws) AS n_words FROM t WHERE len(ws) > 0)
SELECT id, page, line_no, regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text, raw_text, n_words FROM r""")
def ex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from words with boxes. The tables have none, so the words of each line get boxes that lie a little askew."""
    schema = "pages ARRAY<STRUCT<page: INT, lines: ARRAY<STRUCT<line_no: INT, raw_text: STRING>>>>"
    x = table(spark, sf_dir, "invoice_documents").filter("extraction IS NOT NULL").select("id", F.explode(F.from_json("extraction", schema)["pages"]).alias("p"))
    x = x.select("id", "p.page", F.explode("p.lines").alias("l")).select("id", "page", "l.line_no", F.posexplode(F.filter(F.split("l.raw_text", " "), lambda w: w != "")).alias("i", "text"))
    top = F.col("line_no") * 20 + F.pmod(F.xxhash64("id", "line_no", "i"), F.lit(4))
    words = x.select("id", "page", "text", (F.col("i") * 50.0).alias("left"), top.cast("double").alias("top"), (F.col("i") * 50.0 + 40).alias("right"), (top + 10).cast("double").alias("bottom"))
    return ex.group_lines(words, ["id", "page"]).select("id", "page", F.col("line_no").cast("long").alias("line_no"), "text", "raw_text", F.size("words").cast("long").alias("n_words"))


_EVIDENCE = """
WITH k AS (SELECT id, extraction, unnest(json_keys(extraction, '$.fields')) AS field FROM invoice_documents WHERE extraction IS NOT NULL),
u AS (SELECT id, field, unnest(CAST(json_extract(extraction, '$.fields."' || field || '".evidence') AS JSON[])) AS x, generate_subscripts(CAST(json_extract(extraction, '$.fields."' || field || '".evidence') AS JSON[]), 1) AS pos FROM k),
c AS (SELECT id, field, pos, json_extract_string(x, '$.raw_value') AS v, CAST(json_extract_string(x, '$.confidence') AS DOUBLE) AS conf, json_extract_string(x, '$.method') AS method FROM u),
d AS (SELECT id, unnest(['invoice_number', 'supplier_nif', 'iban', 'order', 'date', 'base', 'tax_rate', 'tax_amount', 'total', 'currency']) AS field FROM invoice_documents WHERE extraction IS NOT NULL),"""


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, documents) of all extractions; text that is read as no amount or no number is an error."""
    x = fields(spark, sf_dir).select("id", "field", F.posexplode("evidence").alias("pos", "e"))
    docs = table(spark, sf_dir, "invoice_documents").filter("extraction IS NOT NULL").select("id")
    return x.select("id", "field", "pos", F.col("e.raw_value").alias("value"), F.lit(None).cast("string").alias("error"), F.col("e.confidence").alias("confidence"), F.col("e.method").alias("method")), docs


@query(_EVIDENCE + """
g AS (SELECT id, field, count(*) AS n, count(DISTINCT v) AS k, min(conf) AS lo, arg_min(v, pos) FILTER (v IS NOT NULL) AS first FROM c GROUP BY 1, 2),
w AS (SELECT c.id, c.field, min(conf) < 0.84 AS weak FROM c JOIN g ON g.id = c.id AND g.field = c.field AND c.v = g.first GROUP BY 1, 2),
r AS (SELECT d.id, d.field, g.first, CASE WHEN n IS NULL THEN 'MISSING' WHEN k <> 1 THEN 'CONFLICT' WHEN lo < 0.85 THEN 'LOW_QUALITY' ELSE 'OK' END AS standard, CASE WHEN n IS NULL THEN 'MISSING' WHEN weak THEN 'LOW_QUALITY' WHEN k > 1 THEN 'CONFLICT' WHEN k = 1 THEN 'OK' ELSE 'MISSING' END AS tolerant
  FROM d LEFT JOIN g ON d.id = g.id AND d.field = g.field LEFT JOIN w ON w.id = d.id AND w.field = d.field)
SELECT id, field, standard, CASE WHEN standard IN ('OK', 'LOW_QUALITY') THEN first END AS standard_value, tolerant, CASE WHEN tolerant = 'OK' THEN first END AS tolerant_value FROM r""")
def ex_field_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and value of the ten fields of every document by both profiles."""
    c, docs = _evidence(spark, sf_dir)
    a, b = (ex.resolved(c, docs, "id", t).select("id", "field", F.col("status").alias(k), F.col("value").alias(f"{k}_value")) for k, t in (("standard", False), ("tolerant", True)))
    return a.join(b, ["id", "field"])


@query("""
WITH n AS (SELECT file_id, field, max(observed) AS v, CASE WHEN bool_and(status = 'OK') THEN 'OK' ELSE min(status) FILTER (status <> 'OK') END AS s FROM ocr_report GROUP BY 1, 2),
w AS (SELECT file_id, field, max(expected) AS v, CASE WHEN count(DISTINCT expected) = 1 THEN 'OK' WHEN count(expected) = 0 THEN 'MISSING' ELSE 'CONFLICT' END AS s, CASE WHEN bool_or(len(review_flags) > 0) THEN 0.9 ELSE 1.0 END AS conf FROM ocr_labels GROUP BY 1, 2),
x AS (SELECT coalesce(n.file_id, w.file_id) AS file_id, coalesce(n.field, w.field) AS field, coalesce(n.s, 'MISSING') AS a, n.v AS av, w.s AS b, w.v AS bv, CASE WHEN w.v IS NOT NULL AND w.v IS DISTINCT FROM n.v THEN conf END AS sure FROM n FULL JOIN w ON n.file_id = w.file_id AND n.field = w.field)
SELECT file_id, field, CASE WHEN a = 'OK' AND sure >= 0.92 THEN 'CONFLICT' WHEN a = 'OK' THEN 'OK' WHEN b = 'OK' THEN 'OK' WHEN a = 'MISSING' AND b IN ('LOW_QUALITY', 'INVALID') THEN b ELSE a END AS status,
  CASE WHEN a = 'OK' AND sure >= 0.92 THEN NULL WHEN a = 'OK' THEN av WHEN b = 'OK' THEN bv WHEN a = 'MISSING' AND b IN ('LOW_QUALITY', 'INVALID') THEN NULL ELSE av END AS value, CASE WHEN a = 'OK' AND sure >= 0.92 THEN 'witness_conflict' WHEN a = 'OK' AND sure IS NOT NULL THEN 'witness_weak_conflict' END AS warning FROM x""")
def ex_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of ocr_report with the labels as a second reader, sure where no flag asks for a review."""
    bad = F.col("status") != "OK"
    n = table(spark, sf_dir, "ocr_report").groupBy("file_id", "field").agg(F.max("observed").alias("value"), F.when(F.count_if(bad) == 0, "OK").otherwise(F.min(F.when(bad, F.col("status")))).alias("status"))
    w = table(spark, sf_dir, "ocr_labels").groupBy("file_id", "field").agg(F.max("expected").alias("value"), F.when(F.count_distinct("expected") == 1, "OK").when(F.count("expected") == 0, "MISSING").otherwise("CONFLICT").alias("status"), F.when(F.max(F.size("review_flags")) > 0, 0.9).otherwise(1.0).alias("confidence"))
    c = n.select("file_id", "field", F.lit("native").alias("reader"), "value", F.lit(None).cast("double").alias("confidence")).union(w.select("file_id", "field", F.lit("witness"), "value", "confidence"))
    return ex.merged_readers(n.select("file_id", "field", "status", "value"), w.select("file_id", "field", "status", "value"), c, "file_id")


_MODEL_X = sql_identifier("v")


@query(rf"""
WITH f AS (SELECT file_id, field, max(observed) AS v, CASE WHEN bool_and(status = 'OK') THEN 'OK' ELSE min(status) FILTER (status <> 'OK') END AS s FROM ocr_report WHERE field <> 'currency' GROUP BY 1, 2),
l AS (SELECT file_id, field, max(expected) AS v, max(expected) || ' EUR' AS ev FROM ocr_labels WHERE expected IS NOT NULL AND field <> 'currency' GROUP BY 1, 2),
m AS (SELECT file_id, field, v, CASE WHEN field = 'supplier_nif' AND NOT regexp_full_match({_MODEL_X}, '[A-Z][0-9]{{7}}[0-9A-Z]|[0-9]{{8}}[A-Z]') THEN 'shape' WHEN field = 'iban' AND NOT regexp_full_match({_MODEL_X}, 'ES[0-9]{{22}}') THEN 'shape'
  WHEN field = 'order' AND NOT regexp_full_match({_MODEL_X}, 'PO-[0-9]{{4}}-[0-9]{{3,6}}') THEN 'shape' WHEN field IN ('base', 'tax_amount', 'total', 'tax_rate') AND (TRY_CAST(v AS DECIMAL(38,6)) IS NULL OR NOT regexp_full_match(v, '[0-9]+([.][0-9]{{1,2}})?')) THEN 'inferred' END AS err FROM l)
SELECT f.file_id, f.field, m.err AS rejected, CASE WHEN f.s = 'OK' AND m.v IS NOT NULL AND m.err IS NULL AND m.v IS DISTINCT FROM f.v THEN 'CONFLICT' WHEN f.s = 'OK' THEN 'OK' WHEN m.v IS NOT NULL AND m.err IS NULL THEN 'OK' WHEN m.err IS NOT NULL AND f.s = 'MISSING' THEN 'INVALID' ELSE f.s END AS status,
  CASE WHEN f.s = 'OK' AND m.v IS NOT NULL AND m.err IS NULL AND m.v IS DISTINCT FROM f.v THEN NULL WHEN f.s = 'OK' THEN f.v WHEN m.v IS NOT NULL AND m.err IS NULL THEN m.v ELSE f.v END AS value FROM f LEFT JOIN m ON f.file_id = m.file_id AND f.field = m.field""")
def ex_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of ocr_report with the labels as what a model read, of which some are rejected."""
    bad = F.col("status") != "OK"
    f = table(spark, sf_dir, "ocr_report").filter("field <> 'currency'").groupBy("file_id", "field").agg(F.max("observed").alias("value"), F.when(F.count_if(bad) == 0, "OK").otherwise(F.min(F.when(bad, F.col("status")))).alias("status"))
    m = table(spark, sf_dir, "ocr_labels").filter("expected IS NOT NULL AND field <> 'currency'").groupBy("file_id", "field").agg(F.max("expected").alias("v"))
    m = m.withColumn("error", ex.rejected(F.col("field"), F.col("v"), F.concat("v", F.lit(" EUR"))))
    merged = ex.merged_model(f, m.select("file_id", "field", F.when(F.col("error").isNull(), F.col("v")).alias("value"), "error"), "file_id")
    return merged.join(m.select("file_id", "field", F.col("error").alias("rejected")), ["file_id", "field"], "left").select("file_id", "field", "rejected", "status", "value")


@query("""
WITH e AS (SELECT event_id AS i, user_id AS page, CAST(event_id * 37 % 600 AS DOUBLE) AS l, CAST(event_id * 11 % 90 + 5 AS DOUBLE) AS w, CAST(event_id * 53 % 800 AS DOUBLE) AS t FROM events)
SELECT b.page, b.i AS box_id, s.i AS stroke_id FROM e b JOIN e s ON b.page = s.page AND b.i % 2 = 0 AND s.i % 2 = 1 AND b.l < s.l + s.w AND b.l + b.w > s.l AND s.t + 3 BETWEEN b.t AND b.t + 14""")
def ex_struck_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts that strokes cross. The tables have no boxes: events stand for them, even ones as amounts and odd ones as strokes."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("page"), (i * 37 % 600).cast("double").alias("left"), (i * 11 % 90 + 5).cast("double").alias("w"), (i * 53 % 800).cast("double").alias("top"))
    e = e.withColumn("right", F.col("left") + F.col("w"))
    boxes = e.filter("event_id % 2 = 0").select("page", F.col("event_id").alias("box_id"), "left", "top", "right", (F.col("top") + 14).alias("bottom"))
    strokes = e.filter("event_id % 2 = 1").select("page", F.col("event_id").alias("stroke_id"), "left", "top", "right", (F.col("top") + 6).alias("bottom"))
    return ex.struck_out(boxes, strokes, ["page"])


@query("""
WITH k AS (SELECT id, extraction, unnest(json_keys(extraction, '$.fields')) AS field FROM invoice_documents WHERE extraction IS NOT NULL),
e AS (SELECT id, field, json_extract_string(extraction, '$.fields."' || field || '".value') AS v, CAST(json_extract(extraction, '$.fields."' || field || '".evidence') AS JSON[]) AS ev FROM k),
o AS (SELECT id, field, list_filter(ev, lambda x: json_extract_string(x, '$.raw_value') = v) AS own FROM e)
SELECT id, field, coalesce(len(own) > 0 AND len(list_filter(own, lambda x: json_extract_string(x, '$.method') <> 'text')) = 0, false) AS by_text_only FROM o""")
def js_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all evidence of a field's value was read from text."""
    return fields(spark, sf_dir).select("id", "field", ex.supported(F.col("evidence"), F.col("value"), ["text"]).alias("by_text_only"))


# --- evaluation with labels and splits

_NORM = f"""CASE WHEN field IN ('invoice_number', 'supplier_nif', 'iban', 'order') THEN {sql_identifier('l0.v')} WHEN field = 'date' THEN CAST(CAST(coalesce(n, w) AS DATE) AS VARCHAR)
  WHEN field = 'currency' THEN MAP {{'EUR': 'EUR', '€': 'EUR', 'EURO': 'EUR', 'EUROS': 'EUR', 'USD': 'USD', 'GBP': 'GBP', 'CHF': 'CHF', 'JPY': 'JPY', 'BRL': 'BRL', 'MXN': 'MXN'}}[{sql_identifier('l0.v')}]
  ELSE regexp_replace(CAST(CASE WHEN regexp_full_match({sql_identifier('l0.v')}, '[+-]?([0-9]+([.,][0-9]{{1,2}})?|[0-9]{{1,3}}([.][0-9]{{3}})+,[0-9]{{2}}|[0-9]{{1,3}}(,[0-9]{{3}})+[.][0-9]{{2}})') THEN {sql_amount('l0.v')} END AS VARCHAR), '[.]?0+$', '') END"""
_LABEL_DATES = _DATES_SQL.replace("SELECT fecha FROM erp_rows UNION ALL SELECT fecha_registro FROM erp_rows", "SELECT expected FROM ocr_labels WHERE field = 'date' UNION ALL SELECT observed FROM ocr_report WHERE field = 'date'")


@query(f"""{_LABEL_DATES},
l0 AS (SELECT file_id, field, max(expected) AS v FROM ocr_labels GROUP BY 1, 2), l AS (SELECT file_id, field, l0.v AS raw, {_NORM} AS expected FROM l0 LEFT JOIN r ON r.v = l0.v AND field = 'date'),
sx AS (SELECT file_id, min(CASE lower({sql_data('split')}) WHEN 'val' THEN 'validation' ELSE lower({sql_data('split')}) END) AS split FROM ocr_splits GROUP BY 1),
o0 AS (SELECT file_id, field, max(observed) AS v, min(status) AS st, bool_and(status = 'OK') AS ok FROM ocr_report GROUP BY 1, 2), o AS (SELECT file_id, field, o0.v AS raw, ok, st, {_NORM.replace('l0.', 'o0.')} AS actual FROM o0 LEFT JOIN r ON r.v = o0.v AND field = 'date'),
j AS (SELECT sx.split, l.field, CASE WHEN l.raw IS NULL THEN o.st = 'MISSING' AND o.raw IS NULL ELSE o.ok AND o.actual IS NOT NULL AND o.actual = l.expected END AS exact, coalesce(o.ok AND o.actual IS NOT NULL, false) AS accepted FROM l JOIN sx ON sx.file_id = l.file_id LEFT JOIN o ON o.file_id = l.file_id AND o.field = l.field WHERE sx.split IS NOT NULL)
SELECT coalesce(split, 'all') AS split, field, count(*) AS labelled, count(*) FILTER (exact) AS exact, count(*) FILTER (accepted) AS accepted, count(*) FILTER (accepted AND exact) AS accepted_exact FROM j GROUP BY GROUPING SETS ((split, field), (field))""")
def jo_label_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with their file's split and reading, compared in each field's normal form; an absent label is met by a missing reading."""
    labels = table(spark, sf_dir, "ocr_labels").groupBy("file_id", "field").agg(F.max("expected").alias("raw"))
    name = F.lower(data(F.col("split")))
    s = table(spark, sf_dir, "ocr_splits").groupBy("file_id").agg(F.min(F.when(name == "val", "validation").otherwise(name)).alias("split")).filter("split IS NOT NULL")
    o = table(spark, sf_dir, "ocr_report").groupBy("file_id", "field").agg(F.max("observed").alias("seen"), F.min("status").alias("st"), (F.count_if(F.col("status") == "OK") == F.count("*")).alias("ok"))
    x = labels.join(s, "file_id").join(o, ["file_id", "field"], "left")
    x = rd.with_normal_value(rd.with_normal_value(x, F.col("field"), F.col("raw"), "e"), F.col("field"), F.col("seen"), "a")
    x = x.withColumnsRenamed({"e_value": "expected", "a_value": "actual"})
    accepted = F.coalesce(F.col("ok") & F.col("actual").isNotNull(), F.lit(False))
    exact = F.coalesce(F.when(F.col("raw").isNull(), (F.col("st") == "MISSING") & F.col("seen").isNull()).otherwise(accepted & (F.col("actual") == F.col("expected"))), F.lit(False))
    x = x.select("split", "field", exact.alias("exact"), accepted.alias("accepted"))
    x = x.groupingSets([["split", "field"], ["field"]], "split", "field").agg(F.count("*").alias("labelled"), F.count_if("exact").alias("exact"), F.count_if("accepted").alias("accepted"), F.count_if(F.col("accepted") & F.col("exact")).alias("accepted_exact"))
    return x.select(F.coalesce("split", F.lit("all")).alias("split"), "field", "labelled", "exact", "accepted", "accepted_exact")


# --- aggregations, windows, chains


@query(f"""
WITH r AS (SELECT {sql_order('pedido')} AS pedido, {sql_data('proveedor')} AS p1, {sql_data('proveedor_id')} AS p2, {sql_data('nif')} AS nif, CAST({sql_amount('importe')} AS DECIMAL(18,2)) AS i1, CAST({sql_amount('importe_esperado')} AS DECIMAL(18,2)) AS i2, {sql_data('estado')} AS estado, snapshot_id, idx FROM erp_rows),
c AS (SELECT *, coalesce(p1, p2) AS supplier, coalesce(i1, i2) AS total, CASE WHEN coalesce(p1, p2) IS NULL THEN 0 WHEN p1 <> p2 THEN 1 WHEN nif IS NULL THEN 2 WHEN coalesce(i1, i2) IS NULL THEN 3 WHEN i1 <> i2 THEN 4 WHEN estado IS NULL THEN 5 END AS bad FROM r WHERE pedido IS NOT NULL),
g AS (SELECT pedido, min(bad) AS bad, count(DISTINCT {{s: supplier, n: nif, t: total}}) AS k, arg_max({{p: supplier, n: nif, t: total}}, {{s: snapshot_id, i: idx}}) AS v, max({{s: snapshot_id, i: idx}}) AS o FROM c GROUP BY 1),
r2 AS (SELECT *, CASE WHEN bad IS NOT NULL THEN (['missing_supplier', 'conflicting_supplier', 'missing_nif', 'missing_amount', 'conflicting_amount', 'ambiguous_state'])[bad + 1] WHEN k > 1 THEN 'conflicting' ELSE 'consistent' END AS reason FROM g)
SELECT pedido, reason, CASE WHEN reason = 'consistent' THEN v.p END AS supplier, CASE WHEN reason = 'consistent' THEN v.n END AS nif, CASE WHEN reason = 'consistent' THEN CAST(v.t AS DOUBLE) END AS total, CASE WHEN reason = 'consistent' THEN o.s END AS snapshot_id, CASE WHEN reason = 'consistent' THEN o.i END AS idx FROM r2""")
def wi_latest_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's latest row, if all its rows are valid and agree on supplier, tax number and amount."""
    x = table(spark, sf_dir, "erp_rows").select(
        order_number(F.col("pedido")).alias("pedido"), data(F.col("proveedor")).alias("p1"), data(F.col("proveedor_id")).alias("p2"), data(F.col("nif")).alias("nif"), amount(F.col("importe")).cast("decimal(18,2)").alias("i1"),
        amount(F.col("importe_esperado")).cast("decimal(18,2)").alias("i2"), data(F.col("estado")).alias("estado"), "snapshot_id", "idx",
    ).filter("pedido IS NOT NULL")
    x = x.withColumns({"supplier": F.coalesce("p1", "p2"), "total": F.coalesce("i1", "i2")})
    differ = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    checks = {"missing_supplier": F.col("supplier").isNull(), "conflicting_supplier": differ("p1", "p2"), "missing_nif": F.col("nif").isNull(), "missing_amount": F.col("total").isNull(), "conflicting_amount": differ("i1", "i2"), "ambiguous_state": F.col("estado").isNull()}
    return ex.latest_consistent(x, "pedido", ["snapshot_id", "idx"], ["supplier", "nif", "total"], checks).withColumn("total", F.col("total").cast("double"))


@query("""
WITH e AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW) AS n_span, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, user_id, n_span, n_span > 2 AS over_limit, n_span > 2 OR n % 10 = 0 AS failed FROM e""")
def wi_rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user beyond two within two hours, and every tenth, fail."""
    events = table(spark, sf_dir, "events")
    x = events.select("event_id", "user_id", micros(events, "ts").alias("at"))
    return ex.rate_limited(x, "user_id", "at", 2, 7_200_000_000, 10).select("event_id", "user_id", "n_span", "over_limit", "failed")


_CHAIN = """
WITH RECURSIVE o AS (SELECT event_id, user_id, event_id || '|' || event_type AS body, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
ch AS (SELECT event_id, user_id, body, n, repeat('0', 64) AS prev, sha256(repeat('0', 64) || body) AS own FROM o WHERE n = 1 UNION ALL SELECT o.event_id, o.user_id, o.body, o.n, ch.own, sha256(ch.own || o.body) FROM ch JOIN o ON o.user_id = ch.user_id AND o.n = ch.n + 1)"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select("event_id", "user_id", F.concat(F.col("event_id").cast("string"), F.lit("|"), "event_type").alias("body"))
    return rel.sealed(x, "user_id", "event_id", "body")


@query(_CHAIN + "SELECT event_id, user_id, prev AS prev_hash, own AS own_hash FROM ch")
def sk_sealed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a hash chain: a hash is that of the one before and the body."""
    return _chain(spark, sf_dir).select("event_id", "user_id", "prev_hash", "own_hash")


@query(_CHAIN + """, sp AS (SELECT event_id, user_id, n, own, CASE WHEN event_id % 97 = 0 THEN 'spoilt' ELSE prev END AS prev, CASE WHEN event_id % 89 = 0 THEN body || '!' ELSE body END AS body FROM ch),
l AS (SELECT *, coalesce(lag(own) OVER (PARTITION BY user_id ORDER BY event_id), repeat('0', 64)) AS before FROM sp)
SELECT event_id, user_id, prev <> before AS bad_link, own <> sha256(prev || body) AS bad_hash FROM l WHERE prev <> before OR own <> sha256(prev || body)""")
def wi_chain_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chains with some links and bodies spoilt, and what the check finds: a link that isn't the hash before, or a hash that isn't that of link and body."""
    x = _chain(spark, sf_dir)
    x = x.withColumns({"prev_hash": F.when(F.col("event_id") % 97 == 0, "spoilt").otherwise(F.col("prev_hash")), "body": F.when(F.col("event_id") % 89 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body"))})
    return rel.chain_breaks(x, "user_id", "event_id", "prev_hash", "own_hash", F.col("body")).select("event_id", "user_id", "bad_link", "bad_hash")


@query("""
WITH d AS (SELECT CAST(json_extract_string(extraction, '$.seconds') AS DOUBLE) AS s, list_contains(list_transform(CAST(json_extract(extraction, '$.pages[*].lines[*].method') AS VARCHAR[]), lambda m: trim(m, '"')), 'ocr') AS ocr FROM invoice_documents WHERE extraction IS NOT NULL),
g AS (SELECT 'all' AS part, s FROM d UNION ALL SELECT CASE WHEN ocr THEN 'ocr' ELSE 'text' END, s FROM d)
SELECT part, count(*) AS n, round(median(s), 4) AS p50, round(quantile_disc(s, 0.95), 4) AS p95, round(sum(s), 3) AS total FROM g GROUP BY 1""")
def ag_reading_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of reading, of all documents and of those with and without recognised characters."""
    x = table(spark, sf_dir, "invoice_documents").filter("extraction IS NOT NULL").select(F.from_json("extraction", "seconds DOUBLE, pages ARRAY<STRUCT<lines: ARRAY<STRUCT<method: STRING>>>>").alias("e"))
    ocr = F.coalesce(F.array_contains(F.flatten("e.pages.lines")["method"], "ocr"), F.lit(False))
    x = x.select(F.col("e.seconds").alias("s"), F.explode(F.array(F.lit("all"), F.when(ocr, "ocr").otherwise("text"))).alias("part"))
    return x.groupBy("part").agg(F.count("*").alias("n"), F.round(F.median("s"), 4).alias("p50"), F.round(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY s)"), 4).alias("p95"), F.round(F.sum("s"), 3).alias("total"))


@query("""
SELECT event_type AS stage, count(*) AS n, round(sum(value), 3) AS seconds, round(sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END), 3) AS human_seconds, round(sum(CASE WHEN event_type = 'view' THEN 0 ELSE value END), 3) AS compute_seconds FROM events GROUP BY GROUPING SETS ((event_type), ())""".replace("event_type AS stage", "coalesce(event_type, 'all') AS stage"))
def ag_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time facts by stage and in all, parted into those of people (here: views) and machines."""
    human = F.col("event_type") == "view"
    x = table(spark, sf_dir, "events").groupingSets([["event_type"], []], "event_type")
    zero = F.lit(0.0)
    x = x.agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("seconds"), F.round(F.sum(F.when(human, F.col("value")).otherwise(zero)), 3).alias("human_seconds"), F.round(F.sum(F.when(human, zero).otherwise(F.col("value"))), 3).alias("compute_seconds"))
    return x.select(F.coalesce("event_type", F.lit("all")).alias("stage"), "n", "seconds", "human_seconds", "compute_seconds")


@query("""
WITH w AS (SELECT id, unnest(CAST(json_extract(extraction, '$.warnings') AS VARCHAR[])) AS code FROM invoice_documents WHERE extraction IS NOT NULL)
SELECT trim(code, '"') AS code, count(*) AS n, count(DISTINCT id) AS n_docs, row_number() OVER (ORDER BY count(*) DESC, trim(code, '"')) AS place FROM w GROUP BY code""")
def ag_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings by code, the most frequent first; there are as many rows as codes."""
    from pyspark.sql.window import Window

    x = table(spark, sf_dir, "invoice_documents").filter("extraction IS NOT NULL").select("id", F.explode(F.from_json("extraction", "warnings ARRAY<STRING>")["warnings"]).alias("code"))
    x = x.groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_docs"))
    return x.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "code")).cast("long"))


@query("""
WITH k AS (SELECT sha256(field || '|' || status || '|' || coalesce(normalization_error, '')) AS group_id, file_id FROM ocr_report WHERE status <> 'OK'), m AS (SELECT DISTINCT group_id, file_id FROM k), g AS (SELECT group_id, count(*) AS size FROM m GROUP BY 1)
SELECT m.group_id, m.file_id, size AS group_size FROM m JOIN g ON g.group_id = m.group_id""")
def ag_cause_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each group of one cause, with the group's size; a row a file, so that no group is held as one list."""
    x = table(spark, sf_dir, "ocr_report").filter("status <> 'OK'")
    key = F.sha2(F.concat("field", F.lit("|"), "status", F.lit("|"), F.coalesce("normalization_error", F.lit(""))), 256)
    m = x.select(key.alias("group_id"), "file_id").distinct()
    return m.join(m.groupBy("group_id").agg(F.count("*").alias("group_size")), "group_id")


@query(f"""
WITH d AS (SELECT id, CAST({sql_amount(_field('total'))} AS DOUBLE) AS total, trim(regexp_replace(strip_accents(replace(lower(nfc_normalize({_field('supplier_nif')})), 'ß', 'ss')), '[\\s\\p{{Z}}]+', ' ', 'g')) AS supplier FROM invoice_documents),
a AS (SELECT 'total_asc' AS sort, id, row_number() OVER (ORDER BY total NULLS LAST, id) AS place FROM d UNION ALL SELECT 'total_desc', id, row_number() OVER (ORDER BY total DESC NULLS LAST, id) FROM d
  UNION ALL SELECT 'supplier_asc', id, row_number() OVER (ORDER BY supplier NULLS LAST, id) FROM d UNION ALL SELECT 'supplier_desc', id, row_number() OVER (ORDER BY supplier DESC NULLS LAST, id) FROM d)
SELECT * FROM a WHERE place BETWEEN 1 AND 40""")
def so_four_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of forty by each of four orders, what is unknown last."""
    from pyspark.sql.window import Window

    x = _value(spark, sf_dir, "total").join(_value(spark, sf_dir, "supplier_nif").withColumnRenamed("v", "nif"), "id").select("id", amount(F.col("v")).cast("double").alias("total"), fold(F.col("nif")).alias("supplier"))
    out = None
    for name, order in {"total_asc": F.asc_nulls_last("total"), "total_desc": F.desc_nulls_last("total"), "supplier_asc": F.asc_nulls_last("supplier"), "supplier_desc": F.desc_nulls_last("supplier")}.items():
        page = x.orderBy(order, "id").limit(40)
        page = page.select(F.lit(name).alias("sort"), "id", F.row_number().over(Window.orderBy(order, "id")).cast("long").alias("place"))  # of 40 rows
        out = page if out is None else out.union(page)
    return out


@query("""
WITH a AS (SELECT file_id, list_sort(list(DISTINCT field)) AS f FROM ocr_report WHERE status <> 'OK' GROUP BY 1), b AS (SELECT file_id, list_sort(list(DISTINCT field)) AS f FROM ocr_labels WHERE len(review_flags) > 0 GROUP BY 1)
SELECT a.file_id, array_to_string(list_sort(list_intersect(a.f, b.f)), ',') AS both, array_to_string(list_sort(list_filter(a.f, lambda x: NOT list_contains(b.f, x))), ',') AS failed_only, array_to_string(list_sort(list_distinct(list_concat(a.f, b.f))), ',') AS any, list_has_any(a.f, b.f) AS overlap FROM a JOIN b ON a.file_id = b.file_id""")
def se_field_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that fail and fields with review flags of each file, as sets; a file has ten fields at most."""
    a = table(spark, sf_dir, "ocr_report").filter("status <> 'OK'").groupBy("file_id").agg(F.collect_set("field").alias("a"))
    b = table(spark, sf_dir, "ocr_labels").filter(F.size("review_flags") > 0).groupBy("file_id").agg(F.collect_set("field").alias("b"))
    text = lambda c: F.array_join(F.sort_array(c), ",")
    return a.join(b, "file_id").select("file_id", text(F.array_intersect("a", "b")).alias("both"), text(F.array_except("a", "b")).alias("failed_only"), text(F.array_union("a", "b")).alias("any"), F.arrays_overlap("a", "b").alias("overlap"))


@query("""
WITH o AS (SELECT id, created, json_extract_string(extraction, '$.fields."order".value') AS o, batch_id, lower(replace(sha256, 'sha256:', '')) AS sha FROM invoice_documents),
g AS (SELECT o, count(DISTINCT batch_id) AS n_batches, count(*) AS n, count(DISTINCT sha) AS k, arg_min(id, {c: created, i: id}) AS first_id FROM o WHERE o IS NOT NULL GROUP BY 1)
SELECT o.id, coalesce(n, 1) AS n_rows, coalesce(n_batches, 1) AS n_batches, CASE WHEN n > 1 AND n_batches > 1 THEN CASE WHEN k = 1 THEN 'copy_across' ELSE 'conflict_across' END WHEN n > 1 THEN CASE WHEN k = 1 THEN 'copy_within' ELSE 'conflict_within' END ELSE 'none' END AS state, coalesce(first_id, o.id) AS canonical_id FROM o LEFT JOIN g ON g.o = o.o""")
def jo_duplicates_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name one order, told apart by whether they lie in one batch or several."""
    o = table(spark, sf_dir, "invoice_documents").select("id", "created", "batch_id", F.get_json_object("extraction", "$.fields.order.value").alias("o"), F.lower(F.regexp_replace("sha256", "sha256:", "")).alias("sha"))
    g = o.filter("o IS NOT NULL").groupBy("o").agg(F.count_distinct("batch_id").alias("nb"), F.count("*").alias("n"), F.count_distinct("sha").alias("k"), F.min_by("id", F.struct("created", "id")).alias("first_id"))
    where = F.when(F.col("nb") > 1, "across").otherwise("within")
    state = F.when(F.col("n") > 1, F.concat(F.when(F.col("k") == 1, "copy_").otherwise("conflict_"), where)).otherwise("none")
    return o.join(g, "o", "left").select("id", F.coalesce("n", F.lit(1)).alias("n_rows"), F.coalesce("nb", F.lit(1)).alias("n_batches"), state.alias("state"), F.coalesce("first_id", "id").alias("canonical_id"))


@query(f"""
WITH a AS (SELECT {sql_data('id')} AS id, source.sheet AS sheet, source.row AS r, {sql_data('nif')} AS nif, {sql_data('iban')} AS iban FROM supplier_rows),
f AS (SELECT id, arg_min({{sheet: sheet, r: r}}, {{s: sheet <> 'Proveedores', h: sheet, r: r}}) AS k, count(*) AS n, count(DISTINCT coalesce(nif, '') || '|' || coalesce(iban, '')) AS kinds FROM a WHERE id IS NOT NULL GROUP BY 1)
SELECT id, k.sheet AS sheet, k.r AS sheet_row, n AS n_rows, kinds > 1 AS differs FROM f""")
def rm_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composed master: of each supplier the row that came first (the old sheet before the others) with its place, and whether later rows differ."""
    x = table(spark, sf_dir, "supplier_rows").select(data(F.col("id")).alias("id"), F.col("source.sheet").alias("sheet"), F.col("source.row").alias("r"), F.concat(F.coalesce(data(F.col("nif")), F.lit("")), F.lit("|"), F.coalesce(data(F.col("iban")), F.lit(""))).alias("kind"))
    g = x.filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct((F.col("sheet") != "Proveedores").alias("later"), "sheet", "r")).alias("k"), F.count("*").alias("n_rows"), F.count_distinct("kind").alias("kinds"))
    return g.select("id", "k.sheet", F.col("k.r").alias("sheet_row"), "n_rows", (F.col("kinds") > 1).alias("differs"))


@query()
def ex_tolerant_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for ten fields in the lines of documents by the tolerant profile, with the currency that each document prints."""
    schema = "pages ARRAY<STRUCT<lines: ARRAY<STRUCT<line_no: INT, text: STRING>>>>"
    x = table(spark, sf_dir, "invoice_documents").filter("extraction IS NOT NULL").select("id", F.flatten(F.from_json("extraction", schema)["pages"]["lines"]).alias("ls"))
    x = x.select("id", cand.document_currency(F.col("ls.text")).alias("currency"), F.explode("ls").alias("l"))
    x = x.select("id", F.col("l.line_no").alias("line_no"), F.explode(cand.tolerant_candidates(F.col("l.text"), F.col("currency"))).alias("c"))
    return x.select("id", "line_no", "c.*")


QUERIES, SQL = query.queries, query.sql
