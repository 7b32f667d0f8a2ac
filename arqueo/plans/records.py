"""Queries of what is shown, checked and counted about documents: reasons, pages, costs, manifests, deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arqueo.functions import candidates as cand
from arqueo.functions import readings as rd
from arqueo.functions.identity import iban_valid, spanish_number
from arqueo.functions.text import amount, data, identifier, order_number
from arqueo.functions.times import with_time
from arqueo.operators import relational as rel
from arqueo.plans.extraction import _field, _value
from arqueo.plans.registry import Registry, sql_amount, sql_data, sql_identifier, sql_order
from arqueo.plans.scalars import fields
from arqueo.plans.times_sql import times
from arqueo.session import table

query = Registry()

# --- texts that give orders, and keys of what was read

# Fixed values, as the SQL has them: what an instruction to a machine looks like.
_ORDERS = r"agente|ignora[rd]?|no\s+registres|hardcode|equipo\s+de\s+evaluaci[oó]n|no\s+recalcular|debe\s+marcarse|ignore\s+(?:all|previous|the|prior)|system\s*(?:message|prompt|:)|mark\s+(?:as\s+)?(?:PAGAR|NO_PAGAR|paid)|do\s+not\s+(?:log|record)|<\s*script\b|\b(?:curl|wget)\s+https?://|\b(?:execute|ejecuta)\b"


@query(rf"""
WITH t AS (SELECT 'documents' AS tab, CAST(doc_id AS VARCHAR) AS rec_key, text FROM documents UNION ALL SELECT 'invoice_documents', id, json_extract_string(l, '$.text') FROM (SELECT id, unnest(CAST(json_extract(extraction, '$.pages[*].lines[*]') AS JSON[])) AS l FROM invoice_documents WHERE extraction IS NOT NULL))
SELECT tab, rec_key, count(*) AS n_texts FROM t WHERE regexp_matches(text, '(?i){_ORDERS}') GROUP BY 1, 2""")
def ex_untrusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and lines that give orders to who reads them."""
    schema = "pages ARRAY<STRUCT<lines: ARRAY<STRUCT<text: STRING>>>>"
    lines = table(spark, sf_dir, "invoice_documents").filter("extraction IS NOT NULL").select(F.lit("invoice_documents").alias("tab"), F.col("id").alias("rec_key"), F.explode(F.flatten(F.from_json("extraction", schema)["pages"]["lines"])["text"]).alias("text"))
    x = lines.union(table(spark, sf_dir, "documents").select(F.lit("documents"), F.col("doc_id").cast("string"), "text"))
    return x.filter(cand.gives_orders(F.col("text"))).groupBy("tab", "rec_key").agg(F.count("*").alias("n_texts"))


@query("""
WITH k AS (SELECT DISTINCT sha256('{"engines":"' || coalesce(method, '') || '","extractor":"' || coalesce(json_extract_string(extraction, '$.version'), '') || '","ocr":' || CASE WHEN method = 'ocr' THEN 'true' ELSE 'false' END || ',"profile":"' || coalesce(json_extract_string(extraction, '$.profile'), '') || '","profile_config":"v1","sha256":"' || lower(replace(sha256, 'sha256:', '')) || '"}') AS cache_key, state
  FROM (SELECT *, json_extract_string(extraction, '$.pages[0].lines[0].method') AS method FROM invoice_documents))
SELECT cache_key, bool_or(state = 'DONE') AS cached FROM k GROUP BY 1""")
def ex_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of each reading (content, extractor, engines, recognition, profile and its configuration, as canonical JSON) and whether one of it is done."""
    x = table(spark, sf_dir, "invoice_documents").select("state", F.lower(F.regexp_replace("sha256", "sha256:", "")).alias("sha256"), F.from_json("extraction", "version STRING, profile STRING, pages ARRAY<STRUCT<lines: ARRAY<STRUCT<method: STRING>>>>").alias("e"))
    method = F.get(F.get("e.pages", F.lit(0))["lines"], F.lit(0))["method"]
    text = lambda c: F.coalesce(c, F.lit(""))
    parts = F.struct(text(method).alias("engines"), text(F.col("e.version")).alias("extractor"), F.coalesce(method == "ocr", F.lit(False)).alias("ocr"), text(F.col("e.profile")).alias("profile"), F.lit("v1").alias("profile_config"), F.col("sha256"))
    return x.filter("sha256 IS NOT NULL").groupBy(F.sha2(F.to_json(parts), 256).alias("cache_key")).agg(F.max(F.col("state") == "DONE").alias("cached"))


@query("""
WITH c AS (SELECT id, unnest(CAST(json_extract(extraction, '$.fields.currency.evidence') AS JSON[])) AS e FROM invoice_documents WHERE extraction IS NOT NULL), v AS (SELECT id, trim(json_extract_string(e, '$.raw_value')) AS v FROM c),
g AS (SELECT id, bool_or(regexp_full_match(v, '[A-Za-z]{3}')) AS code FROM v GROUP BY 1)
SELECT v.id, v AS raw FROM v JOIN g ON g.id = v.id WHERE NOT (v = '$' AND code)""")
def ex_currency_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The currency marks of each document; a bare dollar doesn't count where a code is printed."""
    x = fields(spark, sf_dir).filter("field = 'currency'").select("id", F.transform("evidence", lambda e: F.trim(e["raw_value"])).alias("v"))
    return x.select("id", F.explode(cand.without_bare_dollar(F.col("v"))).alias("raw"))


# --- counts


@query(f"""
WITH r AS (SELECT snapshot_id, idx, {sql_order('pedido')} AS pedido, coalesce({sql_data('estado')}, '') AS estado, coalesce({sql_data('proveedor')}, {sql_data('proveedor_id')}, '') AS p FROM erp_rows),
g AS (SELECT pedido, arg_min({{e: estado, p: p}}, {{s: snapshot_id, i: idx}}) AS a, arg_max({{e: estado, p: p}}, {{s: snapshot_id, i: idx}}) AS b FROM r WHERE pedido IS NOT NULL GROUP BY 1)
SELECT count(*) FILTER (a <> b) AS affected, count(*) FILTER (a <> b AND a.e = b.e) AS unchanged, count(*) FILTER (a.e <> 'PENDIENTE' AND b.e = 'PENDIENTE') AS to_review, count(*) FILTER (a <> b AND a.e <> b.e AND NOT (a.e <> 'PENDIENTE' AND b.e = 'PENDIENTE')) AS other_changes, count(*) FILTER (a = b) AS reused FROM g""")
def ag_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last export changes against the first: disjoint counts of orders."""
    x = table(spark, sf_dir, "erp_rows").select("snapshot_id", "idx", order_number(F.col("pedido")).alias("pedido"), F.coalesce(data(F.col("estado")), F.lit("")).alias("e"), F.coalesce(data(F.col("proveedor")), data(F.col("proveedor_id")), F.lit("")).alias("p")).filter("pedido IS NOT NULL")
    g = x.groupBy("pedido").agg(F.min_by(F.struct("e", "p"), F.struct("snapshot_id", "idx")).alias("a"), F.max_by(F.struct("e", "p"), F.struct("snapshot_id", "idx")).alias("b"))
    changed, review = F.col("a") != F.col("b"), (F.col("a.e") != "PENDIENTE") & (F.col("b.e") == "PENDIENTE")
    same = F.col("a.e") == F.col("b.e")
    return g.agg(F.count_if(changed).alias("affected"), F.count_if(changed & same).alias("unchanged"), F.count_if(review).alias("to_review"), F.count_if(changed & ~same & ~review).alias("other_changes"), F.count_if(~changed).alias("reused"))


@query(f"""
WITH tv AS (SELECT fecha AS v FROM erp_rows UNION ALL SELECT fecha_registro FROM erp_rows), {times('tv')}, m AS (SELECT max(day) AS latest FROM times)
SELECT id AS batch_id, latest, as_of >= latest AS as_of_ok FROM batches, m""")
def ag_latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest date of any order, and whether each batch's own date isn't before it."""
    e = table(spark, sf_dir, "erp_rows")
    x = e.select(F.col("fecha").alias("v")).union(e.select("fecha_registro")).filter("v IS NOT NULL")
    latest = with_time(x, F.col("v"), "t", []).agg(F.max("t_date").alias("latest"))
    return table(spark, sf_dir, "batches").crossJoin(F.broadcast(latest)).select(F.col("id").alias("batch_id"), "latest", (F.col("as_of").cast("date") >= F.col("latest")).alias("as_of_ok"))  # one row


@query("""
WITH d AS (SELECT batch_id, CAST(json_extract_string(extraction, '$.seconds') AS DOUBLE) AS s FROM invoice_documents)
SELECT batch_id, count(s) AS processed, round(sum(s), 3) AS seconds, CASE WHEN sum(s) > 0 THEN round(count(s) / sum(s), 4) END AS per_second FROM d GROUP BY 1""")
def ag_run_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents a second of each batch, null where no time was spent."""
    x = table(spark, sf_dir, "invoice_documents").select("batch_id", F.from_json("extraction", "seconds DOUBLE")["seconds"].alias("s")).groupBy("batch_id").agg(F.count("s").alias("processed"), F.sum("s").alias("t"))
    return x.select("batch_id", "processed", F.round("t", 3).alias("seconds"), F.when(F.col("t") > 0, F.round(F.col("processed") / F.col("t"), 4)).alias("per_second"))


@query("""
WITH h AS (SELECT user_id, event_id, event_type, value AS after, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, event_id, event_type, before, after FROM h WHERE before IS NOT NULL AND before <> after""")
def wi_correction_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change of a value with the one before."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    x = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.lag("value").over(w).alias("before"), F.col("value").alias("after"))
    return x.filter("before IS NOT NULL AND before <> after")


# --- orders of what is shown


@query("""
WITH r AS (SELECT DISTINCT file_id, CASE field WHEN 'currency' THEN 1 WHEN 'iban' THEN 3 ELSE 2 END AS rank, field || ': ' || lower(status) AS label FROM ocr_report WHERE status <> 'OK'),
g AS (SELECT file_id, list(label ORDER BY rank, label) AS labels FROM r GROUP BY 1)
SELECT file_id, labels[1] AS title, array_to_string(labels[2:], '; ') AS others, len(labels) AS n FROM g""")
def so_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reasons why a file needs attention, by weight, each once; a file has ten fields at most."""
    rank = F.when(F.col("field") == "currency", 1).when(F.col("field") == "iban", 3).otherwise(2)
    x = table(spark, sf_dir, "ocr_report").filter("status <> 'OK'").select("file_id", F.struct(rank.alias("rank"), F.concat("field", F.lit(": "), F.lower("status")).alias("label")).alias("r"))
    g = x.groupBy("file_id").agg(F.array_sort(F.collect_set("r")).alias("rs"))
    labels = F.col("rs.label")
    return g.select("file_id", F.get(labels, F.lit(0)).alias("title"), F.array_join(F.slice(labels, 2, 100), "; ").alias("others"), F.size("rs").cast("long").alias("n"))


@query("""
WITH k AS (SELECT DISTINCT field, status, file_id FROM ocr_report WHERE status <> 'OK'), g AS (SELECT field, status, count(*) AS n_files FROM k GROUP BY 1, 2)
SELECT field, status, n_files, row_number() OVER (ORDER BY n_files DESC, field, status) AS place FROM g QUALIFY place <= 40""")
def so_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty largest groups of one field and status."""
    g = table(spark, sf_dir, "ocr_report").filter("status <> 'OK'").groupBy("field", "status").agg(F.count_distinct("file_id").alias("n_files"))
    order = [F.desc("n_files"), F.col("field"), F.col("status")]
    return g.orderBy(*order).limit(40).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # of 40 rows


@query("""
WITH d AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS n, count(*) OVER () AS total FROM orders)
SELECT o_orderkey, o_totalprice, CAST((total + 39) // 40 AS INTEGER) AS page FROM d WHERE n > (total + 39) // 40 * 40 - 40""")
def so_clamped_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page far beyond the end is the last one."""
    x = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    rows, number, _ = rel.page(x, [F.col("o_totalprice"), F.col("o_orderkey")], 1_000_000, 40)
    return rows.withColumn("page", F.lit(number))


# --- checks of what is kept and delivered


@query(f"""
WITH d AS (SELECT id, state, sha256(coalesce({sql_order(_field('order'))}, '') || '|' || lower(replace(sha256, 'sha256:', ''))) AS context FROM invoice_documents WHERE sha256 IS NOT NULL)
SELECT min(id) AS id, context FROM d WHERE state <> 'DONE' AND context NOT IN (SELECT context FROM d WHERE state = 'DONE') GROUP BY context""")
def tx_new_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still to be decided: one document for each context (order and content) that no decided one has."""
    d = table(spark, sf_dir, "invoice_documents").filter("sha256 IS NOT NULL").select("id", "state", F.sha2(F.concat_ws("|", F.coalesce(order_number(F.get_json_object("extraction", "$.fields.order.value")), F.lit("")), F.lower(F.regexp_replace("sha256", "sha256:", ""))), 256).alias("context"))
    return d.filter("state <> 'DONE'").join(d.filter("state = 'DONE'").select("context"), "context", "left_anti").groupBy("context").agg(F.min("id").alias("id")).select("id", "context")


@query("""
WITH m AS (SELECT batch_id, file_id, arg_min(lower(replace(sha256, 'sha256:', '')), {c: created, i: id}) AS sha FROM invoice_documents GROUP BY 1, 2)
SELECT 'document_manifest' AS kind, d.id AS target FROM invoice_documents d JOIN m ON m.batch_id = d.batch_id AND m.file_id = d.file_id WHERE lower(replace(d.sha256, 'sha256:', '')) <> m.sha
UNION ALL SELECT 'source_unreadable', id FROM sources WHERE NOT json_valid(payload) UNION ALL SELECT 'source_unused', s.id FROM sources s WHERE kind = 'erp' AND NOT EXISTS (SELECT 1 FROM batches b WHERE b.snapshot_id = s.id)
UNION ALL SELECT 'document_unreadable', id FROM invoice_documents WHERE extraction IS NOT NULL AND NOT json_valid(extraction) UNION ALL SELECT 'decision_pointer', id FROM invoice_documents WHERE state = 'DONE' AND latest_decision IS NULL
UNION ALL SELECT 'digest_shape', id FROM invoice_documents WHERE NOT regexp_full_match(lower(replace(sha256, 'sha256:', '')), '[0-9a-f]{64}')""")
def tx_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything kept that contradicts itself: kind of the issue and what has it."""
    d, s, b = (table(spark, sf_dir, t) for t in ("invoice_documents", "sources", "batches"))
    d = d.withColumn("sha", F.lower(F.regexp_replace("sha256", "sha256:", "")))
    m = d.groupBy("batch_id", "file_id").agg(F.min_by("sha", F.struct("created", "id")).alias("first"))
    issue = lambda kind, x: x.select(F.lit(kind).alias("kind"), F.col("id").alias("target"))
    valid = lambda c: F.try_parse_json(c).isNotNull()
    return (
        issue("document_manifest", d.join(m, ["batch_id", "file_id"]).filter("sha <> first"))
        .union(issue("source_unreadable", s.filter(~valid(F.col("payload")))))
        .union(issue("source_unused", s.filter("kind = 'erp'").join(b.select(F.col("snapshot_id").alias("id")), "id", "left_anti")))
        .union(issue("document_unreadable", d.filter(F.col("extraction").isNotNull() & ~valid(F.col("extraction")))))
        .union(issue("decision_pointer", d.filter("state = 'DONE' AND latest_decision IS NULL")))
        .union(issue("digest_shape", d.filter(~F.col("sha").rlike("^[0-9a-f]{64}$"))))
    )


@query("""
SELECT batch_id, count(*) AS n_files, count(*) - count(DISTINCT nfc_normalize(file_id)) AS n_repeated_names, count(*) FILTER (NOT regexp_matches(lower(file_id), '[.]pdf$')) AS n_other_kinds, count(DISTINCT lower(replace(sha256, 'sha256:', ''))) AS n_contents FROM invoice_documents GROUP BY 1""")
def rm_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each batch's files are: names in one form, kinds, contents."""
    from arqueo.functions.unicode import nfc

    x = table(spark, sf_dir, "invoice_documents").select("batch_id", "file_id", nfc(F.col("file_id")).alias("name"), F.lower(F.regexp_replace("sha256", "sha256:", "")).alias("sha"))
    return x.groupBy("batch_id").agg(F.count("*").alias("n_files"), (F.count("*") - F.count_distinct("name")).alias("n_repeated_names"), F.count_if(~F.lower("file_id").rlike(r"\.pdf$")).alias("n_other_kinds"), F.count_distinct("sha").alias("n_contents"))


@query("""
WITH e AS (SELECT DISTINCT file_id FROM ocr_labels), o AS (SELECT file_id, status FROM ocr_report WHERE field = 'total')
SELECT (SELECT count(*) FROM e WHERE file_id NOT IN (SELECT file_id FROM o)) AS missing, (SELECT count(DISTINCT file_id) FROM o WHERE file_id NOT IN (SELECT file_id FROM e)) AS extra, (SELECT count(*) - count(DISTINCT file_id) FROM o) AS repeated,
  (SELECT count(*) FROM o WHERE status IS NULL OR status NOT IN ('OK', 'MISSING', 'INVALID', 'CONFLICT', 'LOW_QUALITY')) AS invalid""")
def rm_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a delivery has one valid row for each file that is expected, and no others."""
    e = table(spark, sf_dir, "ocr_labels").select("file_id").distinct().withColumn("e", F.lit(1))
    o = table(spark, sf_dir, "ocr_report").filter("field = 'total'")
    bad = F.col("status").isNull() | ~F.col("status").isin("OK", "MISSING", "INVALID", "CONFLICT", "LOW_QUALITY")
    g = o.groupBy("file_id").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    x = e.join(g, "file_id", "full_outer")
    zero = F.lit(0).cast("long")
    return x.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("extra"), F.coalesce(F.sum(F.col("n") - 1), zero).alias("repeated"), F.coalesce(F.sum("bad"), zero).alias("invalid"))


_IBAN = sql_identifier("v")


@query(f"""
WITH v AS (SELECT id, {_field('iban')} AS v, {sql_identifier(_field('supplier_nif'))} AS x FROM invoice_documents), i AS (SELECT id, x, {_IBAN} AS i FROM v),
c AS (SELECT id, x, CASE WHEN i IS NOT NULL THEN coalesce(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(i[5:] || i[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN (ascii(c) - 48)::BIGINT WHEN c BETWEEN 'A' AND 'Z' THEN (ascii(c) - 55)::BIGINT END)), lambda a, d: CASE WHEN d < 10 THEN (a * 10 + d) % 97 ELSE (a * 100 + d) % 97 END) = 1, false) END AS iban_ok FROM i),
d AS (SELECT id, x, iban_ok, list_transform(range(2, 9), lambda k: TRY_CAST(substr(x, k, 1) AS INTEGER)) AS d FROM c),
k AS (SELECT id, x, iban_ok, (10 - (d[2] + d[4] + d[6] + list_sum(list_transform([d[1], d[3], d[5], d[7]], lambda v: v * 2 // 10 + v * 2 % 10))) % 10) % 10 AS k FROM d)
SELECT id, iban_ok, CASE WHEN x IS NULL THEN NULL WHEN regexp_full_match(x, '[A-HJ-NP-SUVW][0-9]{{7}}[0-9A-J]') THEN right(x, 1) = CAST(k AS VARCHAR) OR right(x, 1) = substr('JABCDEFGHI', CAST(k AS BIGINT) + 1, 1)
  WHEN regexp_full_match(x, '[0-9]{{8}}[A-Z]') THEN right(x, 1) = substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(left(x, 8) AS BIGINT) % 23 + 1, 1) ELSE false END AS nif_ok FROM k""")
def rm_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check digits of each document's account and tax number; they are told, and stop nothing."""
    x = _value(spark, sf_dir, "iban").withColumnRenamed("v", "iban").join(_value(spark, sf_dir, "supplier_nif").withColumnRenamed("v", "nif"), "id")
    plain = identifier(F.col("iban"))
    ok = F.when(plain.isNotNull(), plain.rlike("^[A-Z0-9]+$") & F.coalesce(iban_valid(plain), F.lit(False)))
    return x.select("id", ok.alias("iban_ok"), rd.spanish_tax_number_valid(F.col("nif")).alias("nif_ok"))


@query("""
WITH k AS (SELECT id, extraction, unnest(json_keys(extraction, '$.fields')) AS field FROM invoice_documents WHERE extraction IS NOT NULL)
SELECT id, field, json_extract_string(extraction, '$.fields."' || field || '".value') AS value, CAST(json_extract_string(extraction, '$.fields."' || field || '".evidence[0].page') AS INTEGER) AS page FROM k WHERE json_extract_string(extraction, '$.fields."' || field || '".value') IS NOT NULL""")
def rm_model_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with their pages from a model's answer, JSON in a code fence with talk around it; here each extraction is put into one."""
    x = table(spark, sf_dir, "invoice_documents").filter("extraction IS NOT NULL").select("id", rd.fenced_json(F.concat(F.lit("Here it is:\n```json\n"), "extraction", F.lit("\n```"))).alias("j"))
    x = x.select("id", F.explode(F.from_json(F.get_json_object("j", "$.fields"), "MAP<STRING, STRUCT<value: STRING, evidence: ARRAY<STRUCT<page: INT>>>>")).alias("field", "f"))
    return x.filter("f.value IS NOT NULL").select("id", "field", "f.value", F.get("f.evidence", F.lit(0))["page"].alias("page"))


# --- costs and numbers


@query("""
WITH e AS (SELECT user_id, count(*) AS n, sum(value) AS seconds, min(value) AS least FROM events GROUP BY 1)
SELECT user_id, CASE WHEN least >= 0 AND isfinite(seconds) THEN round(n * 0.0002 + seconds / 3600 * 1.5 + n * 2 * 0.3, 6) END AS total, CASE WHEN least >= 0 AND isfinite(seconds) THEN round((n * 0.0002 + seconds / 3600 * 1.5 + n * 2 * 0.3) / n, 6) END AS per_event FROM e""")
def nu_cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's events cost: external price, machine hours and two minutes of people each; null for negative or infinite times."""
    x = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.min("value").alias("least"))
    total = rd.cost_estimate(F.col("n"), F.col("n") * 0.0002, F.col("s") / 3600, F.lit(1.5), F.col("n") * 2, F.lit(0.3))
    good = F.col("least") >= 0
    return x.select("user_id", F.when(good, F.round(total, 6)).alias("total"), F.when(good, F.round(F.try_divide(total, F.col("n")), 6)).alias("per_event"))


@query(f"""
WITH a AS (SELECT id, CAST({sql_amount(_field('base'))} AS DECIMAL(18,2)) AS b, CAST({sql_amount(_field('tax_amount'))} AS DECIMAL(18,2)) AS t, CAST({sql_amount(_field('total'))} AS DECIMAL(18,2)) AS s FROM invoice_documents)
SELECT id, abs(b + t - s) <= 0.02 AS adds_up, CASE WHEN b IS NOT NULL AND t IS NOT NULL THEN len(list_filter([0.21, 0.10, 0.04, 0.00], lambda r: abs(round(b * r, 2) - t) <= 0.02)) > 0 END AS usual_rate FROM a""")
def nu_usual_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether base and tax add up to the total, and whether the tax is that of any usual rate, within two cents."""
    x = None
    for f in ("base", "tax_amount", "total"):
        v = _value(spark, sf_dir, f).select("id", amount(F.col("v")).cast("decimal(18,2)").alias(f))
        x = v if x is None else x.join(v, "id")
    rates = F.array(*[F.lit(r).cast("decimal(4,2)") for r in ("0.21", "0.10", "0.04", "0.00")])
    fits = F.exists(rates, lambda r: F.abs(F.round(F.col("base") * r, 2) - F.col("tax_amount")) <= 0.02)
    return x.select("id", (F.abs(F.col("base") + F.col("tax_amount") - F.col("total")) <= 0.02).alias("adds_up"), F.when(F.col("base").isNotNull() & F.col("tax_amount").isNotNull(), fits).alias("usual_rate"))


@query("""
SELECT user_id, min(event_id * 37 % 600) AS "left", min(event_id * 53 % 800) AS top, max(event_id * 37 % 600 + event_id * 11 % 90 + 5) AS "right", max(event_id * 53 % 800 + 12) AS bottom FROM events GROUP BY 1""")
def nu_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around all boxes of a page. The tables have no boxes: events stand for them, users for pages."""
    i = F.col("event_id")
    boxes = table(spark, sf_dir, "events").select("user_id", F.struct((i * 37 % 600).alias("left"), (i * 53 % 800).alias("top"), (i * 37 % 600 + i * 11 % 90 + 5).alias("right"), (i * 53 % 800 + 12).alias("bottom")).alias("b"))
    return boxes.groupBy("user_id").agg(F.min("b.left").alias("left"), F.min("b.top").alias("top"), F.max("b.right").alias("right"), F.max("b.bottom").alias("bottom"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day, replace(replace(replace(format('{:,.2f}', o_totalprice), ',', '#'), '.', ','), '#', '.') AS total FROM orders")
def dt_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and amounts as an older system shows them."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), spanish_number(F.col("o_totalprice")).alias("total"))


QUERIES, SQL = query.queries, query.sql
