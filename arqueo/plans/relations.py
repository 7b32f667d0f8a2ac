"""Queries of joins, aggregations, windows, sorts, sets and incremental steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arqueo.functions import candidates as cand
from arqueo.functions.identity import fold
from arqueo.functions.text import amount, data, identifier, order_number
from arqueo.functions.times import micros
from arqueo.operators import relational as rel
from arqueo.plans.registry import Registry, sql_amount, sql_data, sql_identifier, sql_order
from arqueo.plans.scalars import fields
from arqueo.session import table

query = Registry()


def _value(f: str) -> str:
    return f"json_extract_string(extraction, '$.fields.{f}.value')"


def _readings(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """id, file_id, sha256, created and the named readings of invoice_documents."""
    x = table(spark, sf_dir, "invoice_documents")
    schema = "fields STRUCT<" + ", ".join(f"`{n}`: STRUCT<value: STRING>" for n in names) + ">"
    x = x.select("id", "batch_id", "file_id", "sha256", "created", F.from_json("extraction", schema)["fields"].alias("f"))
    return x.select("id", "batch_id", "file_id", "sha256", "created", *[F.col(f"f.{n}.value").alias(n) for n in names])


# --- joins

_SUPPLIERS = f"SELECT {sql_data('nif')} AS nif, count(DISTINCT {sql_data('id')} || '|' || {sql_identifier('iban')}) AS n_identities, min({sql_data('id')}) AS supplier_id FROM supplier_rows GROUP BY 1"


@query(f"""
WITH s AS ({_SUPPLIERS}), d AS (SELECT id, {sql_data(_value('supplier_nif'))} AS nif FROM invoice_documents)
SELECT d.id, d.nif, CASE WHEN n_identities = 1 THEN supplier_id END AS supplier_id, CASE WHEN d.nif IS NULL THEN 'UNKNOWN' WHEN s.nif IS NULL THEN 'ABSENT' WHEN n_identities = 1 THEN 'UNIQUE' ELSE 'AMBIGUOUS' END AS state
FROM d LEFT JOIN s ON d.nif = s.nif""")
def jo_supplier_of_invoice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax number of the invoice to the supplier, told apart from ambiguous and absent ones."""
    s = table(spark, sf_dir, "supplier_rows").select(data(F.col("nif")).alias("nif"), data(F.col("id")).alias("sid"), identifier(F.col("iban")).alias("iban"))
    s = s.groupBy("nif").agg(F.count_distinct(F.concat("sid", F.lit("|"), "iban")).alias("n"), F.min("sid").alias("sid")).filter("nif IS NOT NULL").withColumn("known", F.lit(True))
    x = _readings(spark, sf_dir, "supplier_nif").select("id", data(F.col("supplier_nif")).alias("nif")).join(s, "nif", "left")
    state = F.when(F.col("nif").isNull(), "UNKNOWN").when(F.col("known").isNull(), "ABSENT").when(F.col("n") == 1, "UNIQUE").otherwise("AMBIGUOUS")
    return x.select("id", "nif", F.when(F.col("n") == 1, F.col("sid")).alias("supplier_id"), state.alias("state"))


@query(f"""
WITH e AS (SELECT {sql_order('pedido')} AS pedido, count(*) AS n FROM erp_rows GROUP BY 1), d AS (SELECT id, {sql_order(_value('"order"'))} AS pedido FROM invoice_documents)
SELECT d.id, d.pedido, coalesce(e.n, 0) AS n_erp_rows FROM d LEFT JOIN e ON d.pedido = e.pedido""")
def jo_erp_rows_of_invoice(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "erp_rows").groupBy(order_number(F.col("pedido")).alias("pedido")).agg(F.count("*").alias("n")).filter("pedido IS NOT NULL")
    x = _readings(spark, sf_dir, "order").select("id", order_number(F.col("order")).alias("pedido")).join(e, "pedido", "left")
    return x.select("id", "pedido", F.coalesce("n", F.lit(0)).alias("n_erp_rows"))


@query(f"""
SELECT DISTINCT {sql_order(_value('"order"'))} AS pedido FROM invoice_documents WHERE {sql_order(_value('"order"'))} IS NOT NULL
EXCEPT SELECT {sql_order('pedido')} FROM erp_rows""")
def jo_orders_not_in_erp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "erp_rows").select(order_number(F.col("pedido")).alias("pedido"))
    return _readings(spark, sf_dir, "order").select(order_number(F.col("order")).alias("pedido")).filter("pedido IS NOT NULL").distinct().join(e, "pedido", "left_anti")


_SPLIT = "CASE lower(trim(split)) WHEN 'val' THEN 'validation' ELSE lower(trim(split)) END"


@query(f"""
WITH a AS (SELECT file_id, min({_SPLIT}) AS split FROM ocr_splits GROUP BY 1), b AS (SELECT file_id, min({_SPLIT}) AS split FROM ocr_report GROUP BY 1)
SELECT coalesce(a.split, 'absent') AS in_splits, coalesce(b.split, 'absent') AS in_report, count(*) AS n_files FROM a FULL JOIN b ON a.file_id = b.file_id GROUP BY 1, 2""")
def jo_split_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer comparison of two assignments, counted by what became of what."""
    name = F.lower(F.trim("split"))
    of = lambda t, k: table(spark, sf_dir, t).groupBy("file_id").agg(F.min(F.when(name == "val", "validation").otherwise(name)).alias(k))
    x = of("ocr_splits", "a").join(of("ocr_report", "b"), "file_id", "full_outer")
    return x.groupBy(F.coalesce("a", F.lit("absent")).alias("in_splits"), F.coalesce("b", F.lit("absent")).alias("in_report")).agg(F.count("*").alias("n_files"))


@query(f"""
WITH a AS (SELECT {sql_data('id')} AS id, max({sql_data('nif')}) AS nif, max({sql_identifier('iban')}) AS iban FROM supplier_rows WHERE source.sheet = 'Proveedores' GROUP BY 1),
b AS (SELECT {sql_data('id')} AS id, max({sql_data('nif')}) AS nif, max({sql_identifier('iban')}) AS iban FROM supplier_rows WHERE source.sheet <> 'Proveedores' GROUP BY 1)
SELECT coalesce(b.id, a.id) AS id, coalesce(b.nif, a.nif) AS nif, coalesce(b.iban, a.iban) AS iban,
  CASE WHEN a.id IS NULL THEN 'added' WHEN (b.nif IS NOT NULL AND b.nif IS DISTINCT FROM a.nif) OR (b.iban IS NOT NULL AND b.iban IS DISTINCT FROM a.iban) THEN 'updated' ELSE 'kept' END AS change
FROM a FULL JOIN b ON a.id = b.id""")
def jo_upsert_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New supplier sheets over the old one."""
    s = table(spark, sf_dir, "supplier_rows").select(F.col("source.sheet").alias("sheet"), data(F.col("id")).alias("id"), data(F.col("nif")).alias("nif"), identifier(F.col("iban")).alias("iban"))
    one = lambda x: x.groupBy("id").agg(F.max("nif").alias("nif"), F.max("iban").alias("iban"))
    return rel.upsert(one(s.filter("sheet = 'Proveedores'")), one(s.filter("sheet <> 'Proveedores'")), "id", ["nif", "iban"])


@query(f"""
SELECT snapshot_id, idx, CASE WHEN {sql_data('proveedor')} IS NULL AND {sql_data('proveedor_id')} IS NULL THEN 'missing' WHEN {sql_data('proveedor')} <> {sql_data('proveedor_id')} THEN 'conflicting' ELSE 'ok' END AS supplier_state,
  CASE WHEN {sql_data('proveedor')} <> {sql_data('proveedor_id')} THEN NULL ELSE coalesce({sql_data('proveedor')}, {sql_data('proveedor_id')}) END AS supplier FROM erp_rows""")
def jo_alias_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.alias_agreement(table(spark, sf_dir, "erp_rows"), "supplier", [data(F.col("proveedor")), data(F.col("proveedor_id"))]).select("snapshot_id", "idx", "supplier", "supplier_state")


@query("""
SELECT b.id AS batch_id, e.event_id FROM (SELECT id, epoch_us(created) - 66096000000000 AS a, epoch_us(created) - 66096000000000 + 3600000000 AS z FROM batches) b
JOIN (SELECT event_id, epoch_us(ts) + 0 AS at FROM events) e ON e.at >= b.a AND e.at < b.z""")
def jo_events_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval join: events within the hour that lies 765 days before each batch, by bins of an hour."""
    batches, events = table(spark, sf_dir, "batches"), table(spark, sf_dir, "events")
    start = micros(batches, "created") - 1_000_000 * 86400 * 765
    windows = batches.select(F.col("id").alias("batch_id"), start.alias("a"), (start + 3_600_000_000).alias("z"))
    points = events.select("event_id", micros(events, "ts").alias("at"))
    return rel.interval_join(points, "at", windows, "a", "z", 3_600_000_000).select("batch_id", "event_id")


@query("""
SELECT o_orderkey, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS n_lines, (SELECT min(l_shipdate) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')::DATE AS first_returned FROM orders o""")
def jo_scalar_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated lookups as one aggregate join."""
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.min(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).cast("date").alias("first_returned"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(x, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"), "first_returned")


# --- aggregations


@query("""
WITH d AS (SELECT unnest(['OK', 'MISSING', 'INVALID', 'CONFLICT', 'LOW_QUALITY']) AS status)
SELECT d.status, count(r.status) AS n FROM d LEFT JOIN ocr_report r ON r.status = d.status GROUP BY 1""")
def ag_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for every status, also for those that don't occur."""
    domain = spark.createDataFrame([(s,) for s in ("OK", "MISSING", "INVALID", "CONFLICT", "LOW_QUALITY")], "status string")
    n = table(spark, sf_dir, "ocr_report").groupBy("status").agg(F.count("*").alias("n"))
    return domain.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT batch_id, count(*) AS n, count(*) FILTER (state = 'DONE') AS n_done, count(*) FILTER (state = 'ERROR') AS n_error, count(*) FILTER (extraction IS NULL) AS n_unread FROM invoice_documents GROUP BY 1")
def ag_conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "invoice_documents").groupBy("batch_id")
    return x.agg(F.count("*").alias("n"), F.count_if(F.col("state") == "DONE").alias("n_done"), F.count_if(F.col("state") == "ERROR").alias("n_error"), F.count_if(F.col("extraction").isNull()).alias("n_unread"))


@query("""
SELECT json_extract_string(extraction, '$.profile') AS profile, count(*) AS n, round(median(CAST(json_extract_string(extraction, '$.seconds') AS DOUBLE)), 4) AS p50, round(quantile_disc(CAST(json_extract_string(extraction, '$.seconds') AS DOUBLE), 0.95), 4) AS p95, round(max(CAST(json_extract_string(extraction, '$.seconds') AS DOUBLE)), 4) AS most
FROM invoice_documents WHERE extraction IS NOT NULL GROUP BY 1""")
def ag_stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "invoice_documents").filter("extraction IS NOT NULL").select(F.from_json("extraction", "profile STRING, seconds DOUBLE").alias("e")).select("e.*").groupBy("profile")
    return x.agg(F.count("*").alias("n"), F.round(F.median("seconds"), 4).alias("p50"), F.round(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY seconds)"), 4).alias("p95"), F.round(F.max("seconds"), 4).alias("most"))


@query("""SELECT flag, count(*) AS n FROM (SELECT unnest(review_flags) AS flag FROM ocr_labels) GROUP BY 1""")
def ag_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ocr_labels").select(F.explode("review_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("""
WITH k AS (SELECT sha256(field || '|' || status || '|' || coalesce(normalization_error, '')) AS group_id, field, status, file_id FROM ocr_report WHERE status <> 'OK')
SELECT group_id, min(field) AS field, min(status) AS status, count(DISTINCT file_id) AS n_files, min(file_id) AS first_file FROM k GROUP BY 1""")
def ag_cause_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that fail for one reason, as groups with a digest of the reason."""
    x = table(spark, sf_dir, "ocr_report").filter("status <> 'OK'")
    key = F.sha2(F.concat("field", F.lit("|"), "status", F.lit("|"), F.coalesce("normalization_error", F.lit(""))), 256)
    return x.groupBy(key.alias("group_id")).agg(F.min("field").alias("field"), F.min("status").alias("status"), F.count_distinct("file_id").alias("n_files"), F.min("file_id").alias("first_file"))


@query(f"""
WITH a AS (SELECT {sql_identifier(_value('currency'))} AS currency, {sql_amount(_value('total'))} AS total FROM invoice_documents WHERE extraction IS NOT NULL)
SELECT currency, CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) FILTER (total IS NULL) AS n_unknown FROM a GROUP BY 1""")
def ag_currency_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _readings(spark, sf_dir, "currency", "total").join(table(spark, sf_dir, "invoice_documents").filter("extraction IS NOT NULL").select("id"), "id", "left_semi")
    t = amount(F.col("total"))
    return x.groupBy(identifier(F.col("currency")).alias("currency")).agg(F.sum(t.cast("decimal(18,2)")).cast("double").alias("total"), F.count_if(t.isNull()).alias("n_unknown"))


_EVAL = f"""
WITH r AS (SELECT {_SPLIT} AS split, field, count(*) AS n, count(*) FILTER ((expected IS NULL AND status = 'MISSING') OR observed = expected) AS exact, count(*) FILTER (status = 'OK' AND observed IS NOT NULL) AS accepted, count(*) FILTER (status = 'OK' AND observed = expected) AS accepted_exact
  FROM ocr_report GROUP BY GROUPING SETS ((1, field), (field)))"""


@query(_EVAL + "SELECT coalesce(split, 'all') AS split, field, n, exact, accepted, round(exact::DOUBLE / n, 6) AS accuracy, CASE WHEN accepted > 0 THEN round(accepted_exact::DOUBLE / accepted, 6) END AS precision, round(accepted::DOUBLE / n, 6) AS coverage FROM r")
def ag_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, precision of what is accepted, and coverage, by split and field and by field."""
    return _evaluation(spark, sf_dir)


def _evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower(F.trim("split"))
    x = table(spark, sf_dir, "ocr_report").withColumn("split", F.when(name == "val", "validation").otherwise(name))
    same = F.col("observed") == F.col("expected")
    x = x.groupingSets([["split", "field"], ["field"]], "split", "field").agg(
        F.count("*").alias("n"),
        F.count_if((F.col("expected").isNull() & (F.col("status") == "MISSING")) | same).alias("exact"),
        F.count_if((F.col("status") == "OK") & F.col("observed").isNotNull()).alias("accepted"),
        F.count_if((F.col("status") == "OK") & same).alias("accepted_exact"),
    )
    ratio = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 6)
    return x.select(F.coalesce("split", F.lit("all")).alias("split"), "field", "n", "exact", "accepted", ratio("exact", "n").alias("accuracy"), ratio("accepted_exact", "accepted").alias("precision"), ratio("accepted", "n").alias("coverage"))


@query(_EVAL + ", q AS (SELECT coalesce(split, 'all') AS split, exact::DOUBLE / n AS a FROM r) SELECT split, round(avg(round(a, 6)), 6) AS macro_accuracy FROM q GROUP BY 1")
def ag_evaluation_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).groupBy("split").agg(F.round(F.avg("accuracy"), 6).alias("macro_accuracy"))


@query(f"""SELECT {sql_data('nif')} AS nif, count(DISTINCT {sql_data('id')}) AS n_ids, count(*) AS n_rows FROM supplier_rows WHERE {sql_data('nif')} IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def ag_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "supplier_rows").groupBy(data(F.col("nif")).alias("nif")).agg(F.count_distinct(data(F.col("id"))).alias("n_ids"), F.count("*").alias("n_rows"))
    return x.filter("nif IS NOT NULL AND n_rows > 1")


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, count(DISTINCT user_id) AS n_users, CASE WHEN max(ts) > min(ts) THEN round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts)))::DOUBLE * 1000000, 6) END AS per_second FROM events GROUP BY 1""")
def ag_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    us = micros(events, "ts")
    x = events.groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), (F.max(us) - F.min(us)).alias("span"))
    return x.select("hour", "n", "n_users", F.round(F.try_divide(F.col("n").cast("double"), F.col("span")) * 1_000_000, 6).alias("per_second"))


# --- windows

_HISTORY = f"""
WITH r AS (SELECT snapshot_id, idx, {sql_order('pedido')} AS pedido, coalesce({sql_data('proveedor')}, {sql_data('proveedor_id')}) AS proveedor, {sql_data('nif')} AS nif, CAST({sql_amount('coalesce(importe, importe_esperado)')} AS DECIMAL(18,2)) AS importe, {sql_data('estado')} AS estado FROM erp_rows)"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "erp_rows").select("snapshot_id", "idx", order_number(F.col("pedido")).alias("pedido"), F.coalesce(data(F.col("proveedor")), data(F.col("proveedor_id"))).alias("proveedor"), data(F.col("nif")).alias("nif"), amount(F.coalesce("importe", "importe_esperado")).cast("decimal(18,2)").alias("importe"), data(F.col("estado")).alias("estado"))
    return x.filter("pedido IS NOT NULL")


@query(_HISTORY + """
SELECT pedido, count(*) AS n_rows, count(DISTINCT proveedor || '|' || nif || '|' || importe) AS n_signatures, max(snapshot_id) AS last_snapshot,
  CASE WHEN count(*) FILTER (proveedor IS NULL) > 0 THEN 'missing_supplier' WHEN count(*) FILTER (importe IS NULL) > 0 THEN 'malformed_amount' WHEN count(DISTINCT proveedor || '|' || coalesce(nif, '') || '|' || importe) > 1 THEN 'conflicting_identity_or_amount' ELSE 'consistent' END AS reason
FROM r WHERE pedido IS NOT NULL GROUP BY 1""")
def wi_order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all rows of an order agree, and the first reason why not; one aggregation."""
    signature = F.concat("proveedor", F.lit("|"), "nif", F.lit("|"), F.col("importe").cast("string"))
    loose = F.concat("proveedor", F.lit("|"), F.coalesce("nif", F.lit("")), F.lit("|"), F.col("importe").cast("string"))
    x = _history(spark, sf_dir).groupBy("pedido").agg(F.count("*").alias("n_rows"), F.count_distinct(signature).alias("n_signatures"), F.max("snapshot_id").alias("last_snapshot"), F.count_if(F.col("proveedor").isNull()).alias("a"), F.count_if(F.col("importe").isNull()).alias("b"), F.count_distinct(loose).alias("c"))
    reason = F.when(F.col("a") > 0, "missing_supplier").when(F.col("b") > 0, "malformed_amount").when(F.col("c") > 1, "conflicting_identity_or_amount").otherwise("consistent")
    return x.select("pedido", "n_rows", "n_signatures", "last_snapshot", reason.alias("reason"))


@query(f"""
WITH d AS (SELECT id, created, lower(replace(sha256, 'sha256:', '')) AS sha, {_value('"order"')} AS o FROM invoice_documents WHERE {_value('"order"')} IS NOT NULL),
g AS (SELECT o, count(*) AS n, count(DISTINCT sha) AS k, arg_min(id, {{'c': created, 'i': id}}) AS first_id FROM d GROUP BY 1)
SELECT d.id, g.first_id AS canonical_id, CASE WHEN n = 1 THEN 'none' WHEN k = 1 THEN 'confirmed_copy' ELSE 'conflict' END AS state FROM d JOIN g ON d.o = g.o""")
def wi_duplicate_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name one order, by whether their contents are one; aggregated by order, then joined."""
    d = _readings(spark, sf_dir, "order").filter("order IS NOT NULL").select("id", "created", F.lower(F.regexp_replace("sha256", "sha256:", "")).alias("sha"), "order")
    g = d.groupBy("order").agg(F.count("*").alias("n"), F.count_distinct("sha").alias("k"), F.min_by("id", F.struct("created", "id")).alias("canonical_id"))
    return d.join(g, "order").select("id", "canonical_id", F.when(F.col("n") == 1, "none").when(F.col("k") == 1, "confirmed_copy").otherwise("conflict").alias("state"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def wi_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"])


@query("""
WITH a AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, min(event_id) AS first_at, max(event_id) AS last_at, count(*) AS n_rows FROM b GROUP BY 1, 2""")
def wi_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive events of one type."""
    x = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return rel.islands(x, ["user_id"], ["ts", "event_id"], "event_type", "event_id").select("user_id", "run", "event_type", "first_at", "last_at", "n_rows")


@query("""
WITH a AS (SELECT event_id, user_id, event_type, value, lag(event_type) OVER w AS pt, lag(value) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, (pt IS DISTINCT FROM event_type) AS type_changed, (pv IS DISTINCT FROM value) AS value_changed, round(value - pv, 6) AS difference FROM a""")
def wi_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.lag("event_type").over(w).alias("pt"), F.lag("value").over(w).alias("pv"))
    return x.select("event_id", (~F.col("pt").eqNullSafe(F.col("event_type"))).alias("type_changed"), (~F.col("pv").eqNullSafe(F.col("value"))).alias("value_changed"), F.round(F.col("value") - F.col("pv"), 6).alias("difference"))


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n_hour FROM events""")
def wi_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the user within the hour before each event."""
    events = table(spark, sf_dir, "events")
    x = events.select("event_id", "user_id", micros(events, "ts").alias("at"))
    return x.select("event_id", "user_id", F.count("*").over(Window.partitionBy("user_id").orderBy("at").rangeBetween(-3_600_000_000, 0)).alias("n_hour"))


# --- sorts and pages


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12")
def so_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(12)


@query("SELECT file_id, field, status, row_number() OVER (ORDER BY CASE status WHEN 'CONFLICT' THEN 0 WHEN 'INVALID' THEN 1 WHEN 'LOW_QUALITY' THEN 2 WHEN 'MISSING' THEN 3 ELSE 4 END, file_id, field, coalesce(observed, ''), coalesce(split, ''), coalesce(expected, ''), coalesce(normalization_error, '')) AS place FROM ocr_report ORDER BY place LIMIT 40 OFFSET 40")
def so_attention_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of forty readings, those that need attention first."""
    rank = F.when(F.col("status") == "CONFLICT", 0).when(F.col("status") == "INVALID", 1).when(F.col("status") == "LOW_QUALITY", 2).when(F.col("status") == "MISSING", 3).otherwise(4)
    empty = [F.coalesce(c, F.lit("")) for c in ("observed", "split", "expected", "normalization_error")]
    x = table(spark, sf_dir, "ocr_report").orderBy(rank, "file_id", "field", *empty).limit(80)
    x = x.withColumn("place", F.row_number().over(Window.orderBy(rank, "file_id", "field", *empty)))  # of 80 rows
    return x.filter("place > 40").select("file_id", "field", "status", "place")


# --- sets


@query(f"""
WITH a AS (SELECT DISTINCT file_id FROM ocr_labels), b AS (SELECT DISTINCT file_id FROM ocr_splits), c AS (SELECT DISTINCT file_id FROM ocr_report)
SELECT 'labels_without_split' AS what, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL
SELECT 'split_without_labels', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL
SELECT 'in_all_three', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b INTERSECT SELECT * FROM c) UNION ALL
SELECT 'in_any', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c)""")
def se_file_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences, intersection and union of the files of three tables, by one aggregation of their union."""
    parts = [table(spark, sf_dir, t).select("file_id", F.lit(1 << i).alias("bit")) for i, t in enumerate(("ocr_labels", "ocr_splits", "ocr_report"))]
    x = parts[0].union(parts[1]).union(parts[2]).groupBy("file_id").agg(F.bit_or("bit").alias("bits"))
    n = lambda c: F.count_if(c)
    b = F.col("bits")
    x = x.agg(n((b.bitwiseAND(1) == 1) & (b.bitwiseAND(2) == 0)).alias("labels_without_split"), n((b.bitwiseAND(2) == 2) & (b.bitwiseAND(1) == 0)).alias("split_without_labels"), n(b == 7).alias("in_all_three"), F.count("*").alias("in_any"))
    return x.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in x.columns])).alias("r")).select("r.*")


@query("SELECT file_id, list_sort(list(DISTINCT field)) AS fields, count(DISTINCT field) AS n FROM ocr_report WHERE status <> 'OK' GROUP BY 1")
def se_element_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set of fields that fail for each file (a file has ten fields at most)."""
    x = table(spark, sf_dir, "ocr_report").filter("status <> 'OK'").groupBy("file_id").agg(F.sort_array(F.collect_set("field")).alias("fields"))
    return x.withColumn("n", F.size("fields").cast("long"))


# --- incremental steps


@query("SELECT DISTINCT sha256(coalesce(p_brand, '') || '|' || coalesce(p_type, '')) AS id, p_brand, p_type FROM part WHERE sha256(coalesce(p_brand, '') || '|' || coalesce(p_type, '')) NOT IN (SELECT sha256(coalesce(p_brand, '') || '|' || coalesce(p_type, '')) FROM part WHERE p_size <= 2)")
def tx_append_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an append by content digest adds to what is there already."""
    x = table(spark, sf_dir, "part").select(F.sha2(F.concat_ws("|", F.coalesce("p_brand", F.lit("")), F.coalesce("p_type", F.lit(""))), 256).alias("id"), "p_brand", "p_type", "p_size")
    return rel.missing_only(x.select("id", "p_brand", "p_type"), x.filter("p_size <= 2"), ["id"])


@query("""
WITH l AS (SELECT file_id, field, max(expected) AS expected FROM ocr_labels WHERE expected IS NOT NULL GROUP BY 1, 2), r AS (SELECT file_id, field, max(observed) AS observed FROM ocr_report GROUP BY 1, 2)
SELECT r.file_id, r.field, coalesce(l.expected, r.observed) AS value, (l.expected IS NOT NULL AND l.expected IS DISTINCT FROM r.observed) AS corrected FROM r LEFT JOIN l ON r.file_id = l.file_id AND r.field = l.field""")
def tx_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels laid over readings: a label wins where there is one."""
    one = lambda t, c: table(spark, sf_dir, t).filter(F.col(c).isNotNull() | F.lit(t == "ocr_report")).groupBy("file_id", "field").agg(F.max(c).alias(c))
    x = one("ocr_report", "observed").join(one("ocr_labels", "expected"), ["file_id", "field"], "left")
    return x.select("file_id", "field", F.coalesce("expected", "observed").alias("value"), (F.col("expected").isNotNull() & ~F.col("expected").eqNullSafe(F.col("observed"))).alias("corrected"))


@query(_HISTORY + """
, o AS (SELECT pedido, min(snapshot_id) AS a, max(snapshot_id) AS b FROM r WHERE pedido IS NOT NULL GROUP BY 1),
h AS (SELECT r.pedido, snapshot_id, min(coalesce(proveedor, '')) AS p, max(coalesce(estado, '')) AS e, max(coalesce(importe, -1)) AS i FROM r WHERE pedido IS NOT NULL GROUP BY 1, 2)
SELECT o.pedido, (x.p, x.e, x.i) IS NOT DISTINCT FROM (y.p, y.e, y.i) AS reused FROM o JOIN h x ON x.pedido = o.pedido AND x.snapshot_id = o.a JOIN h y ON y.pedido = o.pedido AND y.snapshot_id = o.b""")
def tx_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose facts are the same in the first and the last export that names them, so that what depends on them can be reused."""
    h = _history(spark, sf_dir).groupBy("pedido", "snapshot_id").agg(F.struct(F.min(F.coalesce("proveedor", F.lit(""))).alias("p"), F.max(F.coalesce("estado", F.lit(""))).alias("e"), F.max(F.coalesce("importe", F.lit(-1).cast("decimal(18,2)"))).alias("i")).alias("facts"))
    x = h.groupBy("pedido").agg(F.min_by("facts", "snapshot_id").alias("first"), F.max_by("facts", "snapshot_id").alias("last"))
    return x.select("pedido", F.col("first").eqNullSafe(F.col("last")).alias("reused"))


# --- extraction from lines


@query()
def ex_field_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for ten fields in the lines of invoices, with the labels of seven languages."""
    schema = "pages ARRAY<STRUCT<lines: ARRAY<STRUCT<line_no: INT, text: STRING>>>>"
    x = table(spark, sf_dir, "invoice_documents").filter("extraction IS NOT NULL").select("id", F.explode(F.flatten(F.from_json("extraction", schema)["pages"]["lines"])).alias("l"))
    return x.select("id", F.col("l.line_no").alias("line_no"), F.explode(cand.candidates(F.col("l.text"))).alias("c")).select("id", "line_no", "c.*")


@query("""
WITH k AS (SELECT id, extraction, unnest(json_keys(extraction, '$.fields')) AS field FROM invoice_documents WHERE extraction IS NOT NULL),
e AS (SELECT id, field, CAST(json_extract(extraction, '$.fields.' || field || '.evidence') AS JSON[]) AS ev FROM k),
u AS (SELECT id, field, unnest(ev) AS x FROM e),
g AS (SELECT id, field, count(*) AS n, count(DISTINCT json_extract_string(x, '$.raw_value')) AS k, min(CAST(json_extract_string(x, '$.confidence') AS DOUBLE)) AS c FROM u GROUP BY 1, 2)
SELECT e.id, e.field, CASE WHEN g.n IS NULL OR g.k = 0 THEN 'MISSING' WHEN g.k > 1 THEN 'CONFLICT' WHEN g.c < 0.85 THEN 'LOW_QUALITY' ELSE 'OK' END AS resolved FROM e LEFT JOIN g ON e.id = g.id AND e.field = g.field""")
def ex_resolved_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each field by its evidence: none, several values, little confidence, or well read. Array functions, no shuffle."""
    values = F.array_distinct(F.array_compact(F.transform("evidence", lambda e: e["raw_value"])))
    least = F.array_min(F.transform("evidence", lambda e: e["confidence"]))
    n = F.coalesce(F.size(values), F.lit(0))
    status = F.when(F.col("evidence").isNull() | (n <= 0), "MISSING").when(n > 1, "CONFLICT").when(least < 0.85, "LOW_QUALITY").otherwise("OK")
    return fields(spark, sf_dir).select("id", "field", status.alias("resolved"))


_PHRASES = {
    "pay_unchecked": "no procede contrastarlo|no es necesario|sin necesidad de|ignorar la discrepancia|ya esta aprobada|ya ha sido verificad|ya realizada por el responsable|autorizada por la administracion|autorizada por el ceo|autorizado por el ceo|autorizada en regimen especial|no recalcular|registrar como pagar|diferencia de importe autorizada",
    "do_not_pay": "no procede pago|solo a efectos de archivo|unicamente a efectos contables",
    "escalate": "excluirse del calculo de precision|excluirse del computo de aciertos|conjunto de test|equipo de evaluacion|auditor de calidad|documento de prueba remitido|debe marcarse como escalado|debe marcarse como escalar",
    "to_system": "los sistemas automaticos|sistemas de validacion automatica|sin escalado adicional|continuar el pago sin escalado|no bloquear validacion|pago inmediato requerido|aviso interno",
}
_FOLDED = r"regexp_replace(strip_accents(lower(nfc_normalize(text))), '[\s\p{Z}]+', ' ', 'g')"


@query(rf"""
WITH t AS (SELECT 'documents' AS tab, CAST(doc_id AS VARCHAR) AS rec_key, text FROM documents UNION ALL SELECT 'invoice_documents', id, array_to_string(list_transform(CAST(json_extract(extraction, '$.pages[*].lines[*].text') AS VARCHAR[]), lambda x: x), ' ') FROM invoice_documents),
f AS (SELECT tab, rec_key, {_FOLDED} AS f FROM t WHERE text IS NOT NULL)
SELECT tab, rec_key, {', '.join(f"regexp_matches(f, '{v}') AS {k}" for k, v in _PHRASES.items())} FROM f WHERE regexp_matches(f, '{"|".join(_PHRASES.values())}')""")
def ex_manipulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a phrase of a family of manipulation, and which families; lines of invoices are one text each."""
    schema = "pages ARRAY<STRUCT<lines: ARRAY<STRUCT<text: STRING>>>>"
    lines = table(spark, sf_dir, "invoice_documents").select(F.lit("invoice_documents").alias("tab"), F.col("id").alias("rec_key"), F.array_join(F.flatten(F.from_json("extraction", schema)["pages"]["lines"])["text"], " ").alias("text"))
    docs = table(spark, sf_dir, "documents").select(F.lit("documents"), F.col("doc_id").cast("string"), "text")
    by = cand.families(F.col("text"))
    x = lines.union(docs).filter("text IS NOT NULL").select("tab", "rec_key", *[v.alias(k) for k, v in by.items()])
    return x.filter(" OR ".join(by))


@query("""
SELECT strftime(to_timestamp(floor(epoch(ts) / 3600) * 3600) AT TIME ZONE 'UTC', '%Y-%m-%d %H:00') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def st_hourly_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arqueo.streaming.events import hourly_counts

    return hourly_counts(spark, f"{sf_dir}/events.parquet")


@query(r"SELECT doc_id, trim(regexp_replace(strip_accents(replace(replace(lower(nfc_normalize(source)), '’', ''''), 'ß', 'ss')), '[\s\p{Z}]+', ' ', 'g')) AS source_key FROM documents WHERE source IS NOT NULL")
def st_source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("source IS NOT NULL").select("doc_id", fold(F.col("source")).alias("source_key"))


QUERIES, SQL = query.queries, query.sql
