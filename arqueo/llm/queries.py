"""Queries p1_, p2_ and p5_ to p9_ over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arqueo.functions.text import amount, amount_of, composed, data, data_of, identifier, order_number, order_number_of
from arqueo.functions.times import with_time
from arqueo.llm import dedup, leakage, lookalike, mixture, pieces, splits, survivor, tokens
from arqueo.llm.sql import SQL  # noqa: F401
from arqueo.session import new_path, small_side, table, written

# --- 1: splits that keep related records together


def label_keys(labels: DataFrame) -> dict[str, Column]:
    nif = F.when(F.lower(F.trim("field")) == "supplier_nif", data(F.col("expected")))
    return {"supplier": data(F.col("supplier_id")), "template": data(F.col("template_id")), "nif": nif}


def splits_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record, split of every file in ocr_splits and ocr_report; blanks and letter case don't count, val is validation."""
    x = table(spark, sf_dir, "ocr_splits").select("file_id", "split").union(table(spark, sf_dir, "ocr_report").select("file_id", "split"))
    name = F.lower(data(F.col("split")))
    return x.select(F.col("file_id").alias("record"), F.when(name == "val", "validation").otherwise(name).alias("split")).filter("split IS NOT NULL AND record IS NOT NULL").distinct()


def p1_store(spark: SparkSession, sf_dir: str) -> splits.Store:
    """The labels' groups and splits, taken in two steps: the files that have a split today, then the others."""
    labels, today = table(spark, sf_dir, "ocr_labels"), written(splits_today(spark, sf_dir), "today")
    edges = written(splits.edges_of(labels, "file_id", label_keys(labels)), "edges")
    targets = table(spark, sf_dir, "split_targets").select(F.lower(F.trim("split")).alias("split"), "share")
    known = today.select(F.concat(F.lit("r:"), "record").alias("a")).distinct()
    store = splits.Store(spark, new_path(spark, "splits"))
    splits.assign_splits(edges.join(known, "a", "left_semi"), targets, store, today)
    splits.assign_splits(edges.join(known, "a", "left_anti"), targets, store, today)
    return store


def p1_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_store(spark, sf_dir).assignment().select(F.col("record").alias("file_id"), "split", "status")


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and share of each split, beside the target."""
    x = p1_assignment(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n_files"), F.count_if(F.col("status") == "quarantined").alias("n_quarantined"))
    total = x.agg(F.sum("n_files").alias("total"))
    targets = table(spark, sf_dir, "split_targets").select(F.lower(F.trim("split")).alias("split"), F.col("share").alias("target_share"))
    x = targets.join(x, "split", "left").crossJoin(F.broadcast(total))
    return x.select("split", "target_share", F.coalesce("n_files", F.lit(0)).alias("n_files"), (F.coalesce("n_files", F.lit(0)) / F.col("total")).alias("share"), F.coalesce("n_quarantined", F.lit(0)).alias("n_quarantined"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of the store that assigning the splits fills."""
    today = written(splits_today(spark, sf_dir), "today")
    nodes = written(p1_store(spark, sf_dir).components(), "components")
    files = nodes.filter("node LIKE 'r:%'").select(F.substr("node", F.lit(3)).alias("file_id"), "component")
    names = nodes.filter("node LIKE 'supplier:%'").groupBy("component").agg(F.min(F.substr("node", F.lit(10))).alias("group_id"))
    broken = files.join(today.withColumnRenamed("record", "file_id"), "file_id").groupBy("component").agg(F.count_distinct("split").alias("n")).filter("n > 1")
    return files.join(broken.select("component"), "component", "left_semi").join(names, "component", "left").select("file_id", "group_id")


# --- 2: new batches against all history

READINGS = ["invoice_number", "supplier_nif", "order", "date", "total"]


def invoice_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "invoice_documents")
    schema = "fields STRUCT<" + ", ".join(f"`{r}`: STRUCT<value: STRING>" for r in READINGS) + ">"
    x = docs.select("id", "file_id", "sha256", F.unix_micros(F.col("created").cast("timestamp")).alias("created"), F.col("extraction").isNull().alias("bare"), F.from_json("extraction", schema)["fields"].alias("f"))
    x = x.select("id", "file_id", "sha256", "created", "bare", *[F.col(f"f.{r}.value").alias(r) for r in READINGS])
    x = with_time(x, F.col("date"), "d")
    text = lambda c: data(c)
    slots = [
        data(composed(F.col("invoice_number"))),
        data(F.col("supplier_nif")),
        F.coalesce(order_number(F.col("order")), text(F.col("order"))),
        F.coalesce(F.col("d_date").cast("string"), text(F.col("date"))),
        F.coalesce(amount(F.col("total")).cast("string"), text(F.col("total"))),
    ]
    x = x.select("id", "file_id", "sha256", "created", "bare", *[s.alias(f"s{i}") for i, s in enumerate(slots)])
    return dedup.features(x, F.col("id"), F.col("created"), {"sha256": dedup.content_digest(F.col("sha256"))}, {"file": dedup.file_name(F.col("file_id"))}, F.col("bare"), [F.col(f"s{i}") for i in range(5)], 4)


def p2_repeats(spark: SparkSession, sf_dir: str, steps: int = 3) -> DataFrame:
    """Each row that repeats accepted ones, with the row it repeats: id, kept_id."""
    feats = written(invoice_features(spark, sf_dir), "features")
    arrival = table(spark, sf_dir, "batches").select(F.unix_micros(F.col("created").cast("timestamp")).alias("at"))
    return dedup.in_steps(feats, arrival, steps, 4)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_repeats(spark, sf_dir).select(F.least("id", "kept_id").alias("id_a"), F.greatest("id", "kept_id").alias("id_b")).distinct()


def p2_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each batch brought and how many of them repeat earlier ones."""
    docs = table(spark, sf_dir, "invoice_documents").select("id", "batch_id")
    hit = p2_repeats(spark, sf_dir).select("id").distinct().withColumn("hit", F.lit(1))
    return docs.join(hit, "id", "left").groupBy("batch_id").agg(F.count("*").alias("n_rows"), F.count("hit").alias("n_repeats"))


# --- 5: best representative of each group

SURVIVOR_FIELDS = ["importe", "proveedor", "nif", "estado"]


def erp_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """erp_rows that have an order number: pedido, at, complete, snapshot_id, idx and the fields' canonical values (null: no candidate)."""
    exports = table(spark, sf_dir, "erp_snapshot").groupBy("snapshot_id").agg(F.max(F.coalesce("complete", F.lit(False))).alias("complete"))
    x = table(spark, sf_dir, "erp_rows")
    # An export fills one spelling of a column; of a row with both, the first that is data counts, and the later time.
    plain = {c: identifier(F.col(c)) for c in ("pedido", "importe", "importe_esperado", "proveedor", "proveedor_id", "nif", "estado")}
    x = x.select("snapshot_id", "idx", "fecha", "fecha_registro", *[v.alias(c) for c, v in plain.items()])
    x = x.select("snapshot_id", "idx", "fecha", "fecha_registro", order_number_of(F.col("pedido")).alias("pedido"), F.coalesce(amount_of(F.col("importe")), amount_of(F.col("importe_esperado"))).cast("string").alias("importe"), F.coalesce(data_of(F.col("proveedor")), data_of(F.col("proveedor_id"))).alias("proveedor"), data_of(F.col("nif")).alias("nif"), data_of(F.col("estado")).alias("estado"))
    x = x.filter("pedido IS NOT NULL")
    keep = ["snapshot_id", "idx", "pedido", *SURVIVOR_FIELDS]
    x = with_time(with_time(x, F.col("fecha"), "a", [*keep, "fecha_registro"]), F.col("fecha_registro"), "b", [*keep, "a_at"])
    x = x.select(*keep, F.greatest("a_at", "b_at").alias("at"))
    return x.join(small_side(exports), "snapshot_id", "left").withColumn("complete", F.coalesce("complete", F.lit(False)))


def _survivors(rows: DataFrame, precedence: DataFrame | None = None) -> DataFrame:
    fields = {f: (F.col(f).isNotNull(), f) for f in SURVIVOR_FIELDS}
    return survivor.survivors(rows, "pedido", fields, ["complete"], "at", ["snapshot_id", "idx"], precedence)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(erp_candidates(spark, sf_dir)).select("pedido", "field", "snapshot_id", "idx")


def p5_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learned order of values: field, value, depth."""
    return survivor.learned_precedence(written(erp_candidates(spark, sf_dir), "candidates"), "pedido", "at", {f: f for f in SURVIVOR_FIELDS}, ["snapshot_id", "idx"])


def p5_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors where learned precedence places rows without time, among each other and against dated ones, with their values."""
    rows = written(erp_candidates(spark, sf_dir), "candidates")
    order = survivor.learned_precedence(rows, "pedido", "at", {f: f for f in SURVIVOR_FIELDS}, ["snapshot_id", "idx"])
    return _survivors(rows, order).select("pedido", "field", "value", "at", "snapshot_id", "idx")


# --- 6: text that looks the same


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of ocr_report and line of invoice_documents as tab, rec_key, item, a (as found), b (its counterpart)."""
    report = table(spark, sf_dir, "ocr_report").select(F.lit("ocr_report").alias("tab"), F.col("file_id").alias("rec_key"), F.col("field").alias("item"), F.col("observed").alias("a"), F.col("expected").alias("b"))
    schema = "pages ARRAY<STRUCT<lines: ARRAY<STRUCT<line_no: INT, raw_text: STRING, text: STRING>>>>"
    lines = table(spark, sf_dir, "invoice_documents").filter("extraction IS NOT NULL").select("id", F.explode(F.flatten(F.from_json("extraction", schema)["pages"]["lines"])).alias("l"))
    return report.union(lines.select(F.lit("invoice_documents"), "id", F.col("l.line_no").cast("string"), "l.raw_text", "l.text"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_look(spark, text_pairs(spark, sf_dir)).select("tab", "rec_key", "item").distinct()


def p6_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct text of both tables that isn't in canonical form, with that form."""
    pairs = text_pairs(spark, sf_dir)
    return lookalike.canonical(spark, pairs.select(F.col("a").alias("text")).union(pairs.select("b")), "text").filter("text <> canon")


# --- 7: evaluation texts in the corpus


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_spans(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_spans(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents and words each leaked item is found in."""
    return p7_spans(spark, sf_dir).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.sum(F.col("last_word") - F.col("first_word") + 1).alias("n_words"))


# --- 8: sources to target weights


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokens.with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text")
    return written(docs.select("doc_id", mixture.source_name(F.col("source")).alias("source"), "n_tokens"), "sized")


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mix_targets").withColumn("source", mixture.source_name(F.col("source")))


def _mixed(spark: SparkSession, sf_dir: str, meet_all: bool = True) -> tuple[DataFrame, DataFrame]:
    return mixture.mixed(sized_documents(spark, sf_dir), "doc_id", _targets(spark, sf_dir), meet_all=meet_all)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest mix at which no source but an absent one falls short of its share."""
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of p8_mix."""
    return _mixed(spark, sf_dir)[1]


def p8_shares_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as p8_shares, under the name it had while p8_mix had another size."""
    return p8_shares(spark, sf_dir)


def p8_shares_sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report for goals that add up to all available text, where scarce sources fall short and other shares exceed their targets."""
    return _mixed(spark, sf_dir, meet_all=False)[1]


# --- 9: oversized texts


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.pieces(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_pieces(spark, sf_dir).filter("piece = 0").select("doc_id").distinct()


QUERIES = {
    "p1_found": p1_found, "p1_assignment": p1_assignment, "p1_shares": p1_shares,
    "p2_found": p2_found, "p2_batches": p2_batches,
    "p5_found": p5_found, "p5_precedence": p5_precedence, "p5_current": p5_current,
    "p6_found": p6_found, "p6_canonical": p6_canonical,
    "p7_found": p7_found, "p7_spans": p7_spans, "p7_items": p7_items,
    "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_shares_met": p8_shares_met, "p8_shares_sized": p8_shares_sized,
    "p9_found": p9_found, "p9_pieces": p9_pieces,
}
