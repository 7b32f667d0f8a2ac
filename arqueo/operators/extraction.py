"""Words of pages to lines, and candidates of fields to one status and value, also of several readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arqueo.functions.identity import fold
from arqueo.functions.readings import amount_in
from arqueo.functions.text import identifier, trimmed

FIELDS = ["invoice_number", "supplier_nif", "iban", "order", "date", "base", "tax_rate", "tax_amount", "total", "currency"]
#: Below so much confidence a candidate is badly read, by profile; from so much on a second reader can contradict the first.
LOW, LOW_TOLERANT, CONTRADICTS = 0.85, 0.84, 0.92
_INVISIBLE = r"[\x{200B}\x{200C}\x{200D}\x{FEFF}\x{2060}\x{00AD}]"


def group_lines(tokens: DataFrame, page: list[str]) -> DataFrame:
    """Lines of pages from their words: the page columns, line_no, text, raw_text, left, top, right, bottom, words, has_invisible.

    tokens: the page columns, text, left, top, right, bottom. Words are taken from top to bottom by their middle, then from the left. Each
    joins the newest of the last three lines whose height (that of its first word's middle) is nearer than 45 % of the word's own height, or 3; else it
    begins a line. Within a line words stand from left to right; each has start, its place in the text. Rows without a box are left out. A page is one
    group, and holds no more words than a page has; pages are spread.
    """
    w = F.struct(((F.col("top") + F.col("bottom")) / 2).alias("y"), F.col("left").alias("x"), F.col("text").alias("t"), F.col("top").alias("top"), F.col("right").alias("right"), F.col("bottom").alias("bottom"))
    ok = F.col("left").isNotNull() & F.col("top").isNotNull() & F.col("right").isNotNull() & F.col("bottom").isNotNull()
    pages = tokens.filter(ok).groupBy(*page).agg(F.sort_array(F.collect_list(w)).alias("ws"))
    start = F.struct(F.array().cast("array<double>").alias("ys"), F.array().cast("array<int>").alias("at"))

    def step(acc: Column, w: Column) -> Column:
        n = F.size(acc["ys"])
        near = lambda k: (n >= k) & (F.abs(F.get(acc["ys"], n - k) - w["y"]) < F.greatest(F.lit(3.0), (w["bottom"] - w["top"]) * 0.45))
        line = F.when(near(1), n - 1).when(near(2), n - 2).when(near(3), n - 3).otherwise(n)
        ys = F.when(line == n, F.concat(acc["ys"], F.array(w["y"].cast("double")))).otherwise(acc["ys"])
        return F.struct(ys.alias("ys"), F.concat(acc["at"], F.array(line.cast("int"))).alias("at"))

    x = pages.withColumn("at", F.aggregate("ws", start, step, lambda acc: acc["at"]))
    x = x.select(*page, F.posexplode(F.arrays_zip("ws", "at")).alias("i", "z")).select(*page, F.col("z.at").alias("line"), "i", "z.ws.*")
    x = x.groupBy(*page, "line").agg(F.sort_array(F.collect_list(F.struct("x", "i", "t", "top", "right", "bottom"))).alias("ws"))
    clean = F.transform("ws", lambda v: trimmed(F.regexp_replace(F.coalesce(v["t"], F.lit("")), r"\p{Cf}", "")))
    starts = lambda c: F.transform(c, lambda v, i: F.aggregate(F.slice(c, 1, i), F.lit(0), lambda a, s: a + F.length(s) + 1))
    words = F.transform(F.arrays_zip(clean.alias("text"), starts(clean).alias("start"), F.col("ws").alias("w")), lambda z: F.struct(z["text"].alias("text"), z["start"].alias("start"), z["w"]["x"].alias("left"), z["w"]["top"].alias("top"), z["w"]["right"].alias("right"), z["w"]["bottom"].alias("bottom")))
    raw = F.array_join(F.transform("ws", lambda v: F.coalesce(v["t"], F.lit(""))), " ")
    return x.select(
        *page, (F.col("line") + 1).alias("line_no"), trimmed(F.array_join(clean, " ")).alias("text"), raw.alias("raw_text"), F.array_min("ws.x").alias("left"), F.array_min("ws.top").alias("top"),
        F.array_max("ws.right").alias("right"), F.array_max("ws.bottom").alias("bottom"), words.alias("words"), raw.rlike(_INVISIBLE).alias("has_invisible"),
    )


def resolved(candidates: DataFrame, documents: DataFrame, doc: str, tolerant: bool = False) -> DataFrame:
    """doc, field, status and value of the ten fields of every document.

    candidates: doc, field, pos (order of reading), value, error, confidence (null: printed text). Standard: no candidate is MISSING, any error INVALID, several values
    CONFLICT, else OK, or LOW_QUALITY with its value if any candidate is badly read. tolerant: values beat errors, several are CONFLICT, and if a candidate of the first value is badly
    read LOW_QUALITY covers either, without value. Fields besides the ten are left out. Candidates of a field are reduced by one aggregation.
    """
    domain = documents.select(doc).distinct().select(doc, F.explode(F.array(*map(F.lit, FIELDS))).alias("field"))
    c = candidates.select(doc, "field", "pos", "value", "error", "confidence")
    each = c.groupBy(doc, "field").agg(
        F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_distinct("value").alias("values"), F.min("confidence").alias("least"),
        F.min(F.when(F.col("value").isNotNull(), F.struct("pos", "value"))).alias("__first"),
    )
    x = domain.join(each, [doc, "field"], "left").withColumn("first", F.col("__first.value"))
    if not tolerant:
        status = F.when(F.col("n").isNull(), "MISSING").when(F.col("errors") > 0, "INVALID").when(F.col("values") != 1, "CONFLICT").when(F.col("least") < LOW, "LOW_QUALITY").otherwise("OK")
        return x.select(doc, "field", status.alias("status"), F.when(status.isin("OK", "LOW_QUALITY"), F.col("first")).alias("value"))
    weak = c.join(x.select(doc, "field", "first"), [doc, "field"]).filter(F.col("value") == F.col("first")).groupBy(doc, "field").agg((F.min("confidence") < LOW_TOLERANT).alias("weak"))
    x = x.join(weak, [doc, "field"], "left")
    status = F.when(F.col("n").isNull(), "MISSING").when(F.coalesce("weak", F.lit(False)), "LOW_QUALITY").when(F.col("values") > 1, "CONFLICT").when(F.col("values") == 1, "OK").when(F.col("errors") > 0, "INVALID").otherwise("MISSING")
    return x.select(doc, "field", status.alias("status"), F.when(status == "OK", F.col("first")).alias("value"))


def merged_readers(native: DataFrame, witness: DataFrame, candidates: DataFrame, doc: str) -> DataFrame:
    """doc, field, status, value and warning after a second reader: what the first read well stays, unless the second has another value with confidence from 0.92 on (CONFLICT);
    a weaker other value is a warning. What the first didn't read well, also its CONFLICT, gives way to a good second reading, and MISSING to a poor one's status.

    native, witness: as from ``resolved``. candidates: doc, field, reader (native or witness), value, confidence (null counts as certain).
    """
    v = candidates.filter(F.col("value").isNotNull()).groupBy(doc, "field", "value").agg(F.max(F.col("reader") == "native").alias("own"), F.max(F.when(F.col("reader") == "witness", F.coalesce("confidence", F.lit(1.0)))).alias("sure"))
    other = v.filter(~F.col("own")).groupBy(doc, "field").agg(F.max("sure").alias("sure"))
    a, b = (t.select(doc, "field", F.col("status").alias(f"{k}_status"), F.col("value").alias(f"{k}_value")) for t, k in ((native, "a"), (witness, "b")))
    x = a.join(b, [doc, "field"], "full_outer").join(other, [doc, "field"], "left").withColumn("a_status", F.coalesce("a_status", F.lit("MISSING")))
    ok, strong = F.col("a_status") == "OK", F.coalesce(F.col("sure") >= CONTRADICTS, F.lit(False))
    second = F.coalesce(F.col("b_status") == "OK", F.lit(False))
    poor = (F.col("a_status") == "MISSING") & F.col("b_status").isin("LOW_QUALITY", "INVALID")
    status = F.when(ok & strong, "CONFLICT").when(ok, "OK").when(second, "OK").when(poor, F.col("b_status")).otherwise(F.col("a_status"))
    value = F.when(ok & strong, None).when(ok, F.col("a_value")).when(second, F.col("b_value")).when(poor, None).otherwise(F.col("a_value"))
    warning = F.when(ok & strong, "witness_conflict").when(ok & F.col("sure").isNotNull(), "witness_weak_conflict")
    return x.select(doc, "field", status.alias("status"), value.alias("value"), warning.alias("warning"))


def rejected(field: Column, value: Column, evidence: Column, client: str = "") -> Column:
    """Why a model's reading isn't taken, or null: the client's own tax number, a wrong shape, or an amount that its evidence doesn't hold."""
    x = identifier(value)
    nif = F.when(F.lit(bool(client)) & (x == client), "client").when(~x.rlike("^[A-Z][0-9]{7}[0-9A-Z]$|^[0-9]{8}[A-Z]$"), "shape")
    return (
        F.when(field == "supplier_nif", nif)
        .when(field == "iban", F.when(~x.rlike("^ES[0-9]{22}$"), "shape"))
        .when(field == "order", F.when(~x.rlike("^PO-[0-9]{4}-[0-9]{3,6}$"), "shape"))
        .when(field.isin("base", "tax_amount", "total", "tax_rate"), F.when(~amount_in(evidence, value.try_cast("decimal(38,6)")), "inferred"))
    )


def merged_model(fields: DataFrame, model: DataFrame, doc: str) -> DataFrame:
    """doc, field, status and value after a model's readings (doc, field, value, error; one for a field): a good one settles whatever wasn't OK, contradicts what was
    (CONFLICT), and a bad one makes MISSING INVALID. Currencies aren't the model's to read."""
    m = model.filter("field <> 'currency' AND (value IS NOT NULL OR error IS NOT NULL)").select(doc, "field", F.col("value").alias("m_value"), F.lit(True).alias("there"))
    x = fields.join(m, [doc, "field"], "left")
    ok, has = F.col("status") == "OK", F.col("m_value").isNotNull()
    against = ok & has & ~F.col("m_value").eqNullSafe(F.col("value"))
    status = F.when(against, "CONFLICT").when(ok, "OK").when(has, "OK").when(F.col("there") & (F.col("status") == "MISSING"), "INVALID").otherwise(F.col("status"))
    value = F.when(against, None).when(ok, F.col("value")).when(has, F.col("m_value")).otherwise(F.col("value"))
    return x.select(doc, "field", status.alias("status"), value.alias("value"))


def struck_out(boxes: DataFrame, strokes: DataFrame, page: list[str], width: float = 50.0) -> DataFrame:
    """Boxes with each stroke that crosses them: overlapping from left to right, with its middle between top and bottom.

    Both have the page columns, left, top, right, bottom; boxes also box_id and strokes stroke_id. An equi-join on page and columns of ``width``, to which each is
    copied where it reaches; a pair that meets in several counts once. A page's boxes aren't paired with all of its strokes.
    """
    reach = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    b = boxes.filter("left <= right").select(*page, "box_id", "left", "top", "right", "bottom").withColumn("__c", reach("left", "right"))
    s = strokes.filter("left <= right").select(*page, "stroke_id", F.col("left").alias("s_left"), F.col("right").alias("s_right"), ((F.col("top") + F.col("bottom")) / 2).alias("s_y")).withColumn("__c", reach("s_left", "s_right"))
    hit = (F.col("left") < F.col("s_right")) & (F.col("right") > F.col("s_left")) & F.col("s_y").between(F.col("top"), F.col("bottom"))
    # Of the columns that both reach only the first counts.
    once = F.col("__c") == F.floor(F.greatest("left", "s_left") / width)
    return b.join(s, [*page, "__c"]).filter(hit & once).select(*page, "box_id", "stroke_id")


def coloured(red: Column, green: Column, blue: Column, width: Column) -> Column:
    """Whether a stroke is of a red or blue pen."""
    pen = ((red > 0.40) & (red > green * 1.4) & (red > blue * 1.2)) | ((blue > 0.35) & (blue > red * 1.15) & (blue > green * 1.10))
    return F.coalesce(pen & (width >= 0.5), F.lit(False))


def page_risks(pages: DataFrame, lines: DataFrame, doc: str) -> DataFrame:
    """doc, page, reason and evidence of what speaks for annotations, each once.

    pages: doc, page, fragment_ratio, native_length, handwritten_spans, spans; lines: doc, page, text, raw_text. Text in fragments, handwriting in a part or most of the page, words of
    correction, and dates left blank.
    """
    ratio = F.try_divide(F.col("handwritten_spans"), F.greatest(F.col("spans"), F.lit(1)))
    of_page = F.array_compact(F.array(
        F.when((F.col("fragment_ratio") >= 0.45) & (F.col("native_length") >= 40), "TEXT_FRAGMENTATION"),
        F.when(F.col("handwritten_spans") > 0, F.when(ratio >= 0.70, "DOCUMENT_HANDWRITTEN").otherwise("HANDWRITTEN_ANNOTATION")),
    ))
    squeezed = F.regexp_replace(fold(F.col("text")), "[^a-z]", "")
    corrected = F.col("text").rlike(r"(?iu)\b(?:corregid|rectificad|tachad|manuscrit)[oa]\b|\ba\s+mano\b") | squeezed.rlike("corregid[oa]|rectificad[oa]|tachad[oa]")
    of_line = F.array_compact(F.array(F.when(corrected, "POSSIBLE_MANUAL_CORRECTION"), F.when(F.col("text").rlike("(?i)(?:fecha|date|data).{0,80}_{6,}"), "BLANK_OR_OVERPRINTED_DATE")))
    a = pages.select(doc, "page", F.explode(of_page).alias("reason"), F.lit(None).cast("string").alias("evidence"))
    return a.union(lines.select(doc, "page", F.explode(of_line), "raw_text")).distinct()


def fragment_ratio(words: DataFrame, page: list[str]) -> DataFrame:
    """The share of single characters among the words of each page; 1 for a page of blank words only."""
    t = trimmed(F.regexp_replace(F.coalesce("text", F.lit("")), r"\p{Cf}", ""))
    x = words.groupBy(*page).agg(F.count_if(t != "").alias("n"), F.count_if(F.length(t) == 1).alias("short"))
    return x.select(*page, F.coalesce(F.try_divide(F.col("short"), F.col("n")), F.lit(1.0)).alias("fragment_ratio"))


def supported(evidence: Column, value: Column, methods: list[str]) -> Column:
    """Whether a value has evidence of its own and all of it was read by one of the methods. evidence: array of structs with raw_value and method."""
    own = F.filter(evidence, lambda e: e["raw_value"] == value)
    return F.coalesce((F.size(own) > 0) & F.forall(own, lambda e: e["method"].isin(methods)), F.lit(False))


def latest_consistent(rows: DataFrame, key: str, order: list[str], signature: list[str], checks: dict[str, Column]) -> DataFrame:
    """The latest row of each key if all its rows are valid and say the same, and else the first reason why not.

    checks: reason -> condition that a row fails, in order of weight. A key whose rows differ in ``signature`` is conflicting.
    Result: key, reason (consistent, a check's name or conflicting), and the columns of signature and order, null unless consistent. One aggregation.
    """
    names = list(checks)
    bad = F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), F.lit(i)) for i, c in enumerate(checks.values())])
    x = rows.withColumn("__bad", bad).groupBy(key).agg(
        F.min("__bad").alias("__bad"), F.count_distinct(F.to_json(F.struct(*signature))).alias("__kinds"),
        F.max_by(F.struct(*signature), F.struct(*order)).alias("__s"), F.max(F.struct(*order)).alias("__o"),
    )
    reason = F.when(F.col("__bad").isNotNull(), F.element_at(F.array(*map(F.lit, names)), F.col("__bad") + 1)).when(F.col("__kinds") > 1, "conflicting").otherwise("consistent")
    good = reason == "consistent"
    return x.select(key, reason.alias("reason"), *[F.when(good, F.col(f"__s.{c}")).alias(c) for c in signature], *[F.when(good, F.col(f"__o.{c}")).alias(c) for c in order])


def rate_limited(events: DataFrame, by: str, at: str, limit: int, span: int, every: int) -> DataFrame:
    """events with n_span (events of the series within ``span`` before, itself included), over_limit, and failed: over the limit, or every so manieth of its series."""
    w = Window.partitionBy(by).orderBy(at)
    x = events.withColumn("n_span", F.count("*").over(w.rangeBetween(-span, 0))).withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(at, *[c for c in events.columns if c not in (by, at)])))
    over = F.col("n_span") > limit
    return x.withColumn("over_limit", over).withColumn("failed", over | (F.col("__n") % every == 0)).drop("__n")
