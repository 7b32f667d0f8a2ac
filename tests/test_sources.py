import io
import zipfile

import pytest
from pyspark.sql import functions as F

from arqueo.sources.files import append_sealed, document_files, export_gate, export_jsonl, exported, json_lines, label_files, put_blobs, put_missing, strict_csv
from arqueo.sources import pages as pg
from arqueo.sources.pages import snapshot_rows
from arqueo.sources.workbook import cells, history, read_workbook, sheet_page, sheet_table


def test_strict_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿ID,NIF\n1,B1\n".encode())
    assert [tuple(r) for r in strict_csv(spark, str(p), ["NIF", "ID"]).collect()] == [("B1", "1")]
    with pytest.raises(ValueError, match="columns"):
        strict_csv(spark, str(p), ["ID"])
    with pytest.raises(ValueError, match="bytes"):
        strict_csv(spark, str(p), ["ID", "NIF"], max_bytes=3)
    p.write_text("ID,NIF\n")
    p.write_text("ID,NIF\n1,\n2,B\n")
    with pytest.raises(ValueError, match="2 rows"):
        strict_csv(spark, str(p), ["ID", "NIF"], n_rows=40)
    with pytest.raises(ValueError, match="empty"):
        strict_csv(spark, str(p), ["ID", "NIF"], n_rows=2, filled=["NIF"])
    p.write_text("ID,NIF\n")
    with pytest.raises(ValueError, match="no rows"):
        strict_csv(spark, str(p), ["ID", "NIF"])


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"file_id": "a", "result": "X"}\n\n{bad\n')
    rows, bad = json_lines(spark, str(p), "file_id STRING, result STRING")
    assert [tuple(r) for r in rows.collect()] == [("a", "X")] and bad.count() == 1


def test_documents(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "x" / "b.PDF").write_bytes(b"%PDF2")
    assert sorted(r["file_id"] for r in document_files(spark, str(tmp_path)).collect()) == ["a.pdf", "b.PDF"]
    (tmp_path / "x" / "a.pdf").write_bytes(b"%")
    with pytest.raises(ValueError, match="names"):
        document_files(spark, str(tmp_path))
    (tmp_path / "x" / "a.pdf").write_bytes(b"")
    with pytest.raises(ValueError, match="no bytes"):
        document_files(spark, str(tmp_path))


def test_sinks_can_run_twice(spark, tmp_path):
    df = spark.createDataFrame([("b", "Y"), ("a", "X"), ("a", "X")], "file_id string, result string")
    target = str(tmp_path / "t")
    assert put_missing(df, target, "file_id") == 2 and put_missing(df, target, "file_id") == 0
    out = str(tmp_path / "out")
    for _ in range(2):
        assert export_jsonl(spark.read.parquet(target), out, "file_id", ["result", "file_id"]) == 2
    assert [r[0] for r in exported(spark, out).collect()] == ['{"file_id":"a","result":"X"}', '{"file_id":"b","result":"Y"}']
    for bad in (df, df.limit(0), spark.createDataFrame([("a", None)], df.schema)):
        with pytest.raises(ValueError, match="rows"):
            export_jsonl(bad, out, "file_id", ["file_id", "result"])


def workbook():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Pedidos" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>PO</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>12.5</v></c></row><row><c r="A2"><f>SUM(A1)</f><v>3</v></c><c r="B2" t="inlineStr"><is><t>ñ</t></is></c></row></sheetData></worksheet>')
    return b.getvalue()


def test_workbook(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    got = sorted(tuple(r) for r in read_workbook(spark, str(tmp_path / "a.xlsx")).collect())
    assert got == [("Pedidos", 1, 1, "PO", False), ("Pedidos", 1, 28, "12.5", False), ("Pedidos", 2, 1, "=SUM(A1)", True), ("Pedidos", 2, 2, "ñ", False)]
    with pytest.raises(ValueError, match="unpacks"):
        list(cells(workbook(), max_bytes=10))


def test_pages(spark):
    page = lambda ids, total=3, n=2: f"<p><meta><total>{total}</total><paginas>{n}</paginas></meta><asientos>" + "".join(f"<asiento><id>{i}</id><importe>12.874,40</importe></asiento>" for i in ids) + "</asientos></p>"
    pages = [("ok", 1, page("12")), ("ok", 2, page("3")), ("gone", 1, page("12")), ("twice", 1, page("12")), ("twice", 2, page("2")), ("meta", 1, page("12")), ("meta", 2, page("3", 4)), ("bad", 1, "<p>"), ("few", 1, page("1")), ("few", 2, page("3"))]
    rows, bad = snapshot_rows(spark.createDataFrame(pages, "snapshot_id string, page int, xml string"))
    assert sorted((r["snapshot_id"], r["id"], r["importe"]) for r in rows.collect()) == [("ok", i, "12.874,40") for i in "123"]
    assert {r[0]: r[1] for r in bad.collect()} == {"gone": "missing_page", "twice": "repeated_ids", "meta": "changing_meta", "bad": "unreadable_page", "few": "wrong_total"}


def test_an_export_that_fails_leaves_the_last(spark, tmp_path, monkeypatch):
    out, df = str(tmp_path / "out"), spark.createDataFrame([("a", "X")], "file_id string, result string")
    export_jsonl(df, out, "file_id", ["file_id", "result"])
    fail = df.withColumn("result", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        export_jsonl(fail, out, "file_id", ["file_id", "result"])
    assert [r[0] for r in exported(spark, out).collect()] == ['{"file_id":"a","result":"X"}']


def test_blobs(spark, tmp_path):
    path = str(tmp_path / "b")
    put = lambda *xs: put_blobs(spark.createDataFrame([(x, 1) for x in xs], "content binary, sha256 int"), path)
    assert put(b"a", b"b", b"a", None) == 2 and put(b"a", b"c", b"") == 2
    spark.createDataFrame([(b"spoilt", "x")], "content binary, sha256 string").withColumn("sha256", F.sha2(F.lit("d"), 256)).write.mode("append").parquet(path)
    assert put(b"e") == 1
    with pytest.raises(ValueError, match="digest"):
        put(b"d")


def test_chains_go_on(spark, tmp_path):
    from arqueo.operators.relational import chain_breaks, sealed

    rows = [("u", i, f"b{i}") for i in range(5)] + [("v", 9, None)]
    df = lambda r: spark.createDataFrame(r, "s string, o int, body string")
    whole = {(r["s"], r["o"]): r["own_hash"] for r in sealed(df(rows), "s", "o", "body").collect()}
    for part, step in ((rows[:2], 0), (rows[2:], 1), (rows[2:], 1)):
        append_sealed(df(part), str(tmp_path / "c"), step, "s", "o", "body")
    got = spark.read.parquet(str(tmp_path / "c"))
    assert {(r["s"], r["o"]): r["own_hash"] for r in got.collect()} == whole and got.count() == 6
    assert chain_breaks(got, "s", "o", "prev_hash", "own_hash", F.coalesce("body", F.lit(""))).count() == 0


def test_label_files(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"a.pdf": {"fields": {"total": "1.0", "iban": null}, "note": 1},\n "b.pdf": {"fields": {}}}')
    assert sorted(map(tuple, label_files(spark, str(tmp_path / "l.json")).collect()), key=str) == [("a.pdf", "iban", None), ("a.pdf", "total", "1.0")]


def test_sheets(spark):
    head = [("Hist", 1, 1, "Nº Pedido", False), ("Hist", 1, 2, "Importe total", False), ("Hist", 1, 3, "Otra", False)]
    body = [("Hist", 2, 1, "po-2025-001", False), ("Hist", 2, 2, "1.234,50", False), ("Hist", 3, 1, "see below", False), ("Hist", 4, 1, "=A2", True), ("Hist", 5, 1, "PO-2025-X", False), ("Hist", 5, 2, "=B2", True), ("Hist", 6, 2, "9", False)]
    book = spark.createDataFrame(head + body, "sheet string, row int, col int, value string, is_formula boolean")
    columns = {"order": ["pedido", "npedido", "nopedido"], "total": ["importetotal"]}
    orders, notes, warnings = history(book, "Hist", columns)
    assert sorted((r["row"], r["order"], r["total"]) for r in orders.collect()) == [(2, "PO-2025-001", "1234.500000"), (5, "PO-2025-X", None)]
    assert sorted((r["row"], r["text"]) for r in notes.collect()) == [(3, "see below"), (4, "=A2")] and [r["row"] for r in warnings.collect()] == [5]
    assert [x.count() for x in history(book, "None", columns)] == [0, 0, 0]
    for sheet, needed in (("None", columns), ("Hist", {**columns, "nif": ["nif"]}), ("Hist", {"order": ["npedido", "nopedido"], "total": ["importetotal"], "x": ["otra", "y"], "z": ["w"]})):
        with pytest.raises(ValueError, match="no "):
            sheet_table(book, sheet, needed)
    assert [tuple(r) for r in sheet_page(book, "Hist", 0, 1, 2, 2).collect()] == [(1, 1, "Nº Pedido"), (1, 2, "Importe total"), (2, 1, "po-2025-001"), (2, 2, "1.234,50")]


def test_requests_are_repeated():
    from datetime import UTC, datetime

    now = datetime(2026, 1, 1, tzinfo=UTC)
    assert pg.delay(1, "7") == 7 and pg.delay(1, "Thu, 01 Jan 2026 00:00:09 GMT", now) == 9 and pg.delay(1, "-3") == 0
    assert 0.2 <= pg.delay(1, None) <= 0.25 and 0.8 <= pg.delay(3, "nan") <= 0.85 and 5 <= pg.delay(9, "soon") <= 5.05
    asked, waits = [], []

    def session(*answers):
        left = list(answers)

        def send(url, data, headers):
            asked.append(url)
            if data is not None:
                return 200, {}, b"<a><token>t</token></a>"
            a = left.pop(0)
            if a is None:
                raise OSError
            return a if isinstance(a, tuple) else (200, {}, a)

        return pg.Session("http://x", "u", "p", send, waits.append)

    page = lambda n: b"<r><meta><paginas>2</paginas></meta></r>"
    assert [p for p, _ in session((503, {"Retry-After": "2"}, b""), None, page(1), (401, {}, b""), page(2)).pages()] == [1, 2]
    assert 2.0 in waits and sum("login" in u for u in asked) == 2
    for answers, why in (([(404, {}, b"")], "404"), ([b"<r>"], "XML"), ([(429, {"Retry-After": "31"}, b"")], "wait"), ([None] * 5, "5 times")):
        with pytest.raises(pg.Unavailable, match=why):
            session(*answers).request("/asientos")


def test_pages_over_http(spark):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            self.reply(b"<a><token>t</token></a>")

        def do_GET(self):
            k = int(self.path.rsplit("=", 1)[1])
            self.reply(f"<r><meta><total>2</total><paginas>2</paginas></meta><asientos><asiento><id>{k}</id></asiento></asientos></r>".encode() if self.headers["X-ERP-Token"] == "t" else b"<")

        def reply(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    pages = pg.read_pages(spark, f"http://127.0.0.1:{server.server_port}", "s1").cache()
    rows, bad = snapshot_rows(pages)
    assert sorted((r["snapshot_id"], r["id"]) for r in rows.collect()) == [("s1", "1"), ("s1", "2")] and bad.count() == 0
    server.shutdown()


def test_export_gate(spark):
    docs = lambda *r: spark.createDataFrame(r, "id string, file_id string")
    made = lambda *r: spark.createDataFrame(r, "document_id string, result string, code_hash string")
    two = docs(("1", "a"), ("2", "e\u0301"))
    good = made(("1", "X", "h"), ("2", "Y", "h"), ("3", "Z", "h"))
    assert sorted(map(tuple, export_gate(two, good, "h").collect())) == [("a", "X"), ("\u00e9", "Y")]
    for d, m, chain, why in (
        (docs(("1", "a")).limit(0), good, None, "no documents"), (two, made(("1", "X", "h")), None, "1 undecided"), (two, made(("1", "X", "h"), ("2", "Y", None)), None, "1 decided by other code"),
        (docs(("1", "\u00e9"), ("2", "e\u0301")), good, None, "repeated names"), (two, good, two, "broken chain"), (two, made(("1", "X", "h"), ("1", "Y", "h"), ("2", "Y", "h")), None, "repeated decisions"),
    ):
        with pytest.raises(ValueError, match=why):
            export_gate(d, m, "h", chain)
